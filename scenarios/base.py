"""Inputs and changed versions of them that several scenarios share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drydock.operators import transforms as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


@dataclass(frozen=True)
class Scenario:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders")


# Changed versions of `orders`, as a rewrite and as the SQL of the same rows.

def marked_up(df: DataFrame) -> DataFrame:
    price = F.round(T.money("o_totalprice") * F.lit("1.10").cast("decimal(3,2)"), 2)
    return T.update(df, {"o_totalprice": price}, F.col("o_orderpriority") == "1-URGENT")


MARKED_UP = """
    SELECT o_orderkey, o_custkey, o_orderstatus,
           CASE WHEN o_orderpriority = '1-URGENT'
                THEN CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(1.10 AS DECIMAL(3,2)), 2)
                          AS DOUBLE)
                ELSE o_totalprice END AS o_totalprice,
           o_orderdate, o_orderpriority
    FROM orders"""


def trimmed(df: DataFrame) -> DataFrame:
    cheap = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_totalprice") < 100000)
    return T.delete(df, cheap)


TRIMMED = """
    SELECT * FROM orders
    WHERE NOT (o_orderpriority = '5-LOW' AND o_totalprice < 100000)"""


def relabelled(df: DataFrame) -> DataFrame:
    price = F.col("o_totalprice")
    status = F.when(price > 450000, "X").when(price >= 50000, F.col("o_orderstatus"))
    return T.update(df, {"o_orderstatus": status})


RELABELLED = """
    SELECT o_orderkey, o_custkey,
           CASE WHEN o_totalprice > 450000 THEN 'X'
                WHEN o_totalprice >= 50000 THEN o_orderstatus END AS o_orderstatus,
           o_totalprice, o_orderdate, o_orderpriority
    FROM orders"""


def extended(df: DataFrame) -> DataFrame:
    copies = df.where(F.col("o_orderpriority") == "2-HIGH")
    return T.insert(df, copies.withColumn("o_orderkey", -F.col("o_orderkey") - 1))


EXTENDED = """
    SELECT * FROM orders
    UNION ALL
    SELECT -o_orderkey - 1 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
           o_orderpriority
    FROM orders WHERE o_orderpriority = '2-HIGH'"""


def duplicated(df: DataFrame) -> DataFrame:
    return T.insert(df, df.where(F.col("o_orderpriority") == "3-MEDIUM"))


DUPLICATED = """
    SELECT * FROM orders
    UNION ALL
    SELECT * FROM orders WHERE o_orderpriority = '3-MEDIUM'"""


def orphaned(df: DataFrame) -> DataFrame:
    price = F.col("o_totalprice")
    custkey = F.when(price > 450000, -F.col("o_custkey") - 1).when(
        price >= 20000, F.col("o_custkey")
    )
    return T.update(df, {"o_custkey": custkey})


ORPHANED = """
    SELECT o_orderkey,
           CASE WHEN o_totalprice > 450000 THEN -o_custkey - 1
                WHEN o_totalprice >= 20000 THEN o_custkey END AS o_custkey,
           o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM orders"""
