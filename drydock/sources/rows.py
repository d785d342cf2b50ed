"""Inline rows and the demo tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drydock.sources.catalog import Catalog

# The statuses of demo orders and the countries of demo customers.
STATUSES = ("completed", "pending", "shipped", "cancelled")
COUNTRIES = ("US", "UK", "DE", "FR", "JP", "AU", "CA")


def values(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """The rows of a VALUES list."""
    return spark.createDataFrame(list(rows), schema)


def demo_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Ten customers and fifty orders: no NULLs, unique keys, no orphans."""
    def pick(options: Sequence[str], position):
        return F.array(*[F.lit(o) for o in options])[position]

    n = F.col("id")
    customers = spark.range(1, 11).select(
        n.alias("customer_id"),
        F.concat(F.lit("Customer "), n).alias("name"),
        F.concat(F.lit("customer"), n, F.lit("@example.com")).alias("email"),
        pick(COUNTRIES, n % len(COUNTRIES)).alias("country"),
        F.expr("timestamp_ntz'2023-01-10 09:00:00' + make_dt_interval(int(id * 30))").alias(
            "created_at"
        ),
    )
    orders = spark.range(1001, 1051).select(
        n.alias("order_id"),
        ((n * 7) % 10 + 1).alias("customer_id"),
        F.round(n * 7919 % 2500 + 15.99, 2).alias("amount"),
        pick(STATUSES, n % len(STATUSES)).alias("status"),
        F.expr("timestamp_ntz'2024-01-02 08:00:00' + make_dt_interval(int(id - 1001) * 3)").alias(
            "created_at"
        ),
    )
    return {"customers": customers, "orders": orders}


def load_demo(catalog: Catalog) -> dict[str, DataFrame]:
    """(Re)create the demo tables in a database."""
    demo = demo_tables(catalog.spark)
    return {name: catalog.recreate(name, df) for name, df in demo.items()}
