"""Sources, listings and read-only queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from drydock.operators import transforms as T
from drydock.plans.query import previewed, query
from drydock.sources import catalog as C
from drydock.sources.delimited import ingest_csv
from drydock.sources.rows import values
from drydock.workspace import delete_path, fresh_path
from scenarios.base import TABLES, Scenario, load, orders


def csv_roundtrip(spark, sf_dir):
    """Orders, with a code that has a leading zero and a 20-digit id, through a CSV folder."""
    path = fresh_path(spark, "csv")
    code = F.concat(F.lit("0"), F.col("o_custkey").cast("string"))
    serial = F.concat(F.lit("1234567890"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    rows = orders(spark, sf_dir).withColumn("o_custcode", code).withColumn("o_serial", serial)
    rows.write.option("header", True).csv(path)
    table = ingest_csv(C.Catalog(spark), f"orders_{uuid.uuid4().hex}", path)
    delete_path(spark, path)
    return table.withColumn("o_serial", F.col("o_serial").cast("string"))


def one_column_csv(spark, sf_dir):
    """The order keys alone, counted after a round trip through a CSV folder."""
    path = fresh_path(spark, "csv")
    orders(spark, sf_dir).select("o_orderkey").write.option("header", True).csv(path)
    table = ingest_csv(C.Catalog(spark), f"keys_{uuid.uuid4().hex}", path)
    delete_path(spark, path)
    return table.agg(F.count("o_orderkey").alias("n"), F.sum("o_orderkey").alias("total"))


def all_tables(spark, sf_dir):
    return {name: load(spark, sf_dir, name) for name in TABLES}


def list_production(spark, sf_dir):
    """The listing hides sandboxes and the audit table, whatever their case."""
    tables = all_tables(spark, sf_dir)
    tables |= {
        "sbx_orders_20260403": tables["orders"],
        "SBX_part_20260403": tables["part"],
        "QG_quality_results": tables["labels"],
    }
    return C.list_tables(tables).select("table_name", "row_count")


def table_metadata(spark, sf_dir):
    return C.list_tables(all_tables(spark, sf_dir))


def describe_orders(spark, sf_dir):
    return C.describe_table("orders", orders(spark, sf_dir))


def insert_values(spark, sf_dir):
    """INSERT ... VALUES into a sandbox of orders, then a count and total per status."""
    new = values(
        spark,
        [(-1, 1, "N", 10.25), (-2, 2, "N", 20.5), (-3, 3, "F", 0.25)],
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double",
    )
    changed = T.insert(orders(spark, sf_dir), new)
    return changed.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(T.money("o_totalprice")).cast("double").alias("total"),
        F.count("o_orderpriority").alias("with_priority"),
    )


Q1 = """
    SELECT o_orderpriority, COUNT(*) AS n,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders
    WHERE o_orderstatus = 'F'
    GROUP BY o_orderpriority
    ORDER BY o_orderpriority"""

J1 = """
    SELECT o.o_orderkey, o.o_totalprice, c.c_name, c.c_mktsegment
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""

A3 = """
    WITH recent AS (
        SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01 00:00:00'
    )
    SELECT o_orderkey, o_custkey, o_orderdate FROM recent WHERE o_orderstatus <> 'P'"""


def user_query(sql, *names, for_spark=str):
    def run(spark, sf_dir):
        tables = {name: load(spark, sf_dir, name) for name in names}
        return query(spark, for_spark(sql), tables)

    return run


COUNTS = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, COUNT(*) AS row_count FROM {name}" for name in TABLES
)
COLUMNS = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, string_agg(column_name || ' (' || column_type || ')', ', ')"
    f" AS columns FROM (DESCRIBE {name})"
    for name in TABLES
)

SCENARIOS = {
    "s2_csv_roundtrip": Scenario(
        csv_roundtrip,
        """
        SELECT *, '0' || CAST(o_custkey AS VARCHAR) AS o_custcode,
               '1234567890' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS o_serial
        FROM orders""",
    ),
    "s2_csv_one_column": Scenario(
        one_column_csv,
        "SELECT COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS total FROM orders",
    ),
    "s3_list_tables": Scenario(list_production, COUNTS),
    "s4_table_row_counts": Scenario(
        table_metadata,
        f"SELECT * FROM ({COUNTS}) n JOIN ({COLUMNS}) c USING (table_name)",
    ),
    "s5_describe_table": Scenario(
        describe_orders,
        """
        SELECT column_name, column_type AS data_type, "null" = 'YES' AS nullable,
               CAST(row_number() OVER () AS INTEGER) AS position,
               (SELECT COUNT(*) FROM orders) AS row_count
        FROM (DESCRIBE orders)""",
    ),
    "s6_row_count": Scenario(
        lambda spark, d: C.row_count(load(spark, d, "lineitem")),
        "SELECT COUNT(*) AS row_count FROM lineitem",
    ),
    "s8_filtered_preview": Scenario(
        lambda spark, d: previewed(
            orders(spark, d).where("o_orderstatus = 'F'").orderBy("o_orderkey"), 50
        ),
        "SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 51",
    ),
    "s9_insert_values": Scenario(
        insert_values,
        """
        SELECT o_orderstatus, COUNT(*) AS n,
               CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
               COUNT(o_orderpriority) AS with_priority
        FROM (
            SELECT o_orderstatus, o_totalprice, o_orderpriority FROM orders
            UNION ALL
            SELECT * FROM (VALUES ('N', 10.25, NULL), ('N', 20.5, NULL), ('F', 0.25, NULL))
        )
        GROUP BY o_orderstatus""",
    ),
    "q1_filter_group_sort": Scenario(user_query(Q1, "orders"), Q1),
    "j1_inner_join_select": Scenario(user_query(J1, "orders", "customer"), J1),
    "a3_cte_filter": Scenario(
        user_query(A3, "orders", for_spark=lambda sql: sql.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")),
        A3,
    ),
}
