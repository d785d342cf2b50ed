"""Changes to a sandbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from drydock.operators import transforms as T
from scenarios.base import (
    DUPLICATED,
    EXTENDED,
    MARKED_UP,
    TRIMMED,
    Scenario,
    duplicated,
    extended,
    load,
    marked_up,
    orders,
    trimmed,
)

AS_OF = "TIMESTAMP{ntz} '2001-08-01 00:00:00'"


def cancel_old(spark, sf_dir):
    as_of = F.expr(AS_OF.format(ntz="_NTZ"))
    old = (F.col("o_orderstatus") == "P") & (
        F.col("o_orderdate") < as_of - F.expr("INTERVAL 30 DAYS")
    )
    return T.update(orders(spark, sf_dir), {"o_orderstatus": "C"}, old)


def set_to_total(spark, sf_dir):
    """Every finished order gets the table's total: a scalar subquery over the old rows."""
    df = orders(spark, sf_dir)
    total = df.agg(F.sum(T.money("o_totalprice")).cast("double")).scalar()
    return T.update(df, {"o_totalprice": total}, F.col("o_orderstatus") == "F")


def merge_source(df):
    """New prices for urgent orders, as many new orders, and withdrawn low ones."""
    price = F.round(T.money("o_totalprice") * F.lit("0.90").cast("decimal(3,2)"), 2).cast("double")
    changed = df.where("o_orderpriority = '1-URGENT'").select(
        "o_orderkey", "o_custkey", price.alias("o_totalprice"), F.lit(False).alias("withdrawn")
    )
    added = changed.withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    withdrawn = df.where("o_orderpriority = '5-LOW' AND o_totalprice < 50000").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.lit(True).alias("withdrawn")
    )
    return changed.unionByName(added).unionByName(withdrawn)


def merge_orders(spark, sf_dir, sparse=False):
    df = orders(spark, sf_dir)
    return T.merge(
        df,
        merge_source(df),
        on=["o_orderkey"],
        update={"o_totalprice": F.col("s.o_totalprice"), "o_orderstatus": F.lit("M")},
        delete_where=F.col("s.withdrawn"),
        insert=True,
        leave_out=["withdrawn"],
        sparse=sparse,
    )


MERGE_SOURCE = """
    SELECT o_orderkey, o_custkey, CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2))
           * CAST(0.90 AS DECIMAL(3,2)), 2) AS DOUBLE) AS o_totalprice, FALSE AS withdrawn
    FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL
    SELECT -o_orderkey - 1, o_custkey, CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2))
           * CAST(0.90 AS DECIMAL(3,2)), 2) AS DOUBLE), FALSE
    FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL
    SELECT o_orderkey, o_custkey, o_totalprice, TRUE
    FROM orders WHERE o_orderpriority = '5-LOW' AND o_totalprice < 50000"""


def premium_discount(spark, sf_dir):
    """Customers of expensive orders, and the discount those orders get.

    The customers are chosen from the orders before the discount.
    """
    df, customers = orders(spark, sf_dir), load(spark, sf_dir, "customer")
    expensive = F.col("o_totalprice") > 490000
    price = F.round(T.money("o_totalprice") * F.lit("0.90").cast("decimal(3,2)"), 2)
    discounted = T.update(df, {"o_totalprice": price}, expensive)
    flagged = T.flag_members(
        customers, df.where(expensive), {"c_custkey": "o_custkey"}, "is_premium"
    )
    spent = discounted.groupBy("o_custkey").agg(
        F.sum(T.money("o_totalprice")).cast("double").alias("spent")
    )
    return flagged.join(spent, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_name", "is_premium", "spent"
    )


def nation_into_segment(spark, sf_dir):
    """An UPDATE whose value comes from another table."""
    return T.update_from_join(
        load(spark, sf_dir, "customer"),
        load(spark, sf_dir, "nation").where("n_regionkey <> 0"),
        on={"c_nationkey": "n_nationkey"},
        set={"c_mktsegment": F.concat_ws("/", F.col("t.c_mktsegment"), F.col("s.n_name"))},
        order=["n_nationkey"],
    )


def dear_orders_to_lines(spark, sf_dir):
    """An UPDATE of few lines of a large table by another large table."""
    return T.update_from_join(
        load(spark, sf_dir, "lineitem"),
        orders(spark, sf_dir).where("o_totalprice > 490000"),
        on={"l_orderkey": "o_orderkey"},
        set={"l_discount": 0.25, "l_linestatus": F.col("s.o_orderstatus")},
        order=["o_orderstatus"],
        sparse=True,
    )


MERGED = f"""
        WITH source AS ({MERGE_SOURCE})
        SELECT o.o_orderkey, o.o_custkey,
               CASE WHEN s.o_orderkey IS NULL THEN o.o_orderstatus ELSE 'M' END AS o_orderstatus,
               COALESCE(s.o_totalprice, o.o_totalprice) AS o_totalprice,
               o.o_orderdate, o.o_orderpriority
        FROM orders o LEFT JOIN source s USING (o_orderkey)
        WHERE s.o_orderkey IS NULL OR NOT s.withdrawn
        UNION ALL
        SELECT s.o_orderkey, s.o_custkey, NULL, s.o_totalprice, NULL, NULL
        FROM source s
        WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = s.o_orderkey)"""

SCENARIOS = {
    "t1_update_markup": Scenario(lambda spark, d: marked_up(orders(spark, d)), MARKED_UP),
    "t2_update_by_age": Scenario(
        cancel_old,
        f"""
        SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderstatus = 'P'
                     AND o_orderdate < {AS_OF.format(ntz="")} - INTERVAL 30 DAYS
                    THEN 'C' ELSE o_orderstatus END AS o_orderstatus,
               o_totalprice, o_orderdate, o_orderpriority
        FROM orders""",
    ),
    "t3_update_scalar_subquery": Scenario(
        set_to_total,
        """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderstatus = 'F'
                    THEN (SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders)
                    ELSE o_totalprice END AS o_totalprice,
               o_orderdate, o_orderpriority
        FROM orders""",
    ),
    "t4_delete_where": Scenario(lambda spark, d: trimmed(orders(spark, d)), TRIMMED),
    "t5_insert_select": Scenario(lambda spark, d: extended(orders(spark, d)), EXTENDED),
    "t6_merge_upsert": Scenario(
        merge_orders,
        MERGED,
    ),
    "t6_merge_sparse": Scenario(
        lambda spark, d: merge_orders(spark, d, sparse=True),
        MERGED,
    ),
    "t7_add_column": Scenario(
        lambda spark, d: T.add_column(orders(spark, d), "region", "string", "EMEA"),
        "SELECT *, 'EMEA' AS region FROM orders",
    ),
    "t8_multi_table_premium": Scenario(
        premium_discount,
        """
        WITH premium AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 490000),
        spent AS (
            SELECT o_custkey, CAST(SUM(CAST(CASE WHEN o_totalprice > 490000
                       THEN ROUND(CAST(o_totalprice AS DECIMAL(18,2))
                                  * CAST(0.90 AS DECIMAL(3,2)), 2)
                       ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DECIMAL(18,2))) AS DOUBLE)
                   AS spent
            FROM orders GROUP BY o_custkey
        )
        SELECT c_custkey, c_name, p.o_custkey IS NOT NULL AS is_premium, spent
        FROM customer
        LEFT JOIN premium p ON c_custkey = p.o_custkey
        LEFT JOIN spent s ON c_custkey = s.o_custkey""",
    ),
    "t9_update_from_join": Scenario(
        nation_into_segment,
        """
        SELECT c_custkey, c_name, c_nationkey, c_acctbal,
               CASE WHEN n_nationkey IS NULL THEN c_mktsegment
                    ELSE c_mktsegment || '/' || n_name END AS c_mktsegment
        FROM customer
        LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) ON c_nationkey = n_nationkey""",
    ),
    "t9_update_sparse": Scenario(
        dear_orders_to_lines,
        """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
               CASE WHEN o_orderkey IS NULL THEN l_discount ELSE 0.25 END AS l_discount,
               l_tax, l_returnflag, COALESCE(o_orderstatus, l_linestatus) AS l_linestatus, l_shipdate
        FROM lineitem
        LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 490000) ON l_orderkey = o_orderkey""",
    ),
    "t10_deduplicate": Scenario(
        lambda spark, d: T.deduplicate(
            load(spark, d, "lineitem"),
            ["l_orderkey", "l_linenumber"],
            ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_tax", "l_discount"],
        ),
        """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
               l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
        FROM (
            SELECT *, row_number() OVER (
                PARTITION BY l_orderkey, l_linenumber
                ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_tax, l_discount
            ) AS rn FROM lineitem
        ) WHERE rn = 1""",
    ),
    "t10_deduplicate_restores": Scenario(
        lambda spark, d: T.deduplicate(
            duplicated(orders(spark, d)), ["o_orderkey"], ["o_orderdate"]
        ),
        f"SELECT DISTINCT * FROM ({DUPLICATED})",
    ),
    "t10_deduplicate_texts": Scenario(
        lambda spark, d: T.deduplicate(load(spark, d, "documents"), ["text"], ["doc_id"]),
        """
        SELECT doc_id, text, lang, source, n_chars FROM (
            SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents
        ) WHERE rn = 1""",
    ),
}
