"""Quality checks: production orders against changed versions of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drydock.operators import categorical, integrity, numeric, volume
from drydock.operators import transforms as T
from drydock.plans.query import sql_check
from scenarios.base import (
    DUPLICATED,
    EXTENDED,
    MARKED_UP,
    ORPHANED,
    RELABELLED,
    TRIMMED,
    Scenario,
    duplicated,
    extended,
    load,
    marked_up,
    orders,
    orphaned,
    relabelled,
    trimmed,
)


def on_orders(check, change):
    def run(spark, sf_dir):
        prod = orders(spark, sf_dir)
        return check.rows(prod, change(prod))

    return run


def unchanged(df):
    return df


def overdrawn(spark, sf_dir):
    """All customers as debtors, and the same with a fifth of the debt forgiven: a negative base."""
    prod = load(spark, sf_dir, "customer").withColumn("c_acctbal", -F.abs("c_acctbal"))
    less = F.round(
        F.col("c_acctbal").cast("decimal(18,2)") * F.lit("0.80").cast("decimal(3,2)"), 2
    ).cast("double")
    return prod, prod.withColumn("c_acctbal", less)


OVERDRAWN = """
    WITH prod AS (SELECT * REPLACE (-ABS(c_acctbal) AS c_acctbal) FROM customer),
    sbx AS (
        SELECT * REPLACE (CAST(ROUND(CAST(c_acctbal AS DECIMAL(18,2))
                          * CAST(0.80 AS DECIMAL(3,2)), 2) AS DOUBLE) AS c_acctbal)
        FROM prod
    )"""


def corrupted(df):
    """Odd values in a few orders: not a number, infinite, and beyond 64-bit cents."""
    price = F.when(F.col("o_orderkey") % 1000 == 1, F.lit(1e17)).otherwise(F.col("o_totalprice"))
    price = F.when(F.col("o_orderkey") % 1000 == 2, F.lit(float("inf"))).otherwise(price)
    return T.update(df, {"o_totalprice": price})


def nan_and_infinite(check, kind):
    """The verdict over prices of which some are infinite and then some NaN as well."""
    def run(spark, sf_dir):
        prod = orders(spark, sf_dir)
        infinite = corrupted(prod)
        nan = T.update(infinite, {"o_totalprice": float("nan")}, F.col("o_orderkey") % 1000 == 3)
        huge = infinite.where(F.col("o_totalprice") < float("inf"))
        cases = {"huge": huge, "infinite": infinite, "nan": nan}
        rows = [
            check.rows(prod, sbx).select(
                F.lit(name).alias("case"),
                F.col(f"prod_{kind}"),
                F.isnan(f"sbx_{kind}").alias("is_nan"),
                (F.col(f"sbx_{kind}") == float("inf")).alias("is_infinite"),
                F.when(F.col(f"sbx_{kind}") < 1e300, F.col(f"sbx_{kind}")).alias(f"sbx_{kind}"),
                "status",
            )
            for name, sbx in cases.items()
        ]
        return reduce(DataFrame.unionByName, rows)

    return run


def nan_and_infinite_sql(kind):
    total = "CAST(SUM(CAST({} AS DECIMAL(28,2))) AS DOUBLE)"
    value = total if kind == "sum" else total + " / COUNT(*)"
    huge = "CASE WHEN o_orderkey % 1000 = 1 THEN 1e17::DOUBLE ELSE o_totalprice END"
    prod = f"(SELECT {value.format('o_totalprice')} FROM orders)"
    sbx = f"(SELECT {value.format(huge)} FROM orders WHERE o_orderkey % 1000 <> 2)"
    return f"""
        SELECT "case", {prod} AS prod_{kind}, "case" = 'nan' AS is_nan, "case" = 'infinite' AS is_infinite,
               CASE WHEN "case" = 'huge' THEN {sbx} END AS sbx_{kind}, 'FAIL' AS status
        FROM (VALUES ('huge'), ('infinite'), ('nan')) v("case")"""


def repeated_keys(df):
    """Every key three times over, in rows that differ elsewhere."""
    copies = [df.withColumn("o_custkey", F.col("o_custkey") + i) for i in range(3)]
    return reduce(DataFrame.unionByName, copies).withColumn("o_orderkey", -F.col("o_orderkey") - 1)


REPEATED = """
    SELECT * REPLACE (-o_orderkey - 1 AS o_orderkey, o_custkey + i AS o_custkey)
    FROM orders, range(3) t(i)"""


def long_listing(spark, sf_dir):
    """A listing longer than a thousand rows, cut inside the rows of one key."""
    prod = orders(spark, sf_dir)
    sbx = prod.unionByName(repeated_keys(prod))
    return volume.new_rows_inspection("o_orderkey", limit=1003).rows(prod, sbx)


def long_lost_listing(spark, sf_dir):
    prod = orders(spark, sf_dir)
    return integrity.referential_completeness("o_orderkey", limit=1003).rows(repeated_keys(prod), prod)


def sql_sum(column):
    return f"CAST(SUM(CAST({column} AS DECIMAL(18,2))) AS DOUBLE)"


def drift_sql(kind, column, base="{p}"):
    """The drift check over CTEs `prod` and `sbx`."""
    total = sql_sum(column)
    value = total if kind == "sum" else f"{total} / NULLIF(COUNT({column}), 0)"
    p, s = f"prod_{kind}", f"sbx_{kind}"
    return f"""
        SELECT {p}, {s}, ROUND(drift, 2) AS drift_pct,
               IF(COALESCE(drift <= 10, FALSE), 'PASS', 'FAIL') AS status
        FROM (
            SELECT *, ABS({s} - {p}) / NULLIF({base.format(p=p)}, 0) * 100 AS drift
            FROM (SELECT (SELECT {value} FROM prod) AS {p}, (SELECT {value} FROM sbx) AS {s})
        )"""


def pair(prod, sbx):
    return f"WITH prod AS ({prod}), sbx AS ({sbx})"


ORDERS = "SELECT * FROM orders"


def counts_sql(pct):
    return f"""
        SELECT prod_row_count, sbx_row_count, row_diff, ROUND(change, 2) AS pct_change,
               IF(COALESCE(ABS(change) <= {pct}, FALSE), 'PASS', 'FAIL') AS status
        FROM (
            SELECT *, sbx_row_count - prod_row_count AS row_diff,
                   row_diff * 100.0::DOUBLE / NULLIF(prod_row_count, 0) AS change
            FROM (SELECT (SELECT COUNT(*) FROM prod) AS prod_row_count,
                         (SELECT COUNT(*) FROM sbx) AS sbx_row_count)
        )"""


def row_count_sql(sbx, pct):
    return f"{pair(ORDERS, sbx)} {counts_sql(pct)}"


def bounds_sql(column):
    def bound(function, table):
        return f"(SELECT {function}({column}) FROM {table})"

    return f"""
        SELECT *, IF(COALESCE(prod_min <= sbx_min AND prod_max * 1.1::DOUBLE >= sbx_max, FALSE),
                     'PASS', 'FAIL') AS status
        FROM (SELECT {bound("MIN", "prod")} AS prod_min, {bound("MAX", "prod")} AS prod_max,
                     {bound("MIN", "sbx")} AS sbx_min, {bound("MAX", "sbx")} AS sbx_max)"""


def new_values_sql(column):
    return f"""
        SELECT DISTINCT {column} AS new_value, 'not present in production' AS issue
        FROM sbx WHERE NOT EXISTS (SELECT 1 FROM prod WHERE prod.{column} = sbx.{column})"""


def shift_sql(column):
    """Shares per side, brought together by a pivot in which NULL keeps its side."""
    return f"""
        SELECT category_value, prod_pct, sbx_pct, ROUND(ABS(prod_pct - sbx_pct), 2) AS shift_pct,
               IF(ABS(prod_pct - sbx_pct) > 5, 'FAIL', 'PASS') AS status
        FROM (
            SELECT v AS category_value,
                   COALESCE(MAX(pct) FILTER (WHERE side = 1), 0) AS prod_pct,
                   COALESCE(MAX(pct) FILTER (WHERE side = 2), 0) AS sbx_pct
            FROM (
                SELECT side, v, ROUND(n * 100.0::DOUBLE / SUM(n) OVER (PARTITION BY side), 2) AS pct
                FROM (SELECT side, v, COUNT(*) AS n
                      FROM (SELECT 1 AS side, {column} AS v FROM prod
                            UNION ALL SELECT 2, {column} FROM sbx)
                      GROUP BY side, v)
            )
            GROUP BY v, IF(v IS NULL, side, 0)
        )"""


def new_rows_sql(limit=""):
    return f"""{pair(ORDERS, EXTENDED)}
        SELECT *, 'PASS' AS status FROM sbx
        WHERE NOT EXISTS (SELECT 1 FROM prod WHERE prod.o_orderkey = sbx.o_orderkey) {limit}"""


def orphans_sql(children, fk, parents, pk):
    return f"""
        SELECT {fk} AS orphaned_fk_value, COUNT(*) AS orphaned_count FROM {children} child
        WHERE NOT EXISTS (SELECT 1 FROM {parents} parent WHERE parent.{pk} = child.{fk})
        GROUP BY {fk}"""


LOST_KEYS = """
    SELECT o_orderkey AS missing_from_sandbox FROM prod
    WHERE NOT EXISTS (SELECT 1 FROM sbx WHERE sbx.o_orderkey = prod.o_orderkey)
    ORDER BY o_orderkey LIMIT 50"""


BESPOKE = """
    SELECT s.o_orderpriority AS priority, p.n AS prod_n, s.n AS sbx_n,
           CASE WHEN s.n = p.n THEN 'PASS' ELSE 'FAIL' END AS status
    FROM (SELECT o_orderpriority, COUNT(*) AS n FROM sbx_orders GROUP BY o_orderpriority) s
    JOIN (SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority) p
      ON s.o_orderpriority = p.o_orderpriority"""


def null_profile(spark, sf_dir):
    return integrity.null_profile(relabelled(orders(spark, sf_dir)))


def unlabelled(spark, sf_dir):
    """Documents whose id has no label."""
    documents = load(spark, sf_dir, "documents")
    check = integrity.foreign_key_integrity("doc_id", load(spark, sf_dir, "labels"), "doc_id")
    return check.rows(documents, documents)


def lost_documents(spark, sf_dir):
    check = integrity.referential_completeness("doc_id", limit=None)
    return check.rows(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def orphan_check(spark, sf_dir):
    prod = orders(spark, sf_dir)
    check = integrity.foreign_key_integrity(
        "o_custkey", load(spark, sf_dir, "customer"), "c_custkey"
    )
    return check.rows(prod, orphaned(prod))


SCENARIOS = {
    "c1_row_count_comparison": Scenario(
        on_orders(volume.row_count_comparison(), extended), row_count_sql(EXTENDED, 10)
    ),
    "c2_new_rows_inspection": Scenario(
        on_orders(volume.new_rows_inspection("o_orderkey"), extended),
        new_rows_sql("ORDER BY o_orderkey LIMIT 50"),
    ),
    "c2_all_new_rows": Scenario(
        on_orders(volume.new_rows_inspection("o_orderkey", limit=None), extended), new_rows_sql()
    ),
    "c2_long_listing": Scenario(
        long_listing,
        f"""
        SELECT * EXCLUDE (i), 'PASS' AS status FROM (
            SELECT -o_orderkey - 1 AS o_orderkey, o_custkey + i AS o_custkey,
                   o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, i
            FROM orders, range(3) t(i)
        ) ORDER BY o_orderkey, o_custkey LIMIT 1003""",
    ),
    "c10_long_listing": Scenario(
        long_lost_listing,
        f"SELECT o_orderkey AS missing_from_sandbox FROM ({REPEATED}) ORDER BY o_orderkey LIMIT 1003",
    ),
    "c3_mean_drift_odd_values": Scenario(
        nan_and_infinite(numeric.mean_drift("o_totalprice", scale=2), "avg"), nan_and_infinite_sql("avg")
    ),
    "c4_sum_comparison_odd_values": Scenario(
        nan_and_infinite(numeric.sum_comparison("o_totalprice", scale=2), "sum"),
        nan_and_infinite_sql("sum"),
    ),
    "c3_mean_drift": Scenario(
        on_orders(numeric.mean_drift("o_totalprice", scale=2), marked_up),
        f"{pair(ORDERS, MARKED_UP)} {drift_sql('avg', 'o_totalprice')}",
    ),
    "c3_mean_drift_negative_base": Scenario(
        lambda spark, d: numeric.mean_drift("c_acctbal", scale=2).rows(*overdrawn(spark, d)),
        f"{OVERDRAWN} {drift_sql('avg', 'c_acctbal')}",
    ),
    "c4_sum_comparison": Scenario(
        on_orders(numeric.sum_comparison("o_totalprice", scale=2), marked_up),
        f"{pair(ORDERS, MARKED_UP)} {drift_sql('sum', 'o_totalprice')}",
    ),
    "c4_sum_comparison_abs_base": Scenario(
        lambda spark, d: numeric.sum_comparison(
            "c_acctbal", scale=2, abs_denominator=True
        ).rows(*overdrawn(spark, d)),
        f"{OVERDRAWN} {drift_sql('sum', 'c_acctbal', 'ABS({p})')}",
    ),
    "c5_min_max_bounds": Scenario(
        on_orders(numeric.min_max_bounds("o_totalprice"), marked_up),
        f"{pair(ORDERS, MARKED_UP)} {bounds_sql('o_totalprice')}",
    ),
    "c5_min_max_negative_maximum": Scenario(
        lambda spark, d: numeric.min_max_bounds("c_acctbal").rows(*overdrawn(spark, d)),
        f"{OVERDRAWN} {bounds_sql('c_acctbal')}",
    ),
    "c6_value_set_drift": Scenario(
        on_orders(categorical.value_set_drift("o_orderstatus"), relabelled),
        f"{pair(ORDERS, RELABELLED)} {new_values_sql('o_orderstatus')}",
    ),
    "c7_distribution_shift": Scenario(
        on_orders(categorical.distribution_shift("o_orderstatus"), relabelled),
        f"{pair(ORDERS, RELABELLED)} {shift_sql('o_orderstatus')}",
    ),
    "c7_distribution_shift_null_both": Scenario(
        lambda spark, d: categorical.distribution_shift("o_orderstatus").rows(
            relabelled(orders(spark, d)), trimmed(relabelled(orders(spark, d)))
        ),
        f"""{pair(RELABELLED, f'''SELECT * FROM ({RELABELLED})
            WHERE NOT (o_orderpriority = '5-LOW' AND o_totalprice < 100000)''')}
        {shift_sql('o_orderstatus')}""",
    ),
    "c8_uniqueness_on_keys": Scenario(
        lambda spark, d: integrity.uniqueness_on_keys("l_orderkey", "l_linenumber").rows(
            None, load(spark, d, "lineitem")
        ),
        """
        SELECT l_orderkey, l_linenumber, COUNT(*) AS occurrences
        FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""",
    ),
    "c8_uniqueness_single_key": Scenario(
        on_orders(integrity.uniqueness_on_keys("o_orderkey"), duplicated),
        f"""
        SELECT o_orderkey AS duplicate_value, COUNT(*) AS occurrences
        FROM ({DUPLICATED}) GROUP BY o_orderkey HAVING COUNT(*) > 1""",
    ),
    "c9_foreign_key_integrity": Scenario(
        orphan_check, orphans_sql(f"({ORPHANED})", "o_custkey", "customer", "c_custkey")
    ),
    "c9_documents_without_labels": Scenario(
        unlabelled, orphans_sql("documents", "doc_id", "labels", "doc_id")
    ),
    "c10_referential_completeness": Scenario(
        on_orders(integrity.referential_completeness("o_orderkey"), trimmed),
        f"{pair(ORDERS, TRIMMED)} {LOST_KEYS}",
    ),
    "c10_all_lost_keys": Scenario(
        lost_documents,
        """
        SELECT doc_id AS missing_from_sandbox FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    ),
    "c11_null_check": Scenario(
        on_orders(integrity.null_check("o_orderstatus"), relabelled),
        f"SELECT * FROM ({RELABELLED}) WHERE o_orderstatus IS NULL",
    ),
    "c11_null_profile": Scenario(
        null_profile,
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count FROM ({RELABELLED})"
            for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                      "o_orderpriority")
        ),
    ),
    "c12_row_count_match": Scenario(
        on_orders(volume.row_count_match(), trimmed), row_count_sql(TRIMMED, 0)
    ),
    "c13_bespoke_status_check": Scenario(
        on_orders(sql_check("per_priority", BESPOKE, "orders", "sbx_orders"), trimmed),
        f"WITH sbx_orders AS ({TRIMMED}) {BESPOKE}",
    ),
}
