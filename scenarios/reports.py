"""Suites, run summaries, aggregates behind the checks, and the data dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drydock.functions.dictionary import describe_columns, update_dictionary
from drydock.operators import categorical, integrity, numeric, volume
from drydock.operators import transforms as T
from drydock.operators.check import Check
from drydock.plans.ledger import Ledger, run_summary
from drydock.plans.runner import evaluate, plan_suite, run_checks
from drydock.plans.sandbox import SandboxStore
from drydock.plans.suites import CheckSpec, SavedSuites
from drydock.workspace import fresh_path
from scenarios.base import (
    RELABELLED,
    TRIMMED,
    Scenario,
    load,
    marked_up,
    orders,
    relabelled,
    trimmed,
)
from scenarios.checks import (
    LOST_KEYS,
    ORDERS,
    bounds_sql,
    counts_sql,
    drift_sql,
    new_values_sql,
    orphans_sql,
    pair,
    shift_sql,
)
from scenarios.sandboxes import RESULTS_LOG, results_log


def changed(df):
    """Relabelled statuses and lost cheap orders in one sandbox."""
    return trimmed(relabelled(df))


CHANGED = f"""SELECT * FROM ({RELABELLED})
    WHERE NOT (o_orderpriority = '5-LOW' AND o_totalprice < 100000)"""


def suite(customers):
    """Scalar, category, key and bespoke checks, one of which cannot run."""
    return [
        volume.row_count_match(),
        volume.row_count_comparison(),
        numeric.sum_comparison("o_totalprice", scale=2),
        numeric.min_max_bounds("o_totalprice"),
        categorical.value_set_drift("o_orderstatus"),
        categorical.distribution_shift("o_orderstatus"),
        integrity.uniqueness_on_keys("o_orderkey"),
        integrity.foreign_key_integrity("o_custkey", customers, "c_custkey"),
        integrity.referential_completeness("o_orderkey"),
        volume.new_rows_inspection("o_orderkey"),
        Check("no_column", lambda _prod, sbx: T.update(sbx, {"o_missing": 1}), "cannot run"),
    ]


def run_suite(spark, sf_dir):
    prod = orders(spark, sf_dir)
    return plan_suite(prod, changed(prod), suite(load(spark, sf_dir, "customer")))


def saved_suite(spark, sf_dir):
    """A suite saved for a sandbox and run by its name in another session.

    The sandbox's version was written with the suite's scalar measures, so these checks do not read it.
    """
    root, prod = fresh_path(spark, "saved"), orders(spark, sf_dir)
    specs = [
        CheckSpec("row_count_match"),
        CheckSpec("row_count_comparison"),
        CheckSpec("sum_comparison", {"column": "o_totalprice", "scale": 2}),
        CheckSpec("min_max_bounds", {"column": "o_totalprice"}),
        CheckSpec("value_set_drift", {"column": "o_orderstatus"}),
        CheckSpec("distribution_shift", {"column": "o_orderstatus"}),
        CheckSpec("uniqueness_on_keys", {"keys": ["o_orderkey"]}),
        CheckSpec("foreign_key_integrity", {"fk": "o_custkey", "referenced": "customer", "pk": "c_custkey"}),
        CheckSpec("referential_completeness", {"key": "o_orderkey"}),
        CheckSpec("new_rows_inspection", {"key": "o_orderkey"}),
    ]
    measured = [numeric.sum_comparison("o_totalprice", scale=2), numeric.min_max_bounds("o_totalprice"), volume.row_count_match()]
    store = SandboxStore(spark, root, profile=measured)
    name = store.commit(store.create("orders", prod), changed(prod)).sandbox_name
    SavedSuites(store).save(name, specs)
    later = spark.newSession()
    tables = {"orders": orders(later, sf_dir), "customer": load(later, sf_dir, "customer")}
    SavedSuites(SandboxStore(later, root)).run(name, tables)
    results = Ledger(spark, root).read("quality_results")
    return results.select("check", "status", "expected", "result", "detail", "sandbox_version")


def run_failing_suite(spark, sf_dir):
    """Recorded results of a suite in which one check fails only when it runs."""
    prod = orders(spark, sf_dir)
    breaks = F.raise_error(F.concat(F.lit("odd order "), F.max("o_orderkey").cast("string")))
    checks = [
        volume.row_count_match(),
        Check("at_run_time", lambda _prod, sbx: sbx.agg(breaks.cast("string").alias("status"))),
        integrity.referential_completeness("o_orderkey"),
    ]
    root = fresh_path(spark, "suites")
    results = run_checks(
        prod, trimmed(prod), checks, "sbx_orders", "orders", Ledger(spark, root), sandbox_version=2
    )
    # Of the recorded error, which names Spark's call as well, what the check itself raised.
    raised = F.nullif(F.regexp_extract("detail", r"odd order \d+", 0), F.lit(""))
    first = F.regexp_extract("detail", r"^\D*\d+", 0)
    return results.select(
        "check", "status", "definition", "sandbox_version", F.coalesce(raised, first).alias("detail")
    )


def evaluate_checks(spark, sf_dir):
    """Status, row and failure counts of results in either style, graded on the cluster."""
    prod = orders(spark, sf_dir)
    sbx = changed(prod)
    results = {
        "clean": integrity.uniqueness_on_keys("o_orderkey").rows(prod, sbx),
        "violations": integrity.null_check("o_orderstatus").rows(prod, sbx),
        "status_rows": categorical.distribution_shift("o_orderstatus").rows(prod, sbx),
        "any_case": sbx.select(F.lower(F.lit("FAIL")).alias("STATUS")),
        "null_status": sbx.select(F.col("o_orderstatus").alias("Status")),
        "drift": numeric.mean_drift("o_totalprice", scale=2).rows(prod, marked_up(prod)),
    }
    graded = [
        evaluate(rows).select(F.lit(name).alias("name"), "*") for name, rows in results.items()
    ]
    return reduce(DataFrame.unionByName, graded)


def text_sql(*columns):
    parts = [f"'{c}=' || COALESCE(CAST({c} AS VARCHAR), 'None')" for c in columns]
    return " || ', ' || ".join(parts)


def graded_sql(position, name, expected, rows, columns, order, status=True):
    """One graded check: `rows` is its SQL, quoted in the given order."""
    failing = "status = 'FAIL'" if status else "TRUE"
    text = text_sql(*columns)

    def quote(limit, condition):
        return f"""(SELECT string_agg(t, '; ' ORDER BY rn)
                || CASE WHEN MAX(n) > {limit} THEN ' ... (' || CAST(MAX(n) - {limit} AS VARCHAR)
                   || ' more rows)' ELSE '' END
            FROM (SELECT {text} AS t, row_number() OVER (ORDER BY {order}) AS rn,
                         COUNT(*) OVER () AS n FROM r_{position} WHERE {condition})
            WHERE rn <= {limit})"""

    return f"r_{position} AS ({rows})", f"""
        SELECT CAST({position} AS INTEGER) AS position, '{name}' AS "check",
               CASE WHEN EXISTS (SELECT 1 FROM r_{position} WHERE {failing})
                    THEN 'FAIL' ELSE 'PASS' END AS status,
               '{expected}' AS expected,
               COALESCE({quote(10, "TRUE")}, '(no violations found)') AS result,
               COALESCE({quote(3, failing)}, '') AS detail"""


COUNT_COLUMNS = ("prod_row_count", "sbx_row_count", "row_diff", "pct_change", "status")


GRADED = [
    graded_sql(0, "row_count_match", "row counts match", counts_sql(0), COUNT_COLUMNS, "1"),
    graded_sql(1, "row_count_comparison", "row count within 10% of production", counts_sql(10),
               COUNT_COLUMNS, "1"),
    graded_sql(2, "sum_comparison", "sum of o_totalprice within 10% of production", drift_sql("sum", "o_totalprice"),
                              ("prod_sum", "sbx_sum", "drift_pct", "status"), "1"),
    graded_sql(3, "min_max_bounds",
               "o_totalprice stays within production''s range (maximum x 1.1)",
               bounds_sql("o_totalprice"),
               ("prod_min", "prod_max", "sbx_min", "sbx_max", "status"), "1"),
    graded_sql(4, "value_set_drift", "no new values of o_orderstatus",
               new_values_sql("o_orderstatus"), ("new_value", "issue"),
               "new_value NULLS FIRST", status=False),
    graded_sql(5, "distribution_shift", "shares of o_orderstatus within 5 points of production",
               shift_sql("o_orderstatus"),
               ("category_value", "prod_pct", "sbx_pct", "shift_pct", "status"),
               "shift_pct DESC, category_value NULLS FIRST, prod_pct"),
    graded_sql(6, "uniqueness_on_keys", "(o_orderkey) is unique",
               "SELECT o_orderkey AS duplicate_value, COUNT(*) AS occurrences FROM sbx"
               " GROUP BY o_orderkey HAVING COUNT(*) > 1",
               ("duplicate_value", "occurrences"), "occurrences DESC, duplicate_value", False),
    graded_sql(7, "foreign_key_integrity", "every o_custkey exists as c_custkey",
               orphans_sql("sbx", "o_custkey", "customer", "c_custkey"),
               ("orphaned_fk_value", "orphaned_count"), "orphaned_count DESC", False),
    graded_sql(8, "referential_completeness", "no o_orderkey lost",
               LOST_KEYS.replace("ORDER BY o_orderkey LIMIT 50", ""),
               ("missing_from_sandbox",), "missing_from_sandbox", False),
    graded_sql(9, "new_rows_inspection", "rows added by the change, for review",
               "SELECT *, 'PASS' AS status FROM sbx"
               " WHERE NOT EXISTS (SELECT 1 FROM prod WHERE prod.o_orderkey = sbx.o_orderkey)",
               ("o_orderkey", "status"), "o_orderkey"),
]
SUITE_SQL = (
    f"{pair(ORDERS, CHANGED)}, "
    + ", ".join(rows for rows, _ in GRADED)
    + " UNION ALL ".join(graded for _, graded in GRADED)
    + """ UNION ALL SELECT 10, 'no_column', 'FAIL', 'cannot run',
        'Query error: columns not in the table: [''o_missing'']',
        'columns not in the table: [''o_missing'']'"""
)

EVALUATE_SQL = f"""
    {pair(ORDERS, CHANGED)},
    shift AS ({shift_sql("o_orderstatus")}),
    counted AS (
        SELECT 'clean' AS name, COUNT(*) AS n_rows, COUNT(*) AS n_failed
        FROM (SELECT o_orderkey FROM sbx GROUP BY o_orderkey HAVING COUNT(*) > 1)
        UNION ALL
        SELECT 'violations', COUNT(*), COUNT(*) FROM sbx WHERE o_orderstatus IS NULL
        UNION ALL
        SELECT 'status_rows', COUNT(*), COUNT(*) FILTER (WHERE status = 'FAIL') FROM shift
        UNION ALL
        SELECT 'any_case', COUNT(*), COUNT(*) FROM sbx
        UNION ALL
        SELECT 'null_status', COUNT(*), 0 FROM sbx
        UNION ALL
        SELECT 'drift', 1, 0
    )
    SELECT name, CASE WHEN n_failed > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n_rows, n_failed
    FROM counted"""


def share_of_total(spark, sf_dir):
    counts = load(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n")
    )
    (share,) = categorical.share_of_total(counts, "n")
    return counts.select("event_type", "n", share.alias("pct"))


def top_violations(spark, sf_dir):
    check = integrity.uniqueness_on_keys("l_orderkey", "l_linenumber")
    return check.rows(None, load(spark, sf_dir, "lineitem")).limit(20)


# Name endings that together reach every rule of the dictionary, and none.
ENDINGS = (
    "_id _status _amount _unit_price _shipped_at _due_date _start_time _type _kind _flag _pct"
    " _tax_rate _count _title _email _phone_no _total_count _description _ratio _value _status_id"
    " _created_at _STATUS _Label _code _notes"
).split()
WHOLE = (
    "id status created_at updated_at deleted_on creation_date last_updated qty count_items"
    " is_open has_parts country postal_code Region address quantity"
).split()


def warehouse_columns(parts):
    """A column catalog derived from the parts: the size selects the ending of the name."""
    n = len(ENDINGS)
    stem = F.replace("p_name", F.lit(" "), F.lit("_"))
    size = F.col("p_size")
    ending = F.get(F.array(*[F.lit(e) for e in ENDINGS]), size - 1)
    whole = F.get(F.array(*[F.lit(w) for w in WHOLE]), size - 1 - n)
    name = F.when(size <= n, F.concat(stem, ending)).otherwise(F.coalesce(whole, stem))
    return parts.select(
        F.concat(F.lit("t_"), F.col("p_partkey").cast("string")).alias("table_name"),
        name.alias("column_name"),
        F.lit("VARCHAR").alias("data_type"),
    )


def sql_list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


WAREHOUSE_COLUMNS = f"""
    SELECT 't_' || CAST(p_partkey AS VARCHAR) AS table_name,
           CASE WHEN p_size <= {len(ENDINGS)}
                THEN replace(p_name, ' ', '_') || {sql_list(ENDINGS)}[p_size]
                ELSE COALESCE({sql_list(WHOLE)}[p_size - {len(ENDINGS)}], replace(p_name, ' ', '_'))
           END AS column_name,
           'VARCHAR' AS data_type, p_retailprice
    FROM part"""


# Written out by hand, so that a wrong word or order in the rules shows.
DESCRIPTION = """
    CASE
    WHEN n = 'id' THEN 'Unique identifier for this record.'
    WHEN n LIKE '%\\_id' ESCAPE '\\'
        THEN 'Reference to the associated ' || replace(substring(n, 1, length(n) - 3), '_', ' ') || '.'
    WHEN n = 'status' OR n LIKE '%\\_status' ESCAPE '\\' THEN 'Current status of the record.'
    WHEN regexp_matches(n, 'amount|price|cost|revenue|total|value')
        THEN 'Monetary value in the record''s currency.'
    WHEN n IN ('created_at', 'created_on', 'creation_date') THEN 'Timestamp when the record was created.'
    WHEN n IN ('updated_at', 'modified_at', 'last_updated')
        THEN 'Timestamp of the most recent update to this record.'
    WHEN n IN ('deleted_at', 'deleted_on') THEN 'Soft-delete timestamp; NULL when the record is active.'
    WHEN regexp_matches(n, '_(at|date|time)$')
        THEN 'Timestamp recording when '
             || trim(replace(regexp_replace(regexp_replace(regexp_replace(
                    n, '_at', '', 'g'), '_date', '', 'g'), '_time', '', 'g'), '_', ' '))
             || ' occurred.'
    WHEN regexp_matches(n, 'type|kind|category') THEN 'Categorical classification of the record.'
    WHEN regexp_matches(n, '^is_|^has_|flag') THEN 'Boolean flag.'
    WHEN regexp_matches(n, 'pct|percent|rate|ratio') THEN 'Ratio or percentage value.'
    WHEN n IN ('count', 'qty', 'quantity') OR regexp_matches(n, '_count$|^count_') THEN 'Numeric count.'
    WHEN regexp_matches(n, 'name|title|label|desc') THEN 'Human-readable label or name.'
    WHEN regexp_matches(n, 'email|phone|address') THEN 'Contact field: ' || replace(n, '_', ' ') || '.'
    WHEN n IN ('country', 'region', 'city', 'state', 'zip', 'postal_code')
        THEN 'Geographic field: ' || replace(n, '_', ' ') || '.'
    ELSE '_What does `' || column_name || '` represent? What values can it have?_' END"""


def documented_columns(parts):
    """People have described the columns of the cheaper parts, in capitals."""
    return warehouse_columns(parts.where("p_retailprice < 1000")).select(
        "table_name", F.upper("column_name").alias("column_name"), "data_type",
        F.concat(F.lit("Written by hand for "), "table_name").alias("description"),
    )


def dictionary_update(spark, sf_dir):
    parts = load(spark, sf_dir, "part")
    return update_dictionary(warehouse_columns(parts), documented_columns(parts))


SCENARIOS = {
    "r1_evaluate_checks": Scenario(evaluate_checks, EVALUATE_SQL),
    "r3_run_suite": Scenario(run_suite, SUITE_SQL),
    "r3_saved_suite": Scenario(
        saved_suite,
        f"{pair(ORDERS, CHANGED)}, "
        + ", ".join(rows for rows, _ in GRADED)
        + ' SELECT "check", status, expected, result, detail, 1 AS sandbox_version FROM ('
        + " UNION ALL ".join(graded for _, graded in GRADED)
        + ")",
    ),
    "r3_suite_failing_at_run_time": Scenario(
        run_failing_suite,
        f"""
        WITH lost AS (SELECT o_orderkey FROM orders
                      WHERE o_orderpriority = '5-LOW' AND o_totalprice < 100000),
        kept AS ({TRIMMED})
        SELECT * FROM (VALUES
            ('row_count_match', 'FAIL', 'row_count_comparison(pct=0)',
             'prod_row_count=' || CAST((SELECT COUNT(*) FROM orders) AS VARCHAR)),
            ('at_run_time', 'FAIL', '', 'odd order ' || CAST((SELECT MAX(o_orderkey) FROM kept) AS VARCHAR)),
            ('referential_completeness', 'FAIL',
             'referential_completeness(key=''o_orderkey'', limit=50)',
             'missing_from_sandbox=' || CAST((SELECT MIN(o_orderkey) FROM lost) AS VARCHAR))
        ) v("check", status, definition, detail), (SELECT 2 AS sandbox_version)""",
    ),
    "r4_run_summary": Scenario(
        lambda spark, d: run_summary(results_log(load(spark, d, "events"))),
        f"""
        SELECT run_id, COUNT(*) AS checks, COUNT(*) FILTER (WHERE status <> 'PASS') AS failed,
               COUNT(*) FILTER (WHERE status <> 'PASS') = 0 AS all_passed
        FROM ({RESULTS_LOG}) GROUP BY run_id""",
    ),
    "r5_data_dictionary": Scenario(
        lambda spark, d: describe_columns(warehouse_columns(load(spark, d, "part"))),
        f"""
        SELECT table_name, column_name, data_type, {DESCRIPTION} AS description
        FROM (SELECT *, lower(column_name) AS n FROM ({WAREHOUSE_COLUMNS}))""",
    ),
    "r6_dictionary_new_columns": Scenario(
        dictionary_update,
        f"""
        SELECT table_name, upper(column_name) AS column_name, data_type,
               'Written by hand for ' || table_name AS description
        FROM ({WAREHOUSE_COLUMNS}) WHERE p_retailprice < 1000
        UNION ALL
        SELECT table_name, column_name, data_type, {DESCRIPTION}
        FROM (SELECT *, lower(column_name) AS n FROM ({WAREHOUSE_COLUMNS}))
        WHERE NOT p_retailprice < 1000""",
    ),
    "a1_share_of_total": Scenario(
        share_of_total,
        """
        SELECT event_type, COUNT(*) AS n,
               ROUND(COUNT(*) * 100.0::DOUBLE / SUM(COUNT(*)) OVER (), 2) AS pct
        FROM events GROUP BY event_type""",
    ),
    "a2_top_k_violations": Scenario(
        top_violations,
        """
        SELECT l_orderkey, l_linenumber, COUNT(*) AS occurrences
        FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1
        ORDER BY occurrences DESC, l_orderkey, l_linenumber LIMIT 20""",
    ),
}
