"""Snapshots: clone, replace, truncate, and the state derived from the ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from drydock.operators import transforms as T
from drydock.operators.guard import ProductionWriteBlocked, guard_target, writable
from drydock.plans.ledger import latest_run_status
from drydock.plans.sandbox import SandboxStore
from drydock.sources.catalog import Catalog
from drydock.workspace import fresh_path
from scenarios.base import MARKED_UP, TRIMMED, Scenario, load, marked_up, orders, trimmed


def clone(table):
    def run(spark, sf_dir):
        store = SandboxStore(spark)
        return store.read(store.create(table, load(spark, sf_dir, table)))

    return run


def changes(spark, sf_dir):
    """The log of a sandbox changed by SQL expressions, with its statements for production."""
    store = SandboxStore(spark)
    sandbox = store.create("nation", load(spark, sf_dir, "nation"))
    sandbox = store.update(sandbox, {"n_name": "upper(n_name)"}, "n_regionkey > 1")
    sandbox = store.delete(sandbox, "n_nationkey = 2")
    log = store.transformations(sandbox.sandbox_name).select("seq", "operation", "prod_statement")
    return log.withColumn("n_rows", F.lit(sandbox.n_rows))


def replace(spark, sf_dir):
    """Two changes on top of a clone, chained and committed once."""
    store = SandboxStore(spark)
    sandbox = store.create("orders", orders(spark, sf_dir))
    sandbox = store.transform(sandbox, lambda df: trimmed(marked_up(df)), "REPLACE")
    store.vacuum(sandbox)
    return store.read(sandbox.sandbox_name)


def truncate(spark, sf_dir):
    """Row counts of the clone and of its truncated version."""
    store = SandboxStore(spark)
    sandbox = store.create("orders", orders(spark, sf_dir))
    before = store.read(sandbox)
    after = store.read(store.truncate(sandbox))
    return before.agg(F.count(F.lit(1)).alias("n_before")).withColumn(
        "n_after", after.agg(F.count(F.lit(1))).scalar()
    ).withColumn("n_columns", F.lit(len(after.columns)))


# How the names of a part are written, by its size: with and without prefix, schema and quotes.
NAME_FORMS = [
    "{p}", "sbx_{p}", "SBX_{p}", "analytics.{p}", "analytics.sbx_{p}", "`analytics`.`Sbx_{p}`", '"sbx_{p}"',
    "sbx_old.{p}", "old_sbx_{p}", "QG_quality_results", "{p}_qg_quality_results", "lake.analytics.`qg_Quality_results`",
]


def guarded(spark, sf_dir):
    """Which names may be written: by the column form for each part, by the guard for each form's first name."""
    forms = F.array(*[F.lit(form) for form in NAME_FORMS])
    number = F.pmod(F.col("p_size"), F.lit(len(NAME_FORMS)))
    name = F.replace(F.get(forms, number), F.lit("{p}"), F.concat(F.lit("part_"), F.col("p_partkey").cast("string")))
    names = load(spark, sf_dir, "part").select("p_partkey", number.alias("form"), name.alias("name"))
    passed = []
    for row in names.groupBy("form").agg(F.min("name").alias("name")).collect():
        try:
            passed.append((row["form"], guard_target(row["name"]) == row["name"]))
        except ProductionWriteBlocked:
            passed.append((row["form"], False))
    guard = spark.createDataFrame(passed, "form int, guard_passes boolean")
    return names.withColumn("may_be_written", writable(F.col("name"))).join(guard, "form").drop("form")


def lifecycle(spark, sf_dir):
    """A table before and after it is made; the latest sandbox of it; what is left when that is dropped."""
    root = fresh_path(spark, "lifecycle")
    catalog, table = Catalog(spark, f"db_{uuid.uuid4().hex}", root), orders(spark, sf_dir)
    existed = catalog.exists("orders")
    made = catalog.create("orders", table)
    store = SandboxStore(spark, root)
    store.create("orders", made)
    store.create("orders", trimmed(made))
    latest = store.latest_for("orders")
    shown = store.read(latest).agg(F.count(F.lit(1)).alias("latest_rows"), F.max("o_orderkey").alias("latest_key"))
    seen = shown.first()
    store.drop(latest)
    return store.current().agg(F.count(F.lit(1)).alias("left"), F.sum("n_rows").alias("rows_left")).select(
        F.lit(existed).alias("existed"), F.lit(catalog.exists("orders")).alias("exists_now"),
        F.lit(seen["latest_rows"]).alias("latest_rows"), F.lit(seen["latest_key"]).alias("latest_key"),
        "left", "rows_left",
    )


def results_log(events):
    """Check results read off the event table: one run per user and day."""
    day = F.to_date("ts").cast("string")
    return events.select(
        F.concat(F.lit("sbx_"), F.col("user_id").cast("string")).alias("sandbox_name"),
        F.concat_ws("/", F.col("user_id").cast("string"), day).alias("run_id"),
        F.col("event_type").alias("check"),
        F.when(F.col("event_type") == "error", "FAIL").otherwise("PASS").alias("status"),
        F.col("ts").alias("run_at"),
    )


RESULTS_LOG = """
    SELECT 'sbx_' || CAST(user_id AS VARCHAR) AS sandbox_name,
           CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS run_id,
           event_type AS "check",
           CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'PASS' END AS status,
           ts AS run_at
    FROM events"""


SCENARIOS = {
    "k1_sandbox_clone": Scenario(clone("lineitem"), "SELECT * FROM lineitem"),
    "k1_clone_array_column": Scenario(clone("embeddings"), "SELECT * FROM embeddings"),
    "k5_change_log": Scenario(
        changes,
        """
        SELECT seq, operation, prod_statement,
               (SELECT COUNT(*) FROM nation WHERE n_nationkey <> 2) AS n_rows
        FROM (VALUES
            (1, 'UPDATE', 'UPDATE analytics.nation SET n_name = upper(n_name) WHERE n_regionkey > 1'),
            (2, 'DELETE', 'DELETE FROM analytics.nation WHERE n_nationkey = 2')
        ) v(seq, operation, prod_statement)""",
    ),
    "k5_guarded_names": Scenario(
        guarded,
        f"""
        WITH forms AS (
            SELECT unnest([{", ".join(f"'{form}'" for form in NAME_FORMS)}]) AS form,
                   generate_subscripts(range({len(NAME_FORMS)}), 1) - 1 AS number),
        names AS (
            SELECT p_partkey, replace(form, '{{p}}', 'part_' || CAST(p_partkey AS VARCHAR)) AS name
            FROM part JOIN forms ON number = p_size % {len(NAME_FORMS)}),
        last AS (SELECT *, lower(translate(list_last(string_split(name, '.')), '`"', '')) AS bare FROM names)
        SELECT p_partkey, name, starts_with(bare, 'sbx_') OR bare = 'qg_quality_results' AS may_be_written,
               starts_with(bare, 'sbx_') OR bare = 'qg_quality_results' AS guard_passes
        FROM last""",
    ),
    "k7_latest_sandbox_and_drop": Scenario(
        lifecycle,
        f"""
        SELECT FALSE AS existed, TRUE AS exists_now, COUNT(*) AS latest_rows, MAX(o_orderkey) AS latest_key,
               CAST(1 AS BIGINT) AS "left", (SELECT COUNT(*) FROM orders) AS rows_left
        FROM ({TRIMMED})""",
    ),
    "k3_replace_sandbox": Scenario(
        replace,
        f"""
        SELECT * FROM ({MARKED_UP})
        WHERE NOT (o_orderpriority = '5-LOW' AND o_totalprice < 100000)""",
    ),
    "k4_truncate_sandbox": Scenario(
        truncate,
        "SELECT COUNT(*) AS n_before, CAST(0 AS BIGINT) AS n_after, 6 AS n_columns FROM orders",
    ),
    "k6_latest_run_status": Scenario(
        lambda spark, d: latest_run_status(results_log(load(spark, d, "events"))),
        f"""
        SELECT sandbox_name, run_id, run_at, quality_passed FROM (
            SELECT sandbox_name, run_id, MAX(run_at) AS run_at,
                   COUNT(*) FILTER (WHERE status <> 'PASS') = 0 AS quality_passed,
                   row_number() OVER (PARTITION BY sandbox_name
                                      ORDER BY MAX(run_at) DESC, run_id DESC) AS rn
            FROM ({RESULTS_LOG}) GROUP BY sandbox_name, run_id
        ) WHERE rn = 1""",
    ),
    "k7_latest_per_key": Scenario(
        lambda spark, d: T.latest_per_key(
            load(spark, d, "events"), ["user_id"], "ts", F.desc("event_id")
        ),
        """
        SELECT event_id, ts, user_id, event_type, value, props FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id
                                         ORDER BY ts DESC, event_id DESC) AS rn
            FROM events
        ) WHERE rn = 1""",
    ),
}
