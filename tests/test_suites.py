from __future__ import annotations

import math

import pytest
from conftest import final_plan, rows_of
from pyspark.sql import functions as F

from drydock.operators import categorical, integrity, numeric, volume
from drydock.operators.check import Check, ScalarCheck
from drydock.plans import runner
from drydock.plans.profile import known_measures
from drydock.plans.runner import plan_suite, run_checks
from drydock.plans.sandbox import SandboxStore
from drydock.plans.suites import KINDS, CheckSpec, SavedSuites
from drydock.sources.catalog import Catalog

SPECS = [
    CheckSpec("row_count_comparison", {"pct": 5}),
    CheckSpec("sum_comparison", {"column": "amount", "scale": 2}, name="total"),
    CheckSpec("uniqueness_on_keys", {"keys": ["order_id", "status"]}),
    CheckSpec("foreign_key_integrity", {"fk": "customer_id", "referenced": "customers", "pk": "id"}),
    CheckSpec.of_sql("cheap", "SELECT * FROM orders o JOIN vip v ON o.customer_id = v.id", "no vip", ["vip"]),
]


@pytest.fixture
def store(spark, tmp_path):
    return SandboxStore(spark, str(tmp_path))


def direct(orders, customers, vip):
    from drydock.plans.query import sql_check

    return [
        volume.row_count_comparison(5),
        numeric.sum_comparison("amount", scale=2, name="total"),
        integrity.uniqueness_on_keys("order_id", "status"),
        integrity.foreign_key_integrity("customer_id", customers, "id"),
        sql_check("cheap", SPECS[-1].arguments["sql"], "orders", "sbx_any", "no vip", vip=vip),
    ]


def test_a_saved_suite_is_the_same_suite(spark, store, orders, tmp_path):
    customers, vip = spark.sql("SELECT id FROM range(15)"), spark.sql("SELECT 20L AS id")
    sandbox = store.commit(store.create("orders", orders), orders.where("order_id > 1"))
    suites = SavedSuites(store)
    suites.save(sandbox.sandbox_name, SPECS[:1])
    suites.save(sandbox.sandbox_name, SPECS)  # the last counts
    assert suites.load(sandbox.sandbox_name) == SPECS
    later, tables = spark.newSession(), {}
    for name, df in {"orders": orders, "customers": customers, "vip": vip}.items():
        df.write.parquet(str(tmp_path / name))
        tables[name] = later.read.parquet(str(tmp_path / name))
    columns = ["check", "definition", "status", "result", "expected", "detail", "sandbox_version"]
    saved = SavedSuites(SandboxStore(later, str(tmp_path))).run(sandbox.sandbox_name, tables).select(columns)
    want = run_checks(orders, store.read(sandbox), direct(orders, customers, vip), "sbx_x", "orders", sandbox_version=1)
    assert rows_of(saved) == rows_of(want.select(columns))
    assert {r["status"] for r in saved.collect()} == {"PASS", "FAIL"}


def test_tables_come_from_the_catalog(spark, orders, tmp_path):
    catalog = Catalog(spark, "suites_db", str(tmp_path))
    try:
        store = SandboxStore(spark, str(tmp_path))
        sandbox = store.create("orders", catalog.create("orders", orders))
        suites = SavedSuites(store, catalog)
        suites.save(sandbox.sandbox_name, [CheckSpec("row_count_match"), CheckSpec("null_check", {"column": "amount"})])
        assert [r["status"] for r in suites.run(sandbox.sandbox_name).collect()] == ["PASS", "PASS"]
    finally:
        spark.sql("DROP DATABASE IF EXISTS suites_db CASCADE")


def test_nothing_saved_is_an_error(store, orders):
    suites, name = SavedSuites(store), store.create("orders", orders).sandbox_name
    with pytest.raises(ValueError, match="no quality checks saved"):
        suites.run(name, {"orders": orders})
    with pytest.raises(ValueError, match="no quality checks defined"):
        suites.save(name, [])
    with pytest.raises(ValueError, match="no sandbox named"):
        suites.save("sbx_orders_unknown", SPECS)


@pytest.mark.parametrize(
    ("spec", "message"),
    [
        (CheckSpec("row_counts"), "there is no check 'row_counts'"),
        (CheckSpec("sum_comparison", {"colum": "a"}), "sum_comparison"),
        (CheckSpec("sum_comparison"), "missing a required argument"),
        (CheckSpec("sql", {"sql": 5}, "x"), "needs 'sql'"),
        (CheckSpec("sql", {"sql": "SELECT 1", "table": "t"}, "x"), "needs 'sql'"),
    ],
)
def test_specs_are_refused_when_they_are_saved(store, orders, spec, message):
    sandbox = store.create("orders", orders)
    with pytest.raises(ValueError, match=message):
        SavedSuites(store).save(sandbox.sandbox_name, [SPECS[0], spec])
    assert store.ledger.read("check_suites").count() == 0


def test_every_kind_has_its_arguments_checked():
    assert len(KINDS) == 12
    for kind in set(KINDS) - {"row_count_comparison", "row_count_match"}:
        with pytest.raises(ValueError, match=kind):
            CheckSpec(kind, {"nonsense": 1}).validate()


SCALARS = [
    volume.row_count_match(), numeric.sum_comparison("amount", scale=2), numeric.mean_drift("amount"),
    numeric.min_max_bounds("amount"), numeric.min_max_bounds("day", name="days"),
]


def test_profiled_checks_do_not_read_the_sandbox(spark, orders, tmp_path):
    prod = orders.withColumn("day", F.expr("date'2024-01-01' + CAST(order_id AS int)")).withColumn("nan", F.lit(math.nan))
    prod.write.parquet(str(tmp_path / "prod"))
    prod = spark.read.parquet(str(tmp_path / "prod"))
    checks = [*SCALARS[:-1], numeric.sum_comparison("nan", name="nans")]
    store = SandboxStore(spark, str(tmp_path), profile=[*checks, numeric.mean_drift("no_such"), categorical.value_set_drift("status")])
    sandbox = store.get(store.commit(store.create("orders", prod), prod.where("amount > 20")).sandbox_name)
    assert sandbox.n_rows == 3 and "sum_amount_2" in sandbox.profile
    sbx = store.read(sandbox)
    with_profile = plan_suite(prod, sbx, checks, sandbox.profile)
    assert rows_of(with_profile) == rows_of(plan_suite(prod, sbx, checks))
    plan = final_plan(with_profile)
    assert sandbox.path not in plan and "/prod" in plan
    mixed = [*checks, categorical.value_set_drift("status")]
    assert rows_of(plan_suite(prod, sbx, mixed, sandbox.profile)) == rows_of(plan_suite(prod, sbx, mixed))


def test_values_come_back_exactly(spark, tmp_path):
    df = spark.sql(
        "SELECT 0.1D AS d, CAST(1.10 AS decimal(20,2)) AS e, date'0001-01-01' AS f, timestamp_ntz'2024-01-02 03:04:05.678901' AS t,"
        " 'it''s' AS s, CAST('NaN' AS double) AS n, CAST('-Infinity' AS double) AS i, true AS b, CAST(NULL AS bigint) AS z, 1.5F AS g"
    )
    check = ScalarCheck("all", measures=lambda: {c: F.max(c) for c in df.columns})
    store = SandboxStore(spark, str(tmp_path), profile=[check])
    profile = store.get(store.create("t", df).sandbox_name).profile
    back = spark.range(1).select([c.alias(name) for name, c in known_measures(profile).items()])
    assert back.select(df.columns).dtypes == df.dtypes
    assert repr(back.select(df.columns).first()) == repr(df.first())


def test_a_measure_that_fails_does_not_stop_the_commit(spark, orders, tmp_path):
    failing = ScalarCheck("bad", measures=lambda: {"bad": F.max(F.raise_error(F.lit("measured")).cast("int"))})
    store = SandboxStore(spark, str(tmp_path), profile=[failing])
    sandbox = store.create("orders", orders)
    assert (sandbox.n_rows, sandbox.profile, store.read(sandbox).count()) == (5, {}, 5)


def test_one_broken_check_costs_two_jobs_a_halving(orders, tmp_path, monkeypatch):
    checks = [numeric.sum_comparison("amount", pct=p, name=f"s{p}") for p in range(8)]
    checks += [integrity.null_check("amount", name=f"n{i}") for i in range(7)]
    checks.insert(5, Check("broken", lambda _p, s: s.select(F.raise_error(F.lit("boom")).alias("status"))))
    sizes = []

    def counting(prod, sbx, part, profile=None):
        sizes.append(len(part))
        return plan_suite(prod, sbx, part, profile)

    monkeypatch.setattr(runner, "plan_suite", counting)
    run = run_checks(orders, orders, checks, "sbx_x", "orders", runner.Ledger(orders.sparkSession, str(tmp_path)))
    rows = {r["check"]: r for r in run.collect()}
    assert {n for n, r in rows.items() if r["status"] == "FAIL"} == {"broken"} and len(rows) == 16
    assert "boom" in rows["broken"]["detail"]
    assert sorted(sizes, reverse=True) == [16, 8, 8, 4, 4, 2, 2, 1, 1]
