from __future__ import annotations

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from drydock.operators import categorical, integrity, numeric, volume
from drydock.operators.check import Check
from drydock.operators.transforms import delete, update
from drydock.plans.ledger import Ledger, latest_run_status, run_summary
from drydock.plans.query import preview, query, sql_check
from drydock.plans.runner import evaluate, grade, plan_suite, run_checks


@pytest.mark.parametrize(
    ("column", "values", "wanted", "strict"),
    [
        ("status", [], "PASS", "PASS"),
        ("status", ["PASS"], "PASS", "PASS"),
        ("status", ["PASS", "FAIL"], "FAIL", "FAIL"),
        ("STATUS", ["PASS"], "PASS", "PASS"),
        ("Status", ["fail"], "FAIL", "FAIL"),
        ("status", ["pass"], "PASS", "PASS"),
        ("status", [None, "unknown"], "PASS", "FAIL"),
        ("orphan", ["999"], "FAIL", "FAIL"),
        ("orphan", [], "PASS", "PASS"),
    ],
)
def test_evaluate(spark, column, values, wanted, strict):
    df = spark.createDataFrame([(v,) for v in values], f"{column} string")
    assert evaluate(df).first()["status"] == wanted
    assert evaluate(df, strict=True).first()["status"] == strict


def fixed(df, name="fixed"):
    return Check(name, lambda _prod, _sbx: df, "as given")


def test_result_and_detail_texts(spark):
    df = spark.createDataFrame(
        [(i, "FAIL" if i % 2 else "PASS") for i in range(20)], "id int, status string"
    ).repartition(4).orderBy("id")
    row = grade(fixed(df), df, df).first()
    assert row["status"] == "FAIL"
    shown = "; ".join(f"id={i}, status={'FAIL' if i % 2 else 'PASS'}" for i in range(10))
    assert row["result"] == shown + " ... (10 more rows)"
    assert row["detail"] == (
        "id=1, status=FAIL; id=3, status=FAIL; id=5, status=FAIL ... (7 more rows)"
    )


def test_texts_of_violations(spark):
    df = spark.createDataFrame([(1, None)], "bad_id int, `it's` string")
    row = grade(fixed(df), df, df).first()
    assert (row["status"], row["result"], row["detail"]) == (
        "FAIL", "bad_id=1, it's=None", "bad_id=1, it's=None"
    )
    empty = grade(fixed(df.limit(0)), df, df).first()
    assert (empty["status"], empty["result"], empty["detail"]) == (
        "PASS", "(no violations found)", ""
    )


def test_numbers_are_written_out(spark):
    values = [12345678.5, 1e7, 0.5, -2e9, 1e15, 123456789012345680.0, -1.25e-7, 1e300, 0.001, 3.0]
    fields = ", ".join(f"c{i} double" for i in range(len(values)))
    df = spark.createDataFrame([tuple(values)], fields)
    text = grade(fixed(df), df, df).first()["result"]
    shown = [part.split("=")[1] for part in text.split(", ")]
    assert shown[:7] == ["12345678.5", "10000000.0", "0.5", "-2000000000.0", "1" + "0" * 15 + ".0",
                         "123456789012345680.0", "-0.000000125"]
    assert shown[7] == "1" + "0" * 300 + ".0"
    assert [float(x) for x in shown] == values
    odd = spark.sql("SELECT double('NaN') AS a, double('-Infinity') AS b, CAST(NULL AS double) AS c")
    assert grade(fixed(odd), odd, odd).first()["result"] == "a=NaN, b=-Infinity, c=None"


def all_checks(customers):
    return [
        volume.row_count_comparison(),
        volume.row_count_match(),
        volume.new_rows_inspection("order_id"),
        numeric.mean_drift("amount", scale=2),
        numeric.sum_comparison("amount", scale=2),
        numeric.min_max_bounds("amount"),
        categorical.value_set_drift("status"),
        categorical.distribution_shift("status"),
        integrity.uniqueness_on_keys("order_id"),
        integrity.foreign_key_integrity("customer_id", customers, "id"),
        integrity.referential_completeness("order_id"),
        integrity.null_check("amount"),
    ]


def test_fused_suite_equals_single_checks(spark, orders):
    sbx = delete(update(orders, {"status": "lost"}, F.col("order_id") == 3), F.col("order_id") == 5)
    checks = all_checks(spark.createDataFrame([(10,), (20,)], "id bigint"))
    fused = {r["check"]: tuple(r)[2:] for r in plan_suite(orders, sbx, checks).collect()}
    for check in checks:
        assert fused[check.name] == tuple(grade(check, orders, sbx).first())[2:], check.name
    assert {name for name, row in fused.items() if row[0] == "FAIL"} == {
        "row_count_comparison", "row_count_match", "mean_drift", "value_set_drift",
        "distribution_shift", "foreign_key_integrity", "referential_completeness",
    }


def test_one_column_summed_in_two_ways(orders):
    checks = [
        numeric.sum_comparison("amount", scale=0, name="whole"),
        numeric.sum_comparison("amount", scale=2, name="cents"),
        numeric.sum_comparison("amount", name="plain"),
    ]
    texts = {r["check"]: r["result"] for r in plan_suite(orders, orders, checks).collect()}
    assert texts["whole"].startswith("prod_sum=1376.0")
    assert texts["cents"].startswith("prod_sum=1375.49")


def test_broken_checks_fail_alone(spark, orders, tmp_path):
    """Whatever breaks, and whenever: every check has its row, and the others are graded."""
    damaged = tmp_path / "damaged"
    orders.write.parquet(str(damaged))
    broken_file = spark.read.parquet(str(damaged))
    for file in damaged.glob("*.parquet"):
        file.write_bytes(b"PAR1 this is no parquet file")

    def raises(_prod, _sbx):
        raise ValueError("first line\nsecond line")

    checks = [
        numeric.sum_comparison("no_such_column", name="missing"),
        numeric.sum_comparison("amount"),
        Check("at_run_time", lambda _p, s: s.select(F.raise_error(F.lit("boom")).alias("status"))),
        Check("value_error", raises),
        Check("bad_update", lambda _p, s: update(s, {"nope": 1})),
        Check("damaged_file", lambda _p, _s: broken_file.where("amount < 0")),
        Check("assertion", lambda _p, s: s.where(F.assert_true(F.col("amount") < 0, "too much").isNull())),
        Check("bad_cast", lambda _p, s: s.where(F.col("status").cast("int") > 1)),
        integrity.null_check("amount"),
    ]
    ledger = Ledger(spark, str(tmp_path))
    run = run_checks(orders, orders, checks, "sbx_orders", "orders", ledger, run_id="r1", sandbox_version=3)
    rows = {r["check"]: r for r in run.collect()}
    assert list(rows) and {name: r["status"] for name, r in rows.items()} == {
        c.name: "PASS" if c.name in ("sum_comparison", "null_check") else "FAIL" for c in checks
    }
    assert "no_such_column" in rows["missing"]["result"]
    assert rows["missing"]["result"].startswith("Query error: ")
    assert "boom" in rows["at_run_time"]["detail"]
    assert rows["value_error"]["detail"] == "first line\nsecond line"
    assert "nope" in rows["bad_update"]["detail"] and "too much" in rows["assertion"]["detail"]
    assert rows["at_run_time"]["expected"] == "at_run_time"
    assert rows_of(run_summary(run)) == [("r1", 9, 7, False)]
    assert {r["sandbox_version"] for r in rows.values()} == {3}
    assert rows["sum_comparison"]["definition"] == (
        "sum_comparison(column='amount', pct=10, scale=None, abs_denominator=False)"
    )


def test_counts_of_cut_listings_are_whole(spark):
    prod = spark.range(2000).select((F.col("id") % 700).alias("k"), "id")
    sbx = prod.where("k < 100")
    checks = [
        integrity.referential_completeness("k"), volume.new_rows_inspection("k"),
        integrity.uniqueness_on_keys("k"),
    ]
    lost = prod.where("k >= 100").count()
    rows = {r["check"]: r for r in plan_suite(prod, sbx, checks).collect()}
    assert rows["referential_completeness"]["detail"].endswith(f"({lost - 3} more rows)")
    assert rows["uniqueness_on_keys"]["result"].endswith("(90 more rows)")
    back = {r["check"]: r for r in plan_suite(sbx, prod, checks).collect()}
    assert back["new_rows_inspection"]["result"].endswith(f"({lost - 10} more rows)")
    assert back["new_rows_inspection"]["status"] == "PASS"


def test_defaults_of_a_check(orders):
    row = grade(Check("", lambda _p, s: s.limit(0)), orders, orders).first()
    assert (row["check"], row["expected"]) == ("unnamed_check", "unnamed_check")


def test_no_checks(orders):
    with pytest.raises(ValueError, match="no quality checks"):
        plan_suite(orders, orders, [])


def test_status_follows_the_latest_run(spark, orders, tmp_path):
    """A pass does not outlive a later failure."""
    ledger = Ledger(spark, str(tmp_path))

    def run(sbx, run_id=None):
        return run_checks(orders, sbx, [volume.row_count_match()], "sbx_a", "orders", ledger, run_id)

    assert len(run(orders).first()["run_id"]) == 36
    results = ledger.read("quality_results")
    assert latest_run_status(results).first()["quality_passed"] is True
    run(orders.limit(1), "second")
    latest = latest_run_status(ledger.read("quality_results")).collect()
    assert [(r["run_id"], r["quality_passed"]) for r in latest] == [("second", False)]


def test_sql_check_in_both_styles(orders):
    sbx = orders.where("order_id > 1")
    counts = sql_check(
        "counts",
        "SELECT p.n, CASE WHEN p.n = s.n THEN 'PASS' ELSE 'FAIL' END AS status"
        " FROM (SELECT count(*) n FROM orders) p, (SELECT count(*) n FROM sbx_orders) s;",
        "orders", "sbx_orders", "counts match",
    )
    cheap = sql_check("cheap", "SELECT * FROM sbx_orders WHERE amount < 0", "orders", "sbx_orders")
    graded = {r["check"]: r["status"] for r in plan_suite(orders, sbx, [counts, cheap]).collect()}
    assert graded == {"counts": "FAIL", "cheap": "PASS"}


@pytest.mark.parametrize(
    "sql",
    [
        "INSERT INTO orders VALUES (1, 2, 'x', 1.0)",
        "DROP TABLE orders",
        "CREATE TABLE t (id int)",
        "SELECT 1) AS a; DROP TABLE orders; SELECT * FROM (SELECT 1",
        "GARBLE THINGS",
    ],
)
def test_query_refuses_writes(spark, orders, sql):
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR|TABLE_OR_VIEW_NOT_FOUND"):
        query(spark, sql, {"orders": orders})


def test_query_leaves_views_alone(spark, orders):
    spark.range(3).createOrReplaceTempView("orders")
    try:
        assert query(spark, "SELECT count(*) AS n FROM orders", {"orders": orders}).first()["n"] == 5
        assert spark.table("orders").count() == 3
        assert query(spark, "SELECT * FROM `o'd``d`", {"o'd`d": orders}).count() == 5
        both = query(spark, "WITH c AS (SELECT * FROM orders) SELECT * FROM c, vip", {"orders": orders, "vip": spark.range(2)})
        assert both.count() == 10
        assert query(spark, "SELECT 1 AS one", {}).first()["one"] == 1
        assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("_q_")]
    finally:
        spark.catalog.dropTempView("orders")


def test_query_accepts_any_select(spark, orders):
    for sql in (
        "SELECT status FROM orders ORDER BY order_id -- last",
        "WITH c AS (SELECT * FROM orders) SELECT status FROM c;",
        "SELECT status FROM orders UNION ALL SELECT 'x'",
    ):
        assert query(spark, sql, {"orders": orders}).columns == ["status"]
    ordered = query(spark, "SELECT * FROM orders ORDER BY amount DESC", {"orders": orders})
    assert ordered.first()["order_id"] == 4


def test_preview_knows_whether_there_is_more(spark):
    exact, longer = preview(spark.range(50)), preview(spark.range(51))
    assert (len(exact.rows), exact.truncated) == (50, False)
    assert (len(longer.rows), longer.truncated) == (50, True)
