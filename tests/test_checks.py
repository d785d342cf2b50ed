"""Edge cases of every check: NULLs, empty tables, zero and negative baselines."""

from __future__ import annotations

from collections import Counter

import pytest
from conftest import rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drydock.operators import categorical, integrity, numeric, volume
from drydock.operators.sides import side_counts


def status(check, prod, sbx):
    return check.rows(prod, sbx).first()["status"]


def one_column(spark, values, data_type="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {data_type}")


@pytest.mark.parametrize(
    ("n_prod", "n_sbx", "pct", "wanted"),
    [
        (10, 11, 10.0, "PASS"),
        (10, 12, 20.0, "FAIL"),
        (1000, 899, -10.1, "FAIL"),
        (10, 0, -100.0, "FAIL"),
        (0, 0, None, "FAIL"),
        (0, 5, None, "FAIL"),
    ],
)
def test_row_count(spark, n_prod, n_sbx, pct, wanted):
    row = volume.row_count_comparison().rows(spark.range(n_prod), spark.range(n_sbx)).first()
    assert (row["pct_change"], row["status"]) == (pct, wanted)
    assert row["row_diff"] == n_sbx - n_prod


def test_row_count_match(spark):
    check = volume.row_count_match()
    assert status(check, spark.range(100), spark.range(100)) == "PASS"
    assert status(check, spark.range(100), spark.range(101)) == "FAIL"


def test_threshold_is_applied_before_rounding(spark):
    # 10.0004% is shown as 10.0 but is above the threshold
    prod, sbx = spark.range(250000), spark.range(275001)
    row = volume.row_count_comparison().rows(prod, sbx).first()
    assert (row["pct_change"], row["status"]) == (10.0, "FAIL")


@pytest.mark.parametrize("kind", ["mean", "sum"])
@pytest.mark.parametrize(
    ("prod", "sbx", "drift", "wanted"),
    [
        ([100.0, 100.0], [110.0, 110.0], 10.0, "PASS"),
        ([100.0, 100.0], [111.0, 111.0], 11.0, "FAIL"),
        ([100.0, None], [100.0, None], 0.0, "PASS"),
        ([-100.0], [-500.0], -400.0, "PASS"),  # signed base: a negative one always passes
        ([0.0], [0.0], None, "FAIL"),
        ([None], [1.0], None, "FAIL"),
        ([1.0], [None], None, "FAIL"),
        ([], [], None, "FAIL"),
    ],
)
def test_drift(spark, kind, prod, sbx, drift, wanted):
    check = (numeric.mean_drift if kind == "mean" else numeric.sum_comparison)("x")
    row = check.rows(one_column(spark, prod), one_column(spark, sbx)).first()
    assert (row["drift_pct"], row["status"]) == (drift, wanted)


def test_drift_with_absolute_base(spark):
    prod, sbx = one_column(spark, [-100.0]), one_column(spark, [-500.0])
    assert status(numeric.sum_comparison("x", abs_denominator=True), prod, sbx) == "FAIL"
    assert status(numeric.mean_drift("x", pct=500, abs_denominator=True), prod, sbx) == "PASS"


def test_exact_sum_does_not_depend_on_order(spark):
    values = [0.1] * 1000 + [1e12, -1e12]
    check = numeric.sum_comparison("x", scale=2)
    for data in (values, values[::-1]):
        row = check.rows(one_column(spark, data), one_column(spark, data)).first()
        assert row["prod_sum"] == 100.0


@pytest.mark.parametrize("scale", [0, 2, None])
def test_sums_show_what_is_not_finite(spark, scale):
    nan, inf = float("nan"), float("inf")
    for values, wanted in (
        ([1.5, nan, 2.0], nan), ([1.5, inf], inf), ([-inf, 1.0], -inf), ([inf, -inf], nan), ([nan], nan),
        ([1e17, 1.0], 1e17 + 1.0), ([1e300, 1.0], 1e300), ([-1e25, 1e25, 3.0], 3.0), ([None, inf], inf),
    ):
        df = one_column(spark, values)
        found = df.agg(numeric.exact_sum("x", scale)).first()[0]
        assert found == wanted or (found != found and wanted != wanted), (values, found)
    bad = one_column(spark, [1.0, nan])
    assert status(numeric.sum_comparison("x", scale=scale), one_column(spark, [1.0]), bad) == "FAIL"
    assert status(numeric.mean_drift("x", scale=scale), one_column(spark, [1.0]), bad) == "FAIL"


def test_sums_hold_many_rows():
    """A decimal(38, s) sum of decimal(28, s) addends has room for 10 billion of the largest."""
    assert 10**10 * (10**28 - 1) < 10**38
    # and for 10**12 rows of money up to 10**16 units either way
    assert 10**12 * 10**16 * 100 < 10**38


def test_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "`a.b` int, `c d` double, `e``f` string")
    other = spark.createDataFrame([(2, 3.0, "y")], "`a.b` int, `c d` double, `e``f` string")
    for check in (
        numeric.sum_comparison("c d", scale=2), numeric.mean_drift("c d"), numeric.min_max_bounds("c d"),
        categorical.value_set_drift("e`f"), categorical.distribution_shift("e`f"),
        integrity.uniqueness_on_keys("a.b"), integrity.uniqueness_on_keys("a.b", "c d"),
        integrity.foreign_key_integrity("a.b", df, "a.b"), integrity.referential_completeness("a.b"),
        integrity.null_check("a.b"), volume.new_rows_inspection("a.b"),
    ):
        check.rows(df, other).collect()
    assert {r["column_name"] for r in integrity.null_profile(df).collect()} == set(df.columns)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(
    st.lists(
        st.one_of(
            st.none(),
            st.floats(-1e15, 1e15),
            st.integers(-(10**7), 10**7).map(lambda n: n / 1000),  # ties among them
            st.integers(-(10**6), 10**6).map(lambda n: n / 100),
        ),
        max_size=30,
    )
)
def test_exact_sum_equals_decimal_sum(spark, values):
    df = one_column(spark, values)
    fast = df.agg(numeric.exact_sum("x", 2)).first()[0]
    assert fast == df.agg(F.sum(F.col("x").cast("decimal(18,2)")).cast("double")).first()[0]


@pytest.mark.parametrize(
    ("prod", "sbx", "wanted"),
    [
        ([1.0, 10.0], [1.0, 11.0], "PASS"),
        ([1.0, 10.0], [0.5, 10.0], "FAIL"),
        ([1.0, 10.0], [1.0, 11.5], "FAIL"),
        ([-9.0, -1.0], [-9.0, -1.0], "FAIL"),  # headroom tightens a negative maximum
        ([1.0], [None], "FAIL"),
        ([], [], "FAIL"),
    ],
)
def test_min_max(spark, prod, sbx, wanted):
    check = numeric.min_max_bounds("x")
    assert status(check, one_column(spark, prod), one_column(spark, sbx)) == wanted


def test_value_set_drift(spark):
    prod = one_column(spark, ["a", "b", None], "string")
    sbx = one_column(spark, ["a", "c", "c", None], "string")
    rows = categorical.value_set_drift("x").rows(prod, sbx)
    # NULL is reported although production has it too
    assert rows_of(rows.select("new_value")) == [("c",), (None,)]
    assert categorical.value_set_drift("x").rows(prod, prod.dropna()).count() == 0


def test_distribution_shift(spark):
    prod = one_column(spark, ["a"] * 50 + ["b"] * 45 + [None] * 5, "string")
    sbx = one_column(spark, ["a"] * 55 + ["c"] * 39 + [None] * 6, "string")
    rows = [tuple(r) for r in categorical.distribution_shift("x").rows(prod, sbx).collect()]
    assert rows == [
        ("b", 45.0, 0.0, 45.0, "FAIL"),
        ("c", 0.0, 39.0, 39.0, "FAIL"),
        (None, 0.0, 6.0, 6.0, "FAIL"),
        (None, 5.0, 0.0, 5.0, "PASS"),
        ("a", 50.0, 55.0, 5.0, "PASS"),
    ]


def test_distribution_shift_of_empty_tables(spark):
    empty, full = one_column(spark, [], "string"), one_column(spark, ["a"], "string")
    check = categorical.distribution_shift("x")
    assert check.rows(empty, empty).count() == 0
    assert rows_of(check.rows(full, empty)) == [("a", 100.0, 0.0, 100.0, "FAIL")]


def test_uniqueness(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c")],
                               "k int, v string")
    single = integrity.uniqueness_on_keys("k").rows(None, df).collect()
    assert [tuple(r) for r in single] == [(1, 3), (None, 2)]
    both = integrity.uniqueness_on_keys("k", "v").rows(None, df).collect()
    assert [tuple(r) for r in both] == [(None, "c", 2), (1, "a", 2)]


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_foreign_key(spark, conf, threshold):
    conf(autoBroadcastJoinThreshold=threshold)
    children = spark.createDataFrame([(1,), (1,), (9,), (9,), (8,), (None,)], "fk bigint")
    parents = spark.createDataFrame([(1,), (1,), (2,), (None,)], "pk int")
    rows = integrity.foreign_key_integrity("fk", parents, "pk").rows(None, children).collect()
    assert [tuple(r) for r in rows] == [(9, 2), (None, 1), (8, 1)]


@pytest.mark.parametrize("limit", [50, None, 2000])
def test_completeness_lists_every_lost_row(spark, limit):
    prod = spark.createDataFrame([(k,) for k in (3, 1, 1, 2, None)], "k int")
    sbx = spark.createDataFrame([(2,), (None,)], "k int")
    rows = integrity.referential_completeness("k", limit=limit).rows(prod, sbx)
    assert rows_of(rows) == [(1,), (1,), (3,), (None,)]


def test_completeness_limit_counts_copies(spark):
    prod = spark.range(3).select(F.explode(F.array_repeat("id", 4)).alias("k"))
    rows = integrity.referential_completeness("k", limit=6).rows(prod, prod.where("k = 5"))
    assert [r[0] for r in rows.collect()] == [0, 0, 0, 0, 1, 1]


@pytest.mark.parametrize("limit", [50, None, 2000])
def test_new_rows(spark, orders, limit):
    new = spark.createDataFrame(
        [(7, 1, "x", 1.0), (7, 2, "x", 1.0), (None, 3, "x", 1.0)], orders.schema
    )
    sbx = orders.unionByName(new)
    rows = volume.new_rows_inspection("order_id", limit=limit).rows(orders, sbx)
    assert rows_of(rows.select("order_id", "customer_id", "status")) == [
        (7, 1, "PASS"), (7, 2, "PASS"), (None, 3, "PASS")
    ]


@pytest.mark.parametrize("limit", [1, 5, 12, 40, 59, 60, 61, 500])
def test_long_listings_are_the_same_rows(spark, monkeypatch, limit):
    """Put together from shares of keys, with NULLs, copies and a cut inside a key."""
    old = spark.sql("SELECT CAST(id AS int) AS k, id AS x FROM range(5)")
    rows = [(None if i % 7 == 0 else i % 11 + 3, i * 37 % 20) for i in range(80)]
    new = spark.createDataFrame(rows, "k int, x bigint").repartition(4)
    for check, prod, sbx in (
        (volume.new_rows_inspection("k", limit=limit), old, new),
        (integrity.referential_completeness("k", limit=limit), new, old),
    ):
        short = [tuple(r) for r in check.rows(prod, sbx).collect()]
        with monkeypatch.context() as patch:
            for module in (volume, integrity):
                patch.setattr(module, "LONG_LISTING", 0)
            listing = check.rows(prod, sbx)
            assert [tuple(r) for r in listing.collect()] == short and len(short) <= limit
            if check.name == "new_rows_inspection":
                plan = listing._jdf.queryExecution().optimizedPlan().toString()
                limited = plan[plan.index("GlobalLimit"):].splitlines()[2]
                assert "k" in limited and "x" not in limited.split("Sort")[-1]  # keys are cut, never whole rows


@pytest.mark.parametrize("limit", [3, 2000])
def test_listings_have_a_limit_and_an_order(spark, limit):
    small, large = spark.range(100), spark.range(-3000, 200)
    wanted = list(range(-3000, -3000 + limit))
    new = volume.new_rows_inspection("id", limit=limit).rows(small, large)
    assert [r["id"] for r in new.collect()] == wanted
    lost = integrity.referential_completeness("id", limit=limit).rows(large, small)
    assert [r[0] for r in lost.collect()] == wanted


def test_null_check_and_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None), (2, "a")], "a int, b string")
    assert integrity.null_check("a").rows(None, df).count() == 1
    assert rows_of(integrity.null_profile(df)) == [("a", 1), ("b", 2)]


def test_identical_tables_pass(orders):
    """On an unchanged table nothing may be found."""
    for check in (
        volume.row_count_comparison(),
        volume.row_count_match(),
        numeric.mean_drift("amount"),
        numeric.sum_comparison("amount"),
        numeric.min_max_bounds("amount"),
    ):
        assert status(check, orders, orders) == "PASS", check.name
    shifts = categorical.distribution_shift("status").rows(orders, orders)
    assert {r["status"] for r in shifts.collect()} == {"PASS"}
    for check in (
        categorical.value_set_drift("status"),
        integrity.referential_completeness("order_id"),
        volume.new_rows_inspection("order_id"),
    ):
        assert check.rows(orders, orders).count() == 0, check.name


@pytest.mark.parametrize("factor", [0.5, 1.0, 1.05, 3.0])
def test_scaling_a_column_drifts_by_the_factor(orders, factor):
    sbx = orders.withColumn("amount", F.col("amount") * factor)
    row = numeric.sum_comparison("amount").rows(orders, sbx).first()
    assert row["drift_pct"] == pytest.approx(abs(factor - 1) * 100, abs=0.01)


keys = st.lists(st.one_of(st.none(), st.integers(0, 5)), max_size=12)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(prod=keys, sbx=keys)
def test_side_counts_against_brute_force(spark, prod, sbx):
    frames = [one_column(spark, side, "int") for side in (prod, sbx)]
    wanted = []
    for key in set(prod + sbx):
        counts = Counter(prod)[key], Counter(sbx)[key]
        if key is None:
            wanted += [(None, n, 0) for n in counts[:1] if n] + [(None, 0, n) for n in counts[1:] if n]
        else:
            wanted.append((key, *counts))
    assert rows_of(side_counts(*frames, ["x"])) == sorted(wanted, key=repr)


def test_side_counts_on_composite_keys(spark):
    prod = spark.createDataFrame([(1, "a"), (1, None)], "k int, v string")
    sbx = spark.createDataFrame([(1, "a"), (1, None), (2, "a")], "k int, v string")
    assert rows_of(side_counts(prod, sbx, ["k", "v"])) == [
        (1, "a", 1, 1), (1, None, 0, 1), (1, None, 1, 0), (2, "a", 0, 1)
    ]
