"""The physical plans that make the operators hold at scale."""

from __future__ import annotations

import re

import pytest
from conftest import final_plan, rows_of
from pyspark.sql import functions as F

from drydock.functions import screening
from drydock.operators import categorical, integrity, numeric, volume
from drydock.operators import transforms as T
from drydock.plans.runner import grade, plan_suite
from scenarios import ALL

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def big(spark, tmp_path):
    """A table on disk in which one key holds a third of the rows."""
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
    df = spark.range(300000).select(
        hot.alias("k"), (F.col("id") % 5).cast("string").alias("c"), F.col("id").alias("v"),
        F.sha2(F.col("id").cast("string"), 256).alias("wide"),
    )
    df.repartition(8).write.parquet(str(tmp_path / "big"))
    return spark.read.parquet(str(tmp_path / "big"))


@pytest.fixture
def skew(conf):
    """Thresholds small enough for test data to count as large and skewed."""
    conf(
        autoBroadcastJoinThreshold="-1",
        shuffle__partitions="16",
        adaptive__advisoryPartitionSizeInBytes="200KB",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="400KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
    )


def scans(plan):
    return [m.group(1) for m in re.finditer(r"FileScan parquet \[([^\]]*)\]", plan)]


def names(scan):
    return re.sub(r"#\d+L?", "", scan)


def test_scalar_checks_share_one_scan_per_side(big):
    checks = [
        volume.row_count_comparison(), volume.row_count_match(), numeric.mean_drift("v"),
        numeric.sum_comparison("v"), numeric.min_max_bounds("v"),
    ]
    plan = final_plan(plan_suite(big, big.where("v > 10"), checks))
    assert [names(s) for s in scans(plan)] == ["v", "v"]
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,10)]" in plan
    assert "Join" not in plan and "Cartesian" not in plan


def test_category_checks_share_one_shuffle(big):
    checks = [categorical.value_set_drift("c"), categorical.distribution_shift("c")]
    plan = final_plan(plan_suite(big, big.where("v > 10"), checks))
    assert [names(s) for s in scans(plan)] == ["c", "c,v"]
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning\(c", plan)) - plan.count(
        "ReusedExchange [c"
    ) == 1
    assert "Join" not in plan and "Window" not in plan


def test_key_checks_share_one_shuffle_of_keys(big):
    sbx = big.where("v > 10")
    checks = [
        integrity.referential_completeness("k"), volume.new_rows_inspection("k"),
        integrity.uniqueness_on_keys("k"),
    ]
    plan = final_plan(plan_suite(big, sbx, checks))
    wide = [s for s in scans(plan) if "wide" in s]
    assert [names(s) for s in scans(plan) if s not in wide] == ["k", "k,v"]
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan


def test_uniqueness_alone_reads_the_sandbox_only(big):
    plan = final_plan(integrity.uniqueness_on_keys("k").rows(big, big.where("v > 10")))
    assert [names(s) for s in scans(plan)] == ["k,v"]


def test_merge_and_lookup_read_only_columns_in_use(spark, big):
    source = big.select("k", "c", F.sha2("wide", 256).alias("wide"), (F.col("v") + 1).alias("v"))
    source = T.deduplicate(source, ["k"], ["v"])
    merged = T.merge(big.select("k", "c"), source, ["k"], update={"c": F.col("s.c")})
    plan = final_plan(merged)
    assert sorted(names(s) for s in scans(plan)) == ["k,c", "k,c,v"]
    assert "SortAggregate" not in plan
    looked_up = T.update_from_join(
        big.select("k", "c"), source, {"k": "k"}, {"c": F.col("s.c")}, order=["v"]
    )
    assert sorted(names(s) for s in scans(final_plan(looked_up))) == ["k,c", "k,c,v"]


def test_merge_scans_of_the_registered_query(spark):
    plan = final_plan(ALL["t6_merge_upsert"].run(spark, SF_DIR))
    assert len([s for s in scans(plan) if "o_orderkey" in s]) <= 8


@pytest.mark.parametrize("broadcast", [True, False])
def test_foreign_keys_are_counted_before_the_join(big, conf, broadcast):
    """Small parents: orphans are found map-side. Large parents: counts are joined, not rows."""
    conf(autoBroadcastJoinThreshold="10MB" if broadcast else "-1")
    parents = big.select("k").where("k < 1000")
    check = integrity.foreign_key_integrity("k", parents, "k")
    plan = final_plan(check.rows(None, big))
    below_join = plan[plan.index("LeftAnti"):]
    assert ("partial_count" in below_join) is not broadcast
    assert check.rows(None, big).agg(F.sum("orphaned_count")).first()[0] == big.where("k >= 1000").count()


def test_dedup_trims_groups_before_the_shuffle(big):
    plan = final_plan(T.deduplicate(big, ["k"], ["v"]))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Exchange hashpartitioning(k") < plan.rindex("WindowGroupLimit")


def test_hot_keys_are_split_in_lookups(big, skew):
    lookup = big.select(F.col("k").alias("id"), F.lit("x").alias("w")).distinct()
    changed = T.update_from_join(big, lookup, {"k": "id"}, {"wide": F.col("s.w")}, order=["w"])
    assert "skew=true" in final_plan(changed)
    assert changed.where("wide = 'x'").count() == big.count()
    flagged = T.flag_members(big, lookup, {"k": "id"}, "member")
    assert "skew=true" in final_plan(flagged)


def test_hot_null_keys_are_split_in_full_listings(big, skew):
    hot = big.withColumn("k", F.when(F.col("k") != 7, F.col("k")))
    other = big.where("k % 2 = 0").select(hot.columns)
    new = volume.new_rows_inspection("k", limit=None).rows(other, hot)
    assert "skew=true" in final_plan(new)
    assert new.count() == 200000  # 100,000 rows whose key is NULL, 100,000 odd ones
    lost = integrity.referential_completeness("k", limit=None).rows(hot, other)
    assert lost.count() == 200000


def test_hot_keys_are_split_in_merges(spark, big, skew):
    source = big.select("k", F.lit("merged").alias("wide")).distinct().unionByName(
        spark.range(10**6, 10**6 + 50).select(F.col("id").alias("k"), F.lit("new").alias("wide"))
    )
    merged = T.merge(big, source, ["k"], update={"wide": F.col("s.wide")}, insert=True)
    assert "skew=true" in final_plan(merged)
    assert rows_of(merged.groupBy("wide").count()) == [("merged", 300000), ("new", 50)]


def test_a_small_source_does_not_shuffle_the_merged_table(spark, big):
    source = spark.range(5).select(F.col("id").alias("k"), F.lit("x").alias("wide"))
    plan = final_plan(T.merge(big, source, ["k"], update={"wide": F.col("s.wide")}, insert=True))
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "wide" in line]
    assert not wide and "SortMergeJoin" not in plan


def test_rewrites_prune_and_push(big):
    changed = T.update(T.delete(big, F.col("v") > 5), {"c": "z"}, F.col("k") == 1)
    plan = final_plan(changed.select("c"))
    assert names(scans(plan)[0]) == "k,c,v"
    assert "Exchange" not in plan


def test_screening_reads_each_statement_once(spark):
    log = spark.range(10).select("id", F.lit("SELECT 1").alias("sql"))
    plan = final_plan(screening.screen_statements(log, "id", "sql"))
    assert plan.count("Exchange hashpartitioning") <= 1
    assert plan.count("regexp_extract") <= 2 and "lambdafunction(regexp_extract" not in plan


def test_quoted_rows_are_a_top_k(big):
    plan = final_plan(grade(integrity.uniqueness_on_keys("c"), big, big))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("name", sorted(ALL))
def test_no_registered_query_multiplies_rows(spark, name):
    plan = final_plan(ALL[name].run(spark, SF_DIR))
    assert "Cartesian" not in plan and "NestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan
