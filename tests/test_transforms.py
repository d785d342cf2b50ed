from __future__ import annotations

import pytest
from conftest import rows_of
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from drydock.operators import transforms as T


def amounts(df):
    return {r["order_id"]: r["amount"] for r in df.collect()}


def test_update_sees_only_old_values(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert rows_of(T.update(df, {"a": F.col("b"), "b": F.col("a")})) == [(2, 1)]


def test_update_keeps_types_and_rows_with_unknown_predicate(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "a bigint, p boolean")
    changed = T.update(df, {"a": F.lit("7")}, F.col("p"))
    assert changed.schema == df.schema
    assert rows_of(changed) == [(1, None), (3, False), (7, True)]


def test_update_of_unknown_column(orders):
    with pytest.raises(ValueError, match="nope"):
        T.update(orders, {"nope": 1})


def test_update_from_scalar_subquery(orders):
    total = orders.agg(F.sum("amount")).scalar()
    changed = T.update(orders, {"amount": total}, F.col("status") == "pending")
    assert amounts(changed)[3] == pytest.approx(1375.49)


def test_money_rounds_half_up(spark):
    df = spark.createDataFrame([(1.005,), (2.675,)], "x double")
    values = df.select(T.round_money(F.col("x").cast("decimal(18,3)")))
    assert rows_of(values) == [(1.01,), (2.68,)]


def test_delete_keeps_rows_with_unknown_predicate(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "a int")
    assert rows_of(T.delete(df, F.col("a") > 3)) == [(1,), (None,)]


def test_insert_casts_and_fills(spark, orders):
    new = spark.createDataFrame([("9", 1)], "order_id string, customer_id int")
    changed = T.insert(orders, new)
    assert changed.schema == orders.schema
    assert changed.where("order_id = 9").first() == (9, 1, None, None)
    assert T.insert(orders, orders).count() == 10
    with pytest.raises(ValueError, match="extra"):
        T.insert(orders, orders.withColumn("extra", F.lit(1)))


def merge(df, source, **clauses):
    return T.merge(df, source, on=["k"], sparse=df.sparkSession.conf.get("spark.tests.sparse") == "true", **clauses)


@pytest.fixture(params=[("10MB", "false"), ("-1", "false"), ("-1", "true")])
def tables(spark, conf, request):
    """A target and a source, joined by broadcast, by sorted shuffles, and by those of rows that may match."""
    conf(autoBroadcastJoinThreshold=request.param[0])
    spark.conf.set("spark.tests.sparse", request.param[1])
    target = spark.createDataFrame([(1, "a"), (2, "b"), (2, "bb"), (None, "n")], "k int, v string")
    source = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, v string")
    return target, source


def test_merge_updates_and_inserts(tables):
    merged = merge(*tables, update={"v": F.col("s.v")}, insert=True)
    assert rows_of(merged) == sorted(
        [(1, "a"), (2, "B"), (2, "B"), (None, "n"), (3, "C"), (None, "N")], key=repr
    )


@pytest.mark.parametrize("key_type", ["bigint", "decimal(10,0)", "double", "string"])
def test_merge_keys_of_different_types(tables, key_type):
    target, source = tables
    source = source.withColumn("k", F.col("k").cast(key_type))
    merged = merge(target, source, update={"v": F.col("s.v")}, insert=True)
    assert merged.schema == target.schema
    assert rows_of(merged) == sorted(
        [(1, "a"), (2, "B"), (2, "B"), (None, "n"), (3, "C"), (None, "N")], key=repr
    )


def test_merge_deletes_before_it_updates(tables):
    merged = merge(
        *tables, update={"v": F.concat(F.col("t.v"), F.col("s.v"))},
        delete_where=F.col("t.v") == "b",
    )
    assert rows_of(merged) == sorted([(1, "a"), (2, "bbB"), (None, "n")], key=repr)


def test_merge_conditional_update(tables):
    merged = merge(*tables, update={"v": "x"}, update_where=F.length("t.v") > 1)
    assert rows_of(merged) == sorted([(1, "a"), (2, "b"), (2, "x"), (None, "n")], key=repr)


def test_merge_insert_with_expressions(tables):
    merged = merge(*tables, insert={"k": F.col("s.k"), "v": F.lower("s.v")})
    assert rows_of(merged.where("v in ('c', 'n')")) == [(3, "c"), (None, "n"), (None, "n")]


def test_merge_refuses_ambiguous_matches(spark, tables):
    target, source = tables
    twice = source.unionByName(spark.createDataFrame([(2, "BB"), (4, "D"), (4, "DD")], source.schema))
    with pytest.raises(PySparkException, match="more than one source row"):
        merge(target, twice, update={"v": F.col("s.v")}).collect()
    with pytest.raises(PySparkException, match="more than one source row"):
        merge(target, twice, update={"v": F.col("s.v")}).count()
    unmatched = twice.where("k <> 2")  # repeated source keys that match nothing are inserted
    merged = merge(target, unmatched, update={"v": F.col("s.v")}, insert=True)
    assert rows_of(merged.where("k = 4")) == [(4, "D"), (4, "DD")]


def test_merge_refuses_unknown_columns(tables):
    target, source = tables
    with pytest.raises(ValueError, match="vv"):
        merge(target, source, insert={"k": F.col("s.k"), "vv": F.col("s.v")})
    wider = source.withColumn("note", F.lit("x"))
    with pytest.raises(ValueError, match="leave_out"):
        merge(target, wider, insert=True)
    assert merge(target, wider, insert=True, leave_out=["note"]).count() == 6


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, 2), (None, 3)], "`a.b` int, `c d` int")
    changed = T.update(df, {"a.b": F.lit(5)}, "`c d` = 3")
    assert rows_of(changed) == [(1, 2), (5, 3)]
    assert rows_of(T.flag_members(df, df, {"a.b": "a.b"}, "in")) == sorted(
        [(1, 2, True), (None, 3, False)], key=repr
    )


def test_add_column(orders):
    changed = T.add_column(orders, "region", "string", "EMEA")
    assert changed.where("region = 'EMEA'").count() == 5
    assert T.add_column(orders, "score", "double").schema["score"].dataType.simpleString() == "double"
    with pytest.raises(ValueError, match="exists"):
        T.add_column(orders, "AMOUNT", "double")


def test_deduplicate_is_deterministic(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "z"), (None, "y"), (2, "c")],
                               "k int, v string")
    kept = T.deduplicate(df.repartition(3), ["k"], ["v"])
    assert rows_of(kept) == sorted([(1, "a"), (2, "c"), (None, "y")], key=repr)


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", None), ("b", 2)], "k string, t int")
    assert rows_of(T.latest_per_key(df, ["k"], "t")) == [("a", 3), ("b", 2)]


def test_update_from_join_never_fans_out(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, v string")
    lookup = spark.createDataFrame([(1, "B"), (1, "A"), (None, "N")], "id int, w string")
    changed = T.update_from_join(df, lookup, {"k": "id"}, {"v": F.concat("t.v", "s.w")})
    assert changed.schema == df.schema
    with pytest.raises(PySparkException, match="more than one lookup row"):
        T.update_from_join(df, lookup, {"k": "id"}, {"v": F.col("s.w")}, order=None).count()
    assert rows_of(changed) == sorted([(1, "xA"), (1, "yA"), (2, "z"), (None, "n")], key=repr)


def test_flag_members(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    members = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    flagged = T.flag_members(df, members, {"k": "id"}, "member")
    assert rows_of(flagged) == sorted([(1, True), (2, False), (None, False)], key=repr)
