from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F
from odd import no_docs, odd_docs  # noqa: F401

from drydock.llm import kd_sharding as K
from drydock.llm import queries


def dimensions():
    return [K.coordinate(F.col("source")), K.coordinate(F.col("lang")), F.col("doc_id")]


def shards_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r["shard"], []).append(r)
    return out


@pytest.mark.parametrize("shards", [1, 2, 5, 8])
def test_bytes_are_even_and_slots_gapless(spark, shards):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes = {r.doc_id: r.text.encode() for r in df.collect()}
    rows = K.kd_shards(df, dimensions(), shards=shards).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(sizes)
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(sizes[r["doc_id"]]) + 1, zlib.crc32(sizes[r["doc_id"]]))
    found = shards_of(rows)
    assert set(found) == set(range(shards))
    largest = max(r["size"] for r in rows)
    totals = [sum(r["size"] for r in part) for part in found.values()]
    assert max(totals) - min(totals) <= largest
    for part in found.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))


def test_target_bytes_give_the_number_of_leaves(spark):
    df = spark.range(1000).selectExpr("id AS doc_id", "repeat('x', 99) AS text", "'s' AS source", "'l' AS lang")
    found = shards_of(K.kd_shards(df, dimensions(), target_bytes=9000).collect())
    assert len(found) == 12
    assert all(len(part) <= 90 for part in found.values())


def test_splits_follow_the_widest_dimension(spark):
    """Two far ends of one dimension are parted before anything else."""
    rows = [(i, "t", 0 if i < 10 else 10**6, i % 3) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, x bigint, y bigint")
    found = shards_of(K.kd_shards(df, [F.col("x"), F.col("y")], shards=2).collect())
    assert [sorted(r["doc_id"] for r in found[s]) for s in (0, 1)] == [list(range(10)), list(range(10, 20))]


def test_a_group_of_copies_is_shared_out(spark):
    df = spark.range(900).selectExpr(
        "id AS doc_id", "if(id % 3 = 0, 'copy', concat('t', id)) AS text", "'hot' AS source", "'en' AS lang"
    )
    found = shards_of(K.kd_shards(df, dimensions(), shards=8).collect())
    assert max(len(p) for p in found.values()) < 140


def test_odd_texts_and_columns(odd_docs, no_docs):
    rows = K.kd_shards(odd_docs, dimensions(), shards=4).collect()
    assert len(rows) == odd_docs.count()
    null = [r for r in rows if r["doc_id"] == 0]
    assert [(r["size"], r["text_crc32"]) for r in null] == [(1, 0)]
    for part in shards_of(rows).values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    assert K.kd_shards(no_docs, dimensions(), shards=4).count() == 0


def test_the_query(spark):
    df = queries.op4_kd_sharding(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "law", "grown_shard"]
    assert {r["shard"] for r in df.collect()} == set(range(8))
