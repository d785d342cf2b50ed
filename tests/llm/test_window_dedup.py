from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from odd import no_docs, odd_docs  # noqa: F401

from drydock.llm import queries
from drydock.llm import window_dedup as W


def brute(rows, width):
    """Per row: words, how many go, and what is left, by counting every window."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    windows = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for (key, _), words in zip(rows, split):
        gone = set()
        for i in range(len(words) - width + 1):
            if windows[tuple(words[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((key, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=repr)


def found(df):
    rows = df.collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    return sorted(((r[0], r.n_words, r.n_removed, r.kept) for r in rows), key=repr)


@pytest.mark.parametrize("period", range(1, 25))
def test_covers_have_every_difference(period):
    cover = W.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert period < 13 or len(cover) <= 6


@pytest.mark.parametrize("width", [1, 4, 16, 35])
@pytest.mark.parametrize("chunk", [300, 1 << 20])
def test_same_as_counting_all_windows(spark, width, chunk):
    rng = random.Random(width)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = [f"{rng.choice('wwwW')}{rng.randrange(40 if i % 3 else 4)}" for _ in range(rng.randrange(90))]
        if i % 4 == 0:
            cut, at = rng.randrange(20), rng.randrange(len(words) + 1)
            words[at:at] = passage[cut : cut + rng.choice([width - 1, width, width + 3])]
        if i % 10 == 0:
            words += words
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(100 + i, rows[5][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert found(W.repeated_windows(df, width, chunk_bytes=chunk)) == brute(rows, width)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert found(W.repeated_windows(odd_docs)) == brute(rows, 35)
    assert found(W.repeated_windows(no_docs)) == []
    named = odd_docs.selectExpr("CAST(doc_id AS string) AS chunk", "text AS body", "1 AS at", "2 AS hash")
    assert len(found(W.repeated_windows(named, 2, "chunk", "body"))) == len(rows)
    with pytest.raises(ValueError, match="at least one word"):
        W.repeated_windows(odd_docs, 0)


def test_one_row_a_third_of_all(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text)] * 100 + [(i, f"{i} {text[:150]} {i} x" * 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    assert found(W.repeated_windows(df, chunk_bytes=2000)) == brute(rows, 35)


def test_sent_rows_do_not_follow_the_partitions(spark, conf):
    """What chunks send depends on bytes, not on how many shuffle partitions there are."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(200)
    digests = set()
    for partitions in ("3", "40"):
        conf(shuffle__partitions=partitions)
        rows = W.repeated_windows(df, chunk_bytes=100_000).collect()
        digests.add(hashlib.sha256(repr(sorted((r.doc_id, r.n_removed, r.kept) for r in rows)).encode()).hexdigest())
    assert len(digests) == 1


def test_query_equals_its_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    wanted = duckdb.sql(queries.SQL["op13_window_dedup"])
    got = queries.op13_window_dedup(spark, sf_dir)
    assert sorted(got.columns) == sorted(wanted.columns)
    assert sorted(map(tuple, got.select(*wanted.columns).collect())) == sorted(wanted.fetchall())
