from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from odd import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from drydock.llm import queries
from drydock.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    """Scores of all pairs by the contract's formula."""
    counts = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    held = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, body), count, n in zip(docs, counts, sizes):
            m = 100 - 75 + 75 * n * n_docs // n_terms if n else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * (10**9 * count[t] // (1000 * count[t] + 8 * m))
                for t in terms(text) if t in count
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, i, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_same_as_scoring_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BATCH", 64)
    rng = random.Random(block)
    words = [f"w{i}" for i in range(60)] + ["Über", "É", "x1", "12"]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text(n):
        return rng.choice([" ", "-", ", "]).join(rng.choices(words, weights, k=n))

    docs = [(i, text(rng.randrange(60))) for i in range(500)] + [(1000 + i, "w1 w2 W3") for i in range(30)]
    items = [(i, text(rng.randrange(12))) for i in range(40)] + [(40, None), (41, "nothing-here"), (42, "w1 w1 w2")]
    got = R.ranked(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3),
        spark.createDataFrame(items, "item_id bigint, text string"), k=7, block_bytes=block,
    )
    assert found(got) == brute(docs, items, 7)


def test_bounds_leave_out_pairs(spark):
    """Whole parts of a batch are left out once the best are known, and the result is the same."""
    scored = []

    class Counting(R.Best):
        def _score(self, impacts, documents, node, item):
            scored.append((node.hi - node.lo) * (item.hi - item.lo))
            super()._score(impacts, documents, node, item)

    rng = random.Random(1)
    texts = [" ".join(f"t{rng.randrange(20) + 20 * (i % 10)}" for _ in range(30)).encode() for i in range(600)]
    asked = texts[:40]
    import numpy as np

    vocabulary = np.unique(R.words_in(asked, R.PUNCTUATION_TABLE)[0])
    _, rows = R.counted(texts, vocabulary)
    weights = np.ones(len(vocabulary))
    rows.values = rows.values * 10
    items = R.Items([str(i) for i in range(40)], R.counted(asked, vocabulary)[1], weights)
    order, nodes = R.tree(rows, weights, R.DOCS)
    dense = np.zeros((len(texts), len(vocabulary)))
    dense[np.repeat(np.arange(len(texts)), np.diff(rows.starts)), rows.terms] = rows.values
    best = Counting(items, 5)
    best.search(dense[order], [(False, int(i), 0) for i in order], nodes)
    assert 0 < sum(scored) < 0.4 * 40 * 600
    exact = R.counted(asked, vocabulary)[1]
    for key, own in zip(items.keys, best.lists):
        i = int(key)
        at, _ = exact.places(np.array([i]))
        scores = dense[:, exact.terms[at]] @ exact.values[at].astype(float)
        wanted = sorted((-s, d) for d, s in enumerate(scores) if s > 0)[:5]
        assert [(x[0], x[2]) for x in own] == wanted


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    items = [(1, "a b"), (1, "a b"), (None, "w"), (2, None), (3, "X" * 20000), (4, "ß 漢字 🙂 d"), (5, "!?")]
    asked = spark.createDataFrame(items, "item_id bigint, text string").selectExpr(
        "item_id", "text", "1 AS key", "2 AS body", "3 AS rank", "4 AS score", "5 AS doc_id"
    )
    assert found(R.ranked(odd_docs, asked)) == brute(docs, items, 10)
    assert found(R.ranked(no_docs, asked)) == []
    assert found(R.ranked(odd_docs, asked.limit(0))) == []
    named = odd_docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("tkey"), F.lit(1).alias("n"))
    assert R.ranked(named, asked, id_col="id", text_col="tkey").count() == len(brute(docs, items, 10))


def test_query_equals_its_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    for table in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    wanted = duckdb.sql(queries.SQL["op12_ranked_search"])
    got = queries.op12_ranked_search(spark, sf_dir)
    assert sorted(got.columns) == sorted(wanted.columns)
    rows = sorted(map(tuple, got.select(*wanted.columns).collect()))
    assert rows == sorted(wanted.fetchall()) and rows
