from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from drydock.llm import ann as A
from drydock.llm import queries


def brute(rows, asks, k):
    """Exact nearest rows by inner product, ties to the smaller id."""
    out = {}
    for q, x in rows:
        if asks(q):
            scored = [(-float(np.dot(np.array(x), np.array(y))), v) for v, y in rows if v != q and len(x) == len(y)]
            out[q] = [(v, -s) for s, v in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for rows in out.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    return {q: [(v, s) for _, v, s in rows] for q, rows in out.items()}


@pytest.mark.parametrize("dimensions", [3, 50, 64])
def test_recall_on_vectors_without_structure(spark, dimensions):
    rng = np.random.default_rng(dimensions)
    rows = [(i, rng.normal(size=dimensions).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = found(A.nearest(df, F.col("vec_id") % 30 == 0))
    units = [(i, (np.array(x) / np.linalg.norm(x)).tolist()) for i, x in rows]
    exact = brute(rows, lambda i: i % 30 == 0, 20)
    assert set(got) == set(exact)
    recall = np.mean([len({v for v, _ in got[q]} & {v for v, _ in exact[q]}) / 20 for q in exact])
    assert recall >= 0.85 and units  # lengths differ here, which buckets do not see
    vectors = dict(rows)
    for q, rows_ in got.items():
        for v, score in rows_:
            assert math.isclose(score, float(np.dot(vectors[q], vectors[v])), rel_tol=1e-9, abs_tol=1e-12)
        assert rows_ == sorted(rows_, key=lambda r: (-r[1], r[0]))


def test_recall_of_the_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    exact = brute(rows, lambda i: i % 20 == 0, 20)
    got = found(queries.op7_nearest(spark, "/root/testdata/sf0.01"))
    assert {q: len(r) for q, r in got.items()} == {q: 20 for q in exact}
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in exact[q]}) / 20 for q in exact]) >= 0.9


def test_all_probes_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = found(A.nearest(df, F.col("vec_id") < 10, k=7, tables=1, probed=256))
    exact = brute(rows, lambda i: i < 10, 7)
    assert {q: [v for v, _ in r] for q, r in got.items()} == {q: [v for v, _ in r] for q, r in exact.items()}


def test_many_equal_vectors_tie_by_id(spark, monkeypatch):
    monkeypatch.setattr(A, "PART", 64)
    rng = np.random.default_rng(2)
    common = rng.normal(size=16).astype(np.float32).tolist()
    rows = [(i, common if i % 3 == 0 else rng.normal(size=16).astype(np.float32).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = found(A.nearest(df, F.col("vec_id") % 300 == 0))
    for q, found_rows in got.items():
        assert [v for v, _ in found_rows] == [i for i in range(0, 1200, 3) if i != q][:20]
        assert len({s for _, s in found_rows}) == 1


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 0.0]),
        (7, [1.0, 2.0, 3.0]), (8, [-1.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.0]),
        (10, [1e-200, 0.0]), (11, [1e150, 1e150]), (12, [1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("id", F.lit("x"))
    got = found(A.nearest(df, F.lit(True)))
    assert got[0] == [(11, 1e150), (9, 1.0), (10, 1e-200), (8, -1.0)]
    assert set(got) == {0, 8, 9, 10, 11}  # 7 and 12 have nothing of their length beside them
    assert A.nearest(df.limit(0), F.lit(True)).count() == 0
    assert A.nearest(df, F.lit(None).cast("boolean")).count() == 0


def test_rotation_keeps_lengths_and_probes_begin_with_the_bucket():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 24))
    turned = A.rotated(x, 3)
    assert turned.shape == (50, 32)
    assert np.allclose((turned**2).sum(axis=1), (x**2).sum(axis=1))
    assert np.array_equal(np.stack(A.probes(x, 3, 1))[:, :, 0], np.stack(A.buckets(x, 3)))
    first, second = A.probes(x, 3, 5)
    assert (np.stack(A.buckets(x, 3))[:, :, None] == np.stack((first, second))).all(axis=0).any(axis=1).all()
    assert not np.allclose(A.rotated(x, 4), turned)


def test_queries_get_all_they_can_have(spark, monkeypatch):
    """Few vectors of a length: buckets do not hold enough, and the others make it up."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=64 if i % 10 else 48).tolist()) for i in range(140)]
    rows += [(1000 + i, rng.normal(size=128).tolist()) for i in range(25)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for part in (A.PART, 8):
        monkeypatch.setattr(A, "PART", part)
        got = found(A.nearest(df, F.lit(True)))
        exact = brute(rows, lambda i: True, 20)
        assert {q: len(r) for q, r in got.items()} == {q: len(r) for q, r in exact.items()}
        for q in got:
            if q >= 1000 or q % 10 == 0:  # 24 and 13 candidates
                assert len(got[q]) == (20 if q >= 1000 else 13)
        assert all([v for v, _ in got[q]] == [v for v, _ in exact[q]] for q in got if q % 10 == 0 and q < 1000)


def test_share_of_rows_scored_falls_as_rows_grow():
    """The same recall on vectors without structure, from a smaller share of more vectors."""
    shares = {}
    for n in (2000, 100_000):
        units = A._unit(np.random.default_rng(n).normal(size=(n, 64)))
        asking = units[:40]
        exact = np.argpartition(-(asking @ units.T), 21, axis=1)[:, :21]
        seen = np.zeros((len(asking), n), bool)
        for table in range(A.TABLES):
            first, second = A.buckets(units, table)
            probed = A.probes(asking, table, A.number_of_probes(n, 64))
            for i, (one, two) in enumerate(zip(*probed, strict=True)):
                looked = np.zeros((128, 128), bool)
                looked[one, two] = True
                seen[i] |= looked[first, second]
        recall = np.mean([seen[i, exact[i]].mean() for i in range(len(asking))])
        assert recall >= 0.9
        shares[n] = seen.mean()
    assert shares[2000] < 0.35 and shares[100_000] < shares[2000] / 2, shares
