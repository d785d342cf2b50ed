from __future__ import annotations

import math

import numpy as np
import pytest

from drydock.llm import queries
from drydock.llm import whitening as W


def wanted(rows, k=16):
    """What the contract says, by whole-number arithmetic and numpy's own eigenvalues."""
    good = [
        (key, [math.floor(64 * float(c)) + 1_000_000 for c in vector]) for key, vector in rows
        if vector and all(c is not None and math.isfinite(c) for c in vector)
    ]
    out = {}
    for length in {len(x) for _, x in good}:
        own = [(key, x) for key, x in good if len(x) == length]
        fit = sorted({tuple(x) for _, x in own})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        centre = lambda x: np.array([(n * c - s) / n for c, s in zip(x, sums)])
        a = np.array([centre(x) for x in fit])
        values, vectors = np.linalg.eigh(a.T @ a / n)
        keep = [i for i in np.argsort(-values) if values[i] > 1e-9][:k]
        for key, x in own:
            out.setdefault(key, []).append((
                n, sum((n * c - s) ** 2 for c, s in zip(x, sums)),
                [float(centre(x) @ vectors[:, i] / math.sqrt(values[i])) for i in keep],
                [float(values[i] / values.sum()) for i in keep],
            ))
    return out


def check(df, rows, k=16):
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, []).append(r)
    exact = {key: own for key, own in wanted(rows, k).items() if any(x[2] for x in own)}
    assert set(got) == set(exact)
    signs = {}
    for key, own in exact.items():
        if len(own) > 1:
            assert len(got[key]) == sum(len(x[2]) for x in own)
            continue
        [(n, deviation, whitened, explained)] = own
        mine = sorted(got[key], key=lambda r: r.component)
        assert [r.component for r in mine] == list(range(1, len(whitened) + 1))
        for r, w, e in zip(mine, whitened, explained):
            assert (r.n, r.deviation) == (n, deviation if deviation < 1 << 63 else None)
            assert math.isclose(r.explained, e, rel_tol=1e-9)
            assert r.identity_error < 1e-9
            assert math.isclose(abs(r.whitened), abs(w), rel_tol=1e-6, abs_tol=1e-7)
            if abs(w) > 1e-3:
                assert signs.setdefault((n, r.component), r.whitened * w > 0) == (r.whitened * w > 0)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def test_cholesky_and_jacobi_give_the_eigenvalues():
    rng = np.random.default_rng(3)
    for d, rank in ((1, 1), (2, 2), (7, 3), (40, 40), (33, 12)):
        a = rng.normal(size=(rank, d)) * 10.0 ** rng.integers(-1, 2, size=d)
        matrix = a.T @ a
        factor = W.pivoted_cholesky(matrix)
        assert factor.shape == (d, rank)
        assert np.allclose(factor @ factor.T, matrix, rtol=1e-9, atol=1e-12 * matrix.max())
        values, units = W.components(matrix, d)
        assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:rank], rtol=1e-8)
        assert np.abs(units @ units.T - np.eye(rank)).max() < 1e-12
        assert np.allclose(units @ matrix, values[:, None] * units, rtol=1e-6, atol=1e-9 * values[0])


@pytest.mark.parametrize("n", range(9))
def test_rounds_meet_every_pair_once(n):
    pairs = [pair for left, right in W.rounds(n) for pair in zip(left.tolist(), right.tolist())]
    assert sorted(pairs) == [(a, b) for a in range(n) for b in range(a + 1, n)]


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_same_as_numpy(spark, sent):
    rng = np.random.default_rng(sent)
    base = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 20)) + rng.normal(size=(300, 20)) * 0.3
    rows = [(i, x.tolist()) for i, x in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # many copies of one
    rows += [(2000 + i, rng.normal(size=3).tolist()) for i in range(50)]  # another length
    check(W.whitened(vectors(spark, rows).repartition(4), sent=sent), rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0, -inf]), (6, [1.0, 2.0]), (6, [1.0, 2.0]),
        (6, [3.0, 2.0]), (None, [0.5, 7.0]), (7, [1.0, 2.0, 3.0]), (8, [1.0, 2.0, 3.0]), (9, [5.0]), (10, [6.0]),
        (11, [6.004]), (12, [0.0] * 70000),
    ]
    df = vectors(spark, rows).selectExpr("vec_id", "embedding", "1 AS length", "2 AS id", "3 AS y", "4 AS n", "5 AS component")
    check(W.whitened(df), rows[:-1])
    check(W.whitened(df, k=1), rows[:-1], 1)
    assert W.whitened(df.limit(0)).collect() == []


def test_large_entries_are_exact_or_left_out(spark):
    rows = [(1, [1e9, 1.0]), (2, [-1e9, 2.0]), (3, [2e9, 0.25]), (4, [3.0, 4.0])]
    check(W.whitened(vectors(spark, rows)), rows)
    huge = [*rows, (5, [1e300, 0.0])]
    assert {r.vec_id for r in W.whitened(vectors(spark, huge)).collect()} == {1, 2, 3, 4}
    wide = [(i, [float(1 << 40) * i, 1.0]) for i in range(5)]
    assert {r.deviation for r in W.whitened(vectors(spark, wide)).collect()} <= {None, 0}


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    df = queries.op11_whitening(spark, sf_dir)
    assert df.dtypes == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
        ("explained", "double"), ("identity_error", "double"),
    ]
    check(df, rows)
