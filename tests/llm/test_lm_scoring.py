from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from odd import no_docs, odd_docs  # noqa: F401

from drydock.llm import lm_scoring as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def base_scores(rows):
    counts = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return n, [
        (d, held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)),
         sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)))
        for d, t in rows
    ]


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    found = L.score_documents(df).collect()
    n, wanted = base_scores(rows)
    key = lambda r: (str(r[0]), r[2], round(r[4], 3))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score) for r in found), key=key)
    for a, b in zip(got, sorted(wanted, key=key), strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9)
    assert {r.train_tokens for r in found} <= {n}
    assert all(math.isfinite(r.score) and r.score <= 0 for r in found)
    return found


def sentences(n):
    """Words that follow each other by a rule, which unigrams cannot know."""
    rng = random.Random(6)
    out = []
    for d in range(n):
        words, at = [], rng.randrange(30)
        for _ in range(rng.randint(5, 60)):
            words.append(f"w{at}")
            at = (at * 7 + rng.choice([1, 2])) % 30
        out.append((d, " ".join(words)))
    return out


def test_counts_and_held_out_likelihood(spark):
    df = spark.createDataFrame(sentences(600), "doc_id bigint, text string").repartition(3)
    found = check(df)
    for part in (True, False):
        rows = [r for r in found if r.held_out == part]
        gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
        assert gain > 0.1  # log10 a token


def test_real_documents_beat_unigrams_when_held_out(spark):
    found = check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = [r for r in found if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_probabilities_sum_to_one(spark):
    """Over all words seen and one unseen, after any context."""
    df = spark.createDataFrame(sentences(100), "doc_id bigint, text string")
    docs = df.select(F.col("doc_id").alias("doc"), L.held_out(F.col("doc_id")).alias("held"), "text")
    encoded = L.stored(L._encoded(docs), "encoded")
    counted = L.stored(L._counted(encoded, 7), "counted")
    classes = L._classes(counted, 7)
    model = L.fit(L._classified(encoded, counted, classes), classes, rounds=1)
    normalisers = model.normalisers()
    rng = np.random.default_rng(0)
    for _ in range(20):
        context = rng.integers(0, classes.number + 1, (1, L.CONTEXT))
        logs = model.predicted(context) @ model.outputs.T + model.biases - normalisers[context[0, 0], context[0, 1]]
        assert math.isclose(np.exp(logs).sum(), 1.0, rel_tol=1e-9)
        # empty classes have next to nothing
        assert np.exp(logs)[0, classes.masses == 0].sum() < 1e-6
    counts = [
        n for r in counted.where("chunk IS NULL").collect() for n, k in zip(r.numbers, r.times, strict=True) for _ in range(k)
    ]
    assert math.isclose(classes.masses.sum(), sum(c + 0.5 for c in counts) + 0.5)
    assert (classes.tokens, classes.types) == (sum(counts), len(counts))


def test_contexts():
    got = L.contexts_of(np.array([5, 6, 7, 8]), np.array([3, 1]), 9)
    assert got.tolist() == [[9, 9], [5, 9], [6, 5], [9, 9]]


def test_gradients_of_the_noise_contrastive_loss(monkeypatch):
    """A step goes where the loss falls fastest: compare with differences of the loss."""
    rng = np.random.default_rng(3)
    model = L.LogBilinear(6, rng.random(6) + 0.1)
    contexts, targets = rng.integers(0, 7, (40, 2)), rng.integers(0, 6, 40)
    trainer = L.Trainer(model, 0)
    noise = rng.integers(0, 6, L.NOISE)
    monkeypatch.setattr(trainer, "rng", type("R", (), {"choice": staticmethod(lambda *a, **k: noise)}))
    moves = {}
    monkeypatch.setattr(trainer, "_move", lambda which, rows, g: moves.__setitem__(which, (rows, g)))

    def loss():
        predicted = model.predicted(contexts)
        expected = np.log(L.NOISE * model.noise)
        target = (predicted * model.outputs[targets]).sum(axis=1) + model.biases[targets] - expected[targets]
        other = predicted @ model.outputs[noise].T + model.biases[noise] - expected[noise]
        return (np.log1p(np.exp(-target)) + np.log1p(np.exp(other)).sum(axis=1)).mean()

    trainer.step(contexts, targets)
    for which, parameter in enumerate(model.parameters()):
        rows, gradient = moves[which]
        full = np.zeros_like(parameter)
        full[rows] = gradient
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in parameter.shape)
            old = parameter[at]
            parameter[at] = old + 1e-5
            up = loss()
            parameter[at] = old - 1e-5
            down = loss()
            parameter[at] = old
            assert math.isclose(full[at], (up - down) / 2e-5, rel_tol=1e-3, abs_tol=1e-7)


def test_odd_texts_and_columns(odd_docs, no_docs):
    check(odd_docs)
    assert L.score_documents(no_docs).count() == 0


def test_without_training_documents(spark):
    ids = [i for i in range(200) if held(i)][:5]
    df = spark.createDataFrame([(i, "a b") for i in ids], "doc_id bigint, text string")
    assert {(r.n_known, r.train_tokens) for r in check(df)} == {(0, 0)}


def test_words_after_the_shortlist_have_vectors(spark):
    """Their order tells, though they are of like frequency."""
    df = spark.createDataFrame(sentences(600), "doc_id bigint, text string").repartition(3)
    rows = L.score_documents(df, shortlist=4, rounds=4).where("held_out").collect()
    assert sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows) > 0.1


def test_words_with_vectors_grow_with_the_tokens(spark, monkeypatch):
    monkeypatch.setattr(L, "GROWTH", 0.5)
    found = []
    for n in (200, 800):
        rows = [(d, " ".join(f"v{(d * 13 + i * i) % 997 % (3 + (d * 13 + i) % 97)}" for i in range(40))) for d in range(n)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        docs = df.select(F.col("doc_id").alias("doc"), L.held_out(F.col("doc_id")).alias("held"), "text")
        counted = L.stored(L._counted(L.stored(L._encoded(docs), "encoded"), 3), "counted")
        classes = L._classes(counted, 3)
        found.append(len(classes.words))
        assert (classes.words >= L.MIN_COUNT).all() and (np.diff(classes.words) <= 0).all()
    assert found[1] > 1.5 * found[0] > 0


def test_words_of_a_class_sum_to_one():
    rng = np.random.default_rng(4)
    model = L.LogBilinear(6, rng.random(6) + 0.1, np.arange(10, 0, -1), 4)
    predicted = rng.normal(size=(3, L.SIZE))
    for q in range(3):
        logs = model.log_words(predicted, np.full(10, q), np.arange(10))
        assert np.allclose(np.add.reduceat(np.exp(logs), [0, 4, 8]), 1.0)


def test_gradients_of_words(monkeypatch):
    """The same for words in classes, as a context and as a target."""
    rng = np.random.default_rng(5)
    model = L.LogBilinear(4, rng.random(4) + 0.1, np.arange(10, 0, -1), 4)
    n = 30
    contexts, targets = rng.integers(0, 5, (n, 2)), rng.integers(0, 4, n)
    context_words, words = rng.integers(0, 11, (n, 2)), rng.integers(0, 11, n)
    noise, share = rng.integers(0, 4, L.NOISE), rng.random((int((words < 10).sum()), L.WORD_NOISE))
    trainer, moves = L.Trainer(model, 0), {}
    fixed = {"choice": staticmethod(lambda *a, **k: noise), "random": staticmethod(lambda *a: share)}
    monkeypatch.setattr(trainer, "rng", type("R", (), fixed))
    monkeypatch.setattr(trainer, "_move", lambda which, rows, g: moves.__setitem__(which, (rows, g)))

    def loss():
        p = model.predicted(contexts, context_words)
        expected = np.log(L.NOISE * model.noise)
        seen = (p * model.outputs[targets]).sum(axis=1) + model.biases[targets] - expected[targets]
        other = p @ model.outputs[noise].T + model.biases[noise] - expected[noise]
        total = (np.log1p(np.exp(-seen)) + np.log1p(np.exp(other)).sum(axis=1)).sum()
        for i, drawn in zip(np.flatnonzero(words < 10), share, strict=True):
            lo = words[i] // 4 * 4
            size = min(4, 10 - lo)
            rows = [words[i], *(lo + (drawn * size).astype(int))]
            s = model.word_outputs[rows] @ p[i] + model.word_biases[rows] - np.log(L.WORD_NOISE / size)
            total += np.log1p(np.exp(-s[0])) + np.log1p(np.exp(s[1:])).sum()
        return total / n

    trainer.step(contexts, targets, context_words, words)
    for which, parameter in enumerate(model.parameters()):
        rows, gradient = moves[which]
        full = np.zeros_like(parameter)
        full[rows] = gradient
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in parameter.shape)
            if which == 4:
                at = (at[0] % 10, at[1])  # the last row stands for no word
            old = parameter[at]
            parameter[at] = old + 1e-5
            up = loss()
            parameter[at] = old - 1e-5
            down = loss()
            parameter[at] = old
            assert math.isclose(full[at], (up - down) / 2e-5, rel_tol=1e-3, abs_tol=1e-7)


def scored_model(n=700, words=300):
    rng = np.random.default_rng(8)
    model = L.LogBilinear(50, rng.random(50) + 0.1, np.arange(words, 0, -1), 20)
    placed = [rng.normal(size=(n, L.SIZE)) for _ in range(L.CONTEXT)]
    pairs = np.stack((rng.zipf(1.3, 20000) % n, rng.zipf(1.3, 20000) % n), axis=1)
    return model, placed, pairs


def test_pairs_share_their_exponentials(monkeypatch):
    """Normalisers of pairs are those of their predictions, for fewer exponentials than one row a pair."""
    monkeypatch.setattr(L, "COMMON", 40)
    model, placed, pairs = scored_model()
    pairs = np.unique(pairs, axis=0)
    wanted = model.log_classes(placed[0][pairs[:, 0]] + placed[1][pairs[:, 1]])
    rows, exp = [], np.exp
    counting = lambda x, *a, **k: (rows.append(len(x)), exp(x, *a, **k))[1]
    monkeypatch.setattr(L.np, "exp", counting)
    got = model.log_classes_of_pairs(placed, pairs)
    monkeypatch.undo()
    assert np.allclose(got, wanted, rtol=1e-9)
    assert sum(rows) < 0.7 * len(pairs)


def test_normalisers_of_large_scores(monkeypatch):
    """Products that single precision cannot hold are normalised as they are."""
    monkeypatch.setattr(L, "COMMON", 40)
    model, placed, pairs = scored_model()
    placed[0][:20] *= 300
    placed[1][:20] *= -300
    placed[0][20:30], placed[1][20:30] = 200 * model.outputs[1], 200 * model.outputs[2]
    wanted = model.log_classes(placed[0][pairs[:, 0]] + placed[1][pairs[:, 1]])
    single = [p.astype(np.float32) for p in placed]
    got = model.as_kind(np.float32).log_classes_of_pairs(single, pairs)
    assert np.allclose(got, wanted, rtol=1e-4, atol=1e-3)


def test_tokens_are_kept_as_codes_of_their_chunk(spark):
    """Two bytes a token, and a unit for each distinct word of a chunk: not four bytes a token."""
    df = spark.createDataFrame(sentences(600), "doc_id bigint, text string").coalesce(1)
    docs = df.select(F.col("doc_id").alias("doc"), L.held_out(F.col("doc_id")).alias("held"), "text")
    encoded = L.stored(L._encoded(docs), "encoded")
    counted = L.stored(L._counted(encoded, 7), "counted")
    rows = L._classified(encoded, counted, L._classes(counted, 7)).collect()
    tokens = sum(sum(r.lengths) for r in rows)
    assert sum(len(v) for r in rows for v in r.asDict().values() if isinstance(v, bytearray | bytes)) < 2.1 * tokens


def test_sums_by_row():
    rng = np.random.default_rng(9)
    trainer = L.Trainer(L.LogBilinear(30, rng.random(30) + 0.1), 0)
    for kind in (np.float32, np.float64):
        rows, values = rng.zipf(1.5, 500) % 31, rng.normal(size=(500, 6)).astype(kind)
        wanted = np.zeros((31, 6))
        np.add.at(wanted, rows, values)
        found, sums = trainer._sum_by(rows, values)
        assert sorted(found) == sorted(set(rows.tolist()))
        assert np.allclose(sums, wanted[found], atol=1e-5)


def test_runs_have_each_token_once_with_its_context(monkeypatch):
    monkeypatch.setattr(L, "BATCH", 4 * L.RUN)
    rng = np.random.default_rng(10)
    lengths = rng.integers(1, 90, 60)
    codes = rng.integers(0, 500, lengths.sum())
    found, sizes = [], []
    for text, before, tokens in L._runs(codes, lengths, 500, rng):
        found += np.column_stack((text[before], text[tokens])).tolist()
        sizes.append((len(text), len(tokens)))
        # At each place a position is in one context at most, which a step relies on.
        assert all(len(set(before[:, i].tolist())) == len(tokens) for i in range(L.CONTEXT))
    wanted = np.column_stack((L.contexts_of(codes, lengths, 500), codes)).tolist()
    assert sorted(found) == sorted(wanted)
    assert max(n for _, n in sizes) <= L.BATCH
    # Tokens that follow each other share what is gathered: not CONTEXT rows for each.
    assert sum(n for n, _ in sizes) < 1.2 * (len(codes) + L.CONTEXT * len(lengths))


def test_steps_on_texts_move_parameters_as_steps_on_contexts():
    rng = np.random.default_rng(11)
    codes, lengths = rng.integers(0, 16, 90), np.array([1, 40, 30, 19])
    text, before, tokens = next(L._runs(codes, lengths, 16, rng))
    kinds, words = np.minimum(np.arange(17), 6), np.concatenate((np.full(6, 10), np.arange(10), [10]))
    kinds[6:16] = 3 + np.arange(10) // 4
    models = []
    for whole in (True, False):
        model = L.LogBilinear(6, np.arange(6) + 0.5, np.arange(10, 0, -1), 4)
        trainer = L.Trainer(model, 12)
        if whole:
            trainer.step_in(kinds[text], words[text], before, kinds[text[tokens]], words[text[tokens]])
        else:
            trainer.step(kinds[text[before]], kinds[text[tokens]], words[text[before]], words[text[tokens]])
        models.append(model.rows())
    assert np.allclose(*models, atol=1e-9)


def test_chunks_scored_together_share_their_exponentials(monkeypatch):
    """The same log-probabilities as of each chunk alone, for fewer exponentials; every chunk is in one pool."""
    rng = np.random.default_rng(13)
    number, width = 50, 20
    counts = np.arange(300, 0, -1)
    model = L.LogBilinear(number, rng.random(number) + 0.1, counts, width)
    classes = L.Classes(np.zeros(1), np.zeros(0), np.ones(number), 0, 0, 0, 30, width, counts)
    every, rows = np.concatenate((np.arange(30), number + 1 + np.arange(300))), []
    for _ in range(4):
        units = np.sort(rng.choice(every, 250, replace=False))
        lengths = rng.integers(1, 400, 10)
        codes = (rng.zipf(1.3, lengths.sum()) % len(units)).astype(np.uint16)
        rows.append({"units": L._packed(units.astype(np.uint32)), "codes": L._packed(codes), "lengths": lengths.tolist()})
    assert [len(p) for p in L._pools(iter(rows))] == [4]
    monkeypatch.setattr(L, "POOL", 1)
    assert [len(p) for p in L._pools(iter(rows))] == [1] * 4
    done, exp = [], np.exp
    counting = lambda x, *a, **k: (done.append(x.size), exp(x, *a, **k))[1]
    monkeypatch.setattr(L.np, "exp", counting)
    alone = [L.log_probabilities(model, classes, *L._joined([row])) for row in rows]
    apart = sum(done)
    done.clear()
    together = L.log_probabilities(model, classes, *L._joined(rows))
    monkeypatch.undo()
    assert np.allclose(together, np.concatenate(alone), rtol=1e-9)
    assert sum(done) < 0.8 * apart


def test_log_probabilities_by_plain_python():
    """The score of each token, written out from the parameters."""
    rng = np.random.default_rng(14)
    counts = np.arange(10, 0, -1)
    model = L.LogBilinear(6, rng.random(6) + 0.1, counts, 4)
    classes = L.Classes(np.zeros(1), np.zeros(0), np.ones(6), 0, 0, 0, 2, 4, counts)
    units, lengths = np.array([0, 1, 5, *range(7, 17)]), np.array([1, 25, 7])
    codes = rng.integers(0, len(units), lengths.sum())
    found, at = L.log_probabilities(model, classes, units, codes, lengths), 0
    for n in lengths:
        before = [6, 6]  # the class before a text's first token
        for unit in units[codes[at : at + n]]:
            predicted = np.zeros(L.SIZE)
            for i in range(L.CONTEXT):
                u = before[-1 - i]
                vector = model.inputs[u] if u <= 6 else model.inputs[2 + (u - 7) // 4] + model.own[u - 7]
                predicted = predicted + vector @ model.places[i]
            scores = [predicted @ model.outputs[c] + model.biases[c] for c in range(6)]
            kind = unit if unit < 6 else 2 + (unit - 7) // 4
            wanted = scores[kind] - math.log(sum(map(math.exp, scores)))
            if unit > 6:
                lo = (unit - 7) // 4 * 4
                inner = {w: predicted @ model.word_outputs[w] + model.word_biases[w] for w in range(lo, min(lo + 4, 10))}
                wanted += inner[unit - 7] - math.log(sum(map(math.exp, inner.values())))
            assert math.isclose(found[at], wanted, rel_tol=1e-9)
            before.append(unit)
            at += 1


def test_words_of_large_classes_share_their_exponentials(monkeypatch):
    """Normalised as words one by one are, for fewer exponentials."""
    rng = np.random.default_rng(15)
    counts = np.arange(40, 0, -1)
    model = L.LogBilinear(6, rng.random(6) + 0.1, counts, 20)
    classes = L.Classes(np.zeros(1), np.zeros(0), np.ones(6), 0, 0, 0, 3, 20, counts)
    units, lengths = np.array([0, 1, 2, 5, *range(7, 47)]), rng.integers(1, 300, 20)
    codes = rng.integers(0, len(units), lengths.sum())
    exp, found = np.exp, []
    for shared in (10**9, 1):
        monkeypatch.setattr(L, "SHARED", shared)
        done = []
        monkeypatch.setattr(L.np, "exp", lambda x, *a, done=done, **k: (done.append(x.size), exp(x, *a, **k))[1])
        found.append((L.log_probabilities(model, classes, units, codes, lengths), sum(done)))
    monkeypatch.undo()
    assert np.allclose(found[0][0], found[1][0], rtol=1e-9)
    assert found[1][1] < 0.7 * found[0][1]


def test_distinct_pairs(monkeypatch):
    rng = np.random.default_rng(16)
    contexts = rng.integers(0, 31, (500, 2))
    for units in (30, 1 << 30):  # packed with their places, and too large for it
        pairs, where = L._distinct_pairs(contexts, units)
        assert (pairs[where] == contexts).all() and len(pairs) == len(set(map(tuple, contexts.tolist())))
        assert (np.diff(pairs[:, 1]) >= 0).all()
