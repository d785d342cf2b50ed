from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as format_
from odd import no_docs, odd_docs  # noqa: F401

from drydock.llm import pieces as P
from drydock.llm.queries import TOKENIZER

MODEL = P.load_model(TOKENIZER)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
ENCODER, DECODER = P.Encoder(MODEL), P.Decoder(MODEL)


def check(texts):
    got = ENCODER.encode(texts)
    for text, ids, wanted in zip(texts, got, LIBRARY.encode(texts), strict=True):
        assert ids.tolist() == wanted, text
        assert DECODER.decode(wanted) == LIBRARY.decode(wanted)
        if P.BLANK not in text:
            assert DECODER.decode(wanted) == text


def test_blanks_and_repetitions():
    check([" " * n for n in range(60)])
    check([" " * a + "the" + " " * b + "x" for a in range(0, 40, 3) for b in range(0, 40, 7)])
    check([c * n for c in "a-=\n\t漢🙂" for n in (1, 2, 3, 15, 16, 17, 64, 333)])


def test_random_texts():
    rng = random.Random(7)
    alphabet = "abc xyzéß 漢字かな🙂\t\n  ▁  \x00​ theingABC012___---"
    check(["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(1500)])


@settings(max_examples=100, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text(text):
    check([text])


def test_documents_decode_to_themselves(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("text", P.encode(F.col("text"), MODEL).alias("ids")).withColumn(
        "back", P.decode(F.col("ids"), MODEL)
    ).collect()
    assert all(r.back == r.text for r in rows)
    assert [r.ids for r in rows] == LIBRARY.encode([r.text for r in rows])


def test_both_ways_in_one_pass(spark, odd_docs, monkeypatch):
    named = odd_docs.select("doc_id", "text", F.lit(1).alias("ids"), F.lit(2).alias("row"), F.lit("x").alias("decoded"))
    rows = P.tokenised(named, F.col("text"), MODEL, "doc_id", "ids", "text").collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        text = r.row.text
        assert r.ids == (None if text is None else LIBRARY.encode(text)) and r.row.ids == 1
        assert r.round_trip == (r.decoded == text) and (r.round_trip or P.BLANK in text)
    assert P.tokenised(named.limit(0), F.col("text"), MODEL).collect() == []


def test_a_worker_keeps_a_bounded_number_of_bytes(monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 40_000)
    encoder, rng = P.Encoder(MODEL), random.Random(5)
    for _ in range(30):
        texts = [" ".join(rng.choice("aeiou") * rng.randrange(1, 9) + str(rng.randrange(2000)) for _ in range(60))]
        assert [x.tolist() for x in encoder.encode([*texts, "the same again"])] == LIBRARY.encode([*texts, "the same again"])
        assert sum(P.ENTRY for half in (encoder.memo.young, encoder.memo.old) for _ in half) <= 45_000
        assert "▁again" in encoder.memo.young or "▁again" in encoder.memo.old


def test_odd_texts(odd_docs, no_docs):
    rows = odd_docs.withColumn("ids", P.encode(F.col("text"), MODEL)).withColumn("back", P.decode(F.col("ids"), MODEL)).collect()
    for r in rows:
        assert r.ids is None and r.back is None if r.text is None else r.ids == LIBRARY.encode(r.text)
        if r.text is not None and P.BLANK not in r.text:
            assert r.back == r.text
    assert no_docs.select(P.encode(F.col("text"), MODEL)).count() == 0


def test_long_segments_and_small_batches(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(5000)), "漢字" * 2000]
    check(texts)
    monkeypatch.setattr(P, "INDEXED", 64)
    monkeypatch.setattr(P, "REMEMBERED", 2000)
    monkeypatch.setattr(P, "VERDICTS", 64)
    encoder = P.Encoder(MODEL)
    texts = [" ".join(rng.choice(["the", "thing", "inner", "Ünder"]) + str(i) for i in range(40)) for _ in range(20)]
    assert [x.tolist() for x in encoder.encode(texts)] == LIBRARY.encode(texts)


def unigram(tmp_path, fallback):
    """A unigram model written by hand (nothing is trained)."""
    proto = format_.ModelProto()
    for piece, score, kind in [
        ("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("ab", -5.0, 1),
        ("▁a", -4.2, 1), ("ba", -6.0, 1), ("aba", -7.7, 1), ("▁ab", -6.1, 1), ("c", -9.0, 1), ("bc", -9.5, 1),
    ] + [(f"<0x{i:02X}>", -20.0, 6) for i in range(256 if fallback else 0)]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    proto.trainer_spec.model_type = 1
    proto.trainer_spec.byte_fallback = fallback
    proto.trainer_spec.unk_id, proto.trainer_spec.bos_id, proto.trainer_spec.eos_id = 0, 1, -1
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = not fallback
    path = tmp_path / f"hand{fallback}.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_models_take_the_best_sum(tmp_path, fallback):
    path = unigram(tmp_path, fallback)
    encoder, decoder = P.Encoder(P.load_model(path)), P.Decoder(P.load_model(path))
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice("aabbc  z") for _ in range(rng.randint(0, 14)))
        (ids,) = encoder.encode([text])
        wanted = library.encode(text)
        scores = [library.get_score(i) for i in range(library.get_piece_size())]
        best = sum(scores[i] for i in wanted if i >= 2)
        if "z" not in text:
            assert np.isclose(sum(scores[i] for i in ids.tolist()), best), text
            assert decoder.decode(ids.tolist()) == library.decode(wanted)
        if fallback:
            assert decoder.decode(ids.tolist()) == text


@pytest.mark.parametrize("broken", [False, True])
def test_equal_runs_get_one_number(monkeypatch, broken):
    """Also where hashes tell nothing apart: then the codes decide."""
    if broken:
        monkeypatch.setattr(P, "mix", lambda x: x * np.uint64(0))
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 4, 200)
    starts, codes = np.cumsum(lengths) - lengths, rng.integers(0, 3, lengths.sum()).astype(np.uint32)
    number, sample = P.alike(codes, starts, lengths)
    runs = [tuple(codes[a : a + n].tolist()) for a, n in zip(starts, lengths)]
    assert len({(r, n) for r, n in zip(runs, number.tolist())}) == len(set(runs)) == len(sample)
    assert [runs[i] for i in sample[number]] == runs


def test_suffix_array_and_occurrences():
    rng = np.random.default_rng(4)
    codes = rng.integers(1, 4, 300)
    order = P.suffix_array(codes, 300)
    tails = [codes[i:].tolist() for i in order]
    assert tails == sorted(tails)
    pieces = np.zeros((5, 4), np.int64)
    for row, piece in enumerate([[1], [2, 1], [3, 3, 1], [1, 2, 3, 1], [9]]):
        pieces[row, : len(piece)] = piece
    at, found = P.occurrences(codes, pieces, np.array([1, 2, 3, 4, 1]))
    text = "".join(map(str, codes))
    wanted = {(i, k) for k, p in enumerate(["1", "21", "331", "1231", "9"]) for i in range(300) if text.startswith(p, i)}
    assert set(zip(at.tolist(), found.tolist(), strict=True)) == wanted
