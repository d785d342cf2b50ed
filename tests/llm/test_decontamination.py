from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F
from odd import no_docs, odd_docs  # noqa: F401

from drydock.llm import decontamination as D


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())


def smith_waterman(passage, item):
    best, row = 0, [0] * (len(passage) + 1)
    for word in item:
        new = [0] * (len(passage) + 1)
        for j in range(1, len(passage) + 1):
            match = row[j - 1] + (1 if passage[j - 1] == word else -1)
            new[j] = max(0, match, row[j] - 1, new[j - 1] - 1)
            best = max(best, new[j])
        row = new
    return best


def test_alignment_is_smith_waterman():
    rng = random.Random(2)
    for _ in range(300):
        passage = [rng.randint(0, 5) for _ in range(rng.randint(0, 25))]
        item = [rng.randint(0, 5) for _ in range(rng.randint(1, 12))]
        score, first, end = D.align(np.array(passage, np.int64), np.array(item, np.int64))
        assert score == smith_waterman(passage, item)
        if score:
            assert 0 <= first < end <= len(passage)
            assert smith_waterman(passage[first:end], item) == score


def prose(rng, n):
    return [rng.choice(["the", "of", "and", "a"]) if rng.random() < 0.4 else f"w{rng.randint(0, 5000)}" for _ in range(n)]


def edited(rng, passage, share):
    out = []
    for word in passage:
        if rng.random() < share:
            out += rng.choice([[], [f"e{rng.randint(0, 999)}"], [word, "really"]])
        else:
            out.append(word)
    return out


def planted(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randint(8, 50))) for i in range(20)]
    docs = []
    for d in range(120):
        body = prose(rng, rng.randint(5, 300))
        if d % 3 == 0:
            passage = edited(rng, items[d % 20][1], rng.choice([0, 0.05, 0.1]))
            at = rng.randint(0, len(body))
            body = body[:at] + passage + body[at:]
        docs.append((d, " ".join(body)))
    return docs, [(i, " ".join(w)) for i, w in items]


def test_against_brute_force(spark):
    docs, items = planted(1)
    wanted = {}
    for d, text in docs:
        for i, item in items:
            score = smith_waterman(words(text), words(item))
            if score / len(words(item)) >= 0.5:
                wanted[d, i] = score
    got = {
        (r.doc_id, r.item_id): r.score
        for r in D.contaminated(
            spark.createDataFrame(docs, "doc_id bigint, text string"),
            spark.createDataFrame(items, "item_id bigint, text string"),
        ).collect()
    }
    assert got == wanted and len(wanted) >= 35


def test_punctuation_and_case_hide_nothing(spark):
    item = "Zarquon velt ombrik, sansel druvo; mirtle pax."
    docs = [(1, "Before. ZARQUON -- velt (ombrik) sansel\ndruvo 'mirtle' pax! After."), (2, "velt ombrik only"),
            (3, "zarquon velt ombrik sansel druvo mirtle pax")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    rows = {r.doc_id: r for r in D.contaminated(df, bench).collect()}
    assert set(rows) == {1, 3}
    assert (rows[1].similarity, rows[1].first_word, rows[1].end_word) == (1.0, 1, 8)
    assert [r.doc_id for r in D.drop_contaminated(df, bench).collect()] == [2]


def test_short_items_and_common_words(spark):
    """An item of two words is a seed of its own; one of common words only gives all n-grams."""
    rng = random.Random(0)
    docs = [(d, " ".join(prose(rng, 200))) for d in range(20)] + [(20, "x quux frob y"), (21, "to be or not to be a of")]
    items = [(1, "Quux frob"), (2, "the of and the of and a the of"), (3, ""), (4, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = D.contaminated(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert (20, 1) in {(r.doc_id, r.item_id) for r in got}
    assert {r.item_id for r in got} <= {1, 2}


def test_odd_texts_and_columns(spark, odd_docs, no_docs):
    bench = odd_docs.select(F.col("doc_id").alias("item_id"), "text").distinct()
    rows = D.contaminated(odd_docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} >= {(5, 6), (None, 5), (7, 7), (9, 9), (10, 10)}
    assert len({(r.doc_id, r.tkey, r.item_id) for r in rows}) == len(rows)
    kept = D.drop_contaminated(odd_docs, bench)
    assert kept.schema == odd_docs.schema and {r.text for r in kept.collect()} <= {None, "", " ", "\n", "\n\n \t\n", "\x00\x01"} | {"▁ ▁"}
    assert D.contaminated(no_docs, bench).count() == 0
    assert D.drop_contaminated(odd_docs, bench.limit(0)).count() == odd_docs.count()


def test_a_passage_in_every_document(spark):
    item = " ".join(f"rare{i}" for i in range(20))
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"start {item} end "), F.col("id")).alias("text"))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = D.contaminated(df, bench)
    assert rows.count() == 2000 and rows.where("similarity = 1").count() == 2000
