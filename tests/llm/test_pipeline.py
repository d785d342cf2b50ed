"""The pipeline stage by stage against plain Python, and the registered queries."""

from __future__ import annotations

import duckdb
import pytest
import sentencepiece
from test_decontamination import smith_waterman, words
from test_line_dedup import brute as repeated_lines
from test_minhash import brute as components
from pyspark.sql import functions as F
from odd import no_docs, odd_docs  # noqa: F401

import __spark_entry__ as entrypoint
import corpus_pipeline as C
from drydock.llm import queries
from drydock.llm.common import stored

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into and comes out of every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame(
        [(10**6, "#### 1234 %%%", "en", "src0", 13), (10**6 + 1, None, "en", "src0", None),
         (10**6 + 2, "qxzv jkqx vvwq zzxk " * 40, "xx", "src0", 800)],
        docs.schema,
    )
    docs = stored(docs.unionByName(junk), "input")
    out = {}
    for name, stage in C.STAGES:
        result = stored(stage(spark, docs, SF), name)
        out[name] = (docs, result)
        docs = result
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_and_columns(stages):
    assert list(stages) == ["language", "lines", "near_duplicates", "decontamination", "tokens"]
    for name, (_, result) in stages.items():
        assert result.columns == COLUMNS or name == "tokens"


def test_only_junk_is_rejected(stages):
    before, after = stages["language"]
    assert {i for i, _ in rows(before)} - {i for i, _ in rows(after)} == {10**6, 10**6 + 1, 10**6 + 2}


def test_repeated_lines_go(stages):
    before, after = stages["lines"]
    lost = repeated_lines(rows(before), C.MIN_DOCS, 1, False)
    wanted = {
        i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in lost[i, t]) for i, t in rows(before)
    }
    assert dict(rows(after)) == wanted
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0


def test_one_near_duplicate_stays(stages):
    before, after = stages["near_duplicates"]
    component = {d: c for (d, _), (_, c) in components(rows(before), 5).items()}
    assert {i for i, _ in rows(after)} == {d for d, c in component.items() if d == c}


def test_leaks_go(spark, stages):
    before, after = stages["decontamination"]
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    wanted = set()
    for i, text in rows(before):
        passage, held = words(text), set(words(text))
        likely = [item for item in items if sum(w in held for w in item) >= len(item) / 2]
        if not any(smith_waterman(passage, item) >= len(item) / 2 for item in likely):
            wanted.add(i)
    assert {i for i, _ in rows(after)} == wanted and len(wanted) < before.count()


def test_tokens_are_those_of_the_model(stages):
    before, after = stages["tokens"]
    library = sentencepiece.SentencePieceProcessor(model_file=C.TOKENIZER)
    texts = dict(rows(before))
    for r in after.collect():
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip


def test_odd_documents_pass_every_stage(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in C.STAGES:
            result = stored(stage(spark, docs, SF), name)
            assert name == "tokens" or result.columns == docs.columns
            docs = result


def test_registered(spark):
    names = entrypoint.queries()
    assert [n for n in names if n.startswith("op")] == list(queries.QUERIES)
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    assert names["pipeline"] is C.run


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    result = queries.QUERIES[name](spark, SF)
    wanted = con.execute(queries.SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(result.columns)
    got = sorted(tuple(r[c] for c in columns) for r in result.collect())
    assert got == sorted(wanted.fetchall())
