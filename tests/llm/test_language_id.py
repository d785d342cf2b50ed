from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from odd import no_docs, odd_docs  # noqa: F401

from drydock.llm import language_id as L
from drydock.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return L.fit(docs.where("doc_id % 2 = 0").select("text", F.col("lang").alias("label")), L.LANGUAGES, 4000)


def identified(spark, rows, table, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, said string, site string, end string")
    found = L.identify(
        df, table, declared=F.col("said"), host=F.col("site"), suffix=F.col("end"), **options
    )
    return {r.doc_id: r for r in found.collect()}


def test_held_out_accuracy_of_texts_alone(spark, table):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 1")
    found = L.identify(docs, table).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    right = found.agg(F.avg((F.col("lang") == F.col("truth")).cast("double"))).first()[0]
    assert right >= 0.97
    assert found.where("NOT kept").count() == 0


def test_trigram_model_is_a_distribution(table):
    assert np.allclose(np.exp(table).sum(axis=0), 1.0)


ENGLISH = "The whole of that thing was in the hands of the other"


def test_short_texts_follow_the_other_evidence(spark, table):
    rows = [(i, ENGLISH, "en", "big.example.com", "com") for i in range(30)]
    rows += [(100 + i, "von der verschen und die einung mit der", "de", "netz.example.de", "de") for i in range(30)]
    rows += [(200, "q", None, "netz.example.de", "de"), (201, "q", None, "big.example.com", "com"),
             (202, "q", None, "new.example.de", "de"), (203, "q", "de", None, None), (204, "q", "en-GB", None, None)]
    found = identified(spark, rows, table)
    assert [found[i].lang for i in (200, 201, 202, 203, 204)] == ["de", "en", "de", "de", "en"]


def test_text_outweighs_a_wrong_declaration(spark, table):
    rows = [(1, " ".join([ENGLISH] * 5), "de", "x.de", "de"), (2, " ".join([ENGLISH] * 5), "de", "x.de", "de")]
    assert {r.lang for r in identified(spark, rows, table).values()} == {"en"}


def test_what_is_no_language_is_rejected(spark, table):
    rows = [(1, "xkcd qqzv wwxk zzqj vkxq " * 30, "en", "a", ""), (2, "0101 #### %%% 12345 " * 20, "en", "a", ""),
            (3, ENGLISH * 3, "en", "a", "")]
    found = identified(spark, rows, table)
    assert [found[i].kept for i in (1, 2, 3)] == [False, False, True]
    assert [found[i].lang for i in (1, 2)] == ["und", "und"]


def test_pages(spark):
    html = '<HTML xml:lang="x" LANG = "de-AT"><script>var x = "<p>";</script><!-- no --><p>Ein &amp; Text</p>'
    df = spark.createDataFrame(
        [(1, html, "HTTPS://user@WWW.Example.AT:80/x?y"), (2, "<p>t", "no address"), (3, None, None)],
        "page_id bigint, html string, url string",
    )
    columns = L.page_columns(F.col("html"), F.col("url"))
    rows = [tuple(r) for r in df.select(*[columns[c].alias(c) for c in ("declared", "host", "suffix")]).collect()]
    assert rows == [("de", "www.example.at", "at"), ("", None, None), (None, None, None)]
    assert df.select(columns["text"]).first()[0].split() == ["Ein", "Text"]


def test_long_texts_are_read_whole(spark, table, monkeypatch):
    text = "!" * 50000 + " " + ENGLISH * 50
    whole = L.text_scores([text, ENGLISH], table)
    monkeypatch.setattr(L, "PIECE", 997)
    cut = L.text_scores([text, ENGLISH], table)
    assert np.allclose(whole[0], cut[0], atol=0.02) and abs(whole[1] - cut[1]).max() <= 4


def test_odd_texts_and_columns(odd_docs, no_docs, table):
    found = L.identify(odd_docs, table, declared=F.col("lang"), host=F.col("host")).collect()
    assert len(found) == odd_docs.count()
    assert {(r.lang, r.kept) for r in found if r.letters == 0} == {("und", False)}
    kept = L.drop_undetermined(odd_docs, table=table, declared=F.col("lang"))
    assert kept.schema == odd_docs.schema and not {None, "", " "} & {r.text for r in kept.collect()}
    assert L.identify(no_docs, table).count() == 0
    assert L.fit(no_docs.select("text", F.col("lang").alias("label")), L.LANGUAGES, 10).shape == (L.HASHES, 4)


def test_the_query_covers_documents_and_pages(spark):
    rows = queries.op8_language_id(spark, SF).collect()
    docs = {r.doc_id: r for r in rows if r.doc_id is not None}
    pages = {r.page_id: r for r in rows if r.page_id is not None}
    assert (len(docs), len(pages)) == (1000, 250)
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    right = [f"/{pages[p].lang}/" in url for p, url in urls.items()]
    assert np.mean(right) > 0.9 and all(r.kept for r in docs.values())
