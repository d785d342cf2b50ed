"""Columns with the names of the operators' own helpers come through every stage as they are."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from drydock.llm import decontamination, language_id, line_dedup, minhash, queries

NAMES = [
    "__keep", "__n_lines", "__tkey", "__own_tkey", "__id", "__doc", "__dropped", "row", "id", "tkey", "listed_id",
    "listed_tkey", "kept", "node", "leads", "a.b", "q`q", "first", "text_key",
]
PROSE = "the quick brown fox jumps over the lazy dog while the old man reads his paper by the river and waits for the rain "


@pytest.fixture
def named(spark):
    rows = [(i, f"{PROSE * 3}\nown line {i} {'x' * i}\nthe same line", "en", "host") for i in range(12)]
    rows += [(20, "zzzz", None, "host"), (21, None, "en", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.select("*", *[F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")).alias(n) for i, n in enumerate(NAMES)])


def language(df):
    table = language_id.fit(df.select("text", F.col("lang").alias("label")), language_id.LANGUAGES, 100)
    return language_id.drop_undetermined(df, table=table, declared=F.col("lang"), host=F.col("source"))


STAGES = {
    "language": language,
    "lines": lambda df: line_dedup.drop_repeated_lines(df, min_docs=10, keep_first=False),
    "near_duplicates": lambda df: minhash.drop_near_duplicates(df, width=5, percent=80),
    "decontamination": lambda df: decontamination.drop_contaminated(
        df, df.sparkSession.createDataFrame([(1, PROSE)], "item_id bigint, text string")
    ),
}


@pytest.mark.parametrize("stage", sorted(STAGES))
def test_columns_stay(named, stage):
    left = STAGES[stage](named)
    assert left.schema.names == named.schema.names
    rows = left.collect()
    for row in rows:
        assert list(row)[4:] == [f"{i}-{row.doc_id}" for i in range(len(NAMES))]
    if stage == "lines":
        assert {r.text for r in rows if r.doc_id == 3} == {"own line 3 xxx"}
        assert len(rows) == 14


def test_one_of_rows_that_differ_elsewhere(spark):
    """Of rows with one id and text the kept one does not depend on their order."""
    rows = [(1, "a b c d e f", i) for i in range(8)]
    kept = {
        minhash.drop_near_duplicates(
            spark.createDataFrame(order, "doc_id bigint, text string, x int").repartition(4), width=2
        ).collect()[0].x
        for order in (rows, rows[::-1])
    }
    assert kept == {0}


def test_repeated_rows_are_one_document_in_query_and_sql(spark, tmp_path):
    rows = [(1, "twelve times\nx")] * 12 + [(i, f"ten ids\n{i}") for i in range(2, 12)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(path)
    wanted = duckdb.sql(queries.LINE_DEDUP_SQL.replace("FROM documents", f"FROM read_parquet('{path}/*.parquet')"))
    got = queries.op10_line_dedup(spark, str(tmp_path)).select(wanted.columns).collect()
    assert sorted(map(tuple, got)) == sorted(wanted.fetchall())
    assert {r.n_dropped for r in got if r.doc_id == 1} == {0} and {r.n_dropped for r in got if r.doc_id > 1} == {1}
