"""A corpus pipeline over ``documents``: every stage is an operator of ``drydock.llm``.

Stages, each written as Parquet and read again as the next one's input:

1. ``language``: documents whose language cannot be told go.
2. ``lines``: lines that stand in at least 10 documents go from all of them.
3. ``near_duplicates``: of documents linked by five-word shingles with a similarity of 0.8 or
   more, the one with the smallest id stays.
4. ``decontamination``: documents that hold a copy of a benchmark item go.
5. ``tokens``: token ids, and whether they decode to the very text.

The first four return the columns of ``documents``. Defined cases are those of the operators; an
extra column of ``documents`` is carried along, whatever its name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drydock.llm import decontamination, language_id, line_dedup, minhash, pieces
from drydock.llm.common import load, stored

#: Executors still hold what earlier stages took, so a worker of the last stage takes less.
REMEMBERED, INDEXED = 24 << 20, 1 << 16
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
MIN_DOCS = 10


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = docs.select("text", F.col("lang").alias("label"))
    table = language_id.fit(labelled, language_id.LANGUAGES, language_id.SAMPLE_ROWS)
    return language_id.drop_undetermined(
        docs, table=table, declared=F.col("lang"), host=F.col("source")
    )


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.drop_repeated_lines(docs, min_docs=MIN_DOCS, keep_first=False)
    return left.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = pieces.load_model(TOKENIZER)
    found = pieces.tokenised(docs, F.col("text"), model, "doc_id", remembered=REMEMBERED, indexed=INDEXED)
    return found.select("row.doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


#: Trained models, shingle links and alignments have no SQL; tests compare with brute force.
ORACLE_SQL: str | None = None
