"""Scratch tables and small column helpers that the operators share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words and are stripped from lines (fixed by the contracts).
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="llm-scratch-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only in an unset local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return _own_folder()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def text_key(text: Column) -> Column:
    """A 64-bit key that tells apart rows of one id with different texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def whole_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (all columns), ``id``, ``text`` and ``tkey``: helpers beside a row never meet its own names."""
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    own = {c: F.col("`" + c.replace("`", "``") + "`") for c in (id_col, text_col)}
    return df.select(
        F.struct(*columns).alias("row"), own[id_col].alias("id"), own[text_col].alias("text"),
        text_key(own[text_col]).alias("tkey"),
    )


def rows_listed(df: DataFrame, listed: DataFrame, how: str, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` whose id and text key are ``listed`` ('left_semi'), or are not ('left_anti')."""
    found = listed.select(F.col(id_col).alias("listed_id"), F.col("tkey").alias("listed_tkey")).distinct()
    same = F.col("id").eqNullSafe(F.col("listed_id")) & (F.col("tkey") == F.col("listed_tkey"))
    return whole_rows(df, id_col, text_col).join(found, same, how)


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few literal rows, made in the plan itself."""
    fields = [field.split() for field in schema.split(", ")]
    structs = [
        F.struct(*[F.lit(x).cast(kind).alias(name) for x, (name, kind) in zip(row, fields, strict=True)])
        for row in rows
    ]
    kind = f"array<struct<{','.join(f'{name}:{kind}' for name, kind in fields)}>>"
    return spark.range(1).select(F.inline(F.array(*structs).cast(kind)))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
