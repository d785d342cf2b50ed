"""Line dedup: repeated lines found by range-partitioned hashes, answered as keep bitmaps.

Lines become (hash, salt, document, position) rows. They are range-partitioned by hash and
salt with a secondary sort by document and position, so that one streaming pass per
partition sees every occurrence of a line in order: it counts documents and takes the
first occurrence. The salt (from the document) splits a line that a third of all
documents hold; the salted groups, at most ``salts`` rows a line, are then summed. What
comes back is one keep bitmap per document in run-length form, never text. The rows are
written once, for they are read by several steps and cost a pass over all texts.

Defined cases: a NULL or empty text is one empty line; a row is known by its id (NULL is
an id like any other) and its text, so repeated rows count as one document and all get the
same bitmap; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drydock.llm.common import BLANKS, ascii_lower, stored, text_key, whole_rows

SALTS = 64
GROUP = ["h1", "h2", "salt"]


def line_key(line: Column) -> Column:
    """The form in which lines are compared: stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashed_lines(df: DataFrame, id_col: str, text_col: str, min_chars: int, salts: int) -> DataFrame:
    """One row per line that can be dropped. Two seeds make a 128-bit hash."""
    key = line_key(F.col("line"))
    return (
        df.select(
            F.col(id_col).alias("doc"),
            text_key(F.col(text_col)).alias("tkey"),
            F.posexplode(_lines_of(F.col(text_col))).alias("pos", "line"),
        )
        .select("doc", "tkey", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select(
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(1), "key").alias("h2"),
            F.pmod(F.xxhash64("doc", "tkey"), F.lit(salts)).cast("int").alias("salt"),
            "doc",
            "tkey",
            "pos",
        )
    )


def _streamed_groups(lines: DataFrame) -> DataFrame:
    """Per hash and salt: number of documents and first occurrence, in one sorted pass."""
    ranged = lines.repartitionByRange(*GROUP).sortWithinPartitions(*GROUP, "doc", "tkey", "pos")
    in_order = Window.partitionBy(*GROUP).orderBy("doc", "tkey", "pos")
    document = F.struct("doc", "tkey")
    new_document = ~document.eqNullSafe(F.lag(document).over(in_order))
    return (
        ranged.withColumn("is_new", new_document.cast("long"))
        .groupBy(*GROUP)
        .agg(F.sum("is_new").alias("docs"), F.min(F.struct("doc", "tkey", "pos")).alias("first"))
    )


def keep_bitmaps(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 2,
    min_chars: int = 1,
    keep_first: bool = True,
    salts: int = SALTS,
) -> DataFrame:
    """Documents that lose lines: ``doc, tkey, dropped`` (positions, ascending).

    A line counts as repeated when its key has ``min_chars`` code points and stands in
    ``min_docs`` documents. ``keep_first`` keeps its first occurrence by document and position;
    otherwise every occurrence goes.
    """
    lines = stored(_hashed_lines(df, id_col, text_col, min_chars, salts), "lines")
    groups = _streamed_groups(lines)
    repeated = (
        groups.groupBy("h1", "h2")
        .agg(F.sum("docs").alias("docs"), F.min("first").alias("first"))
        .where(F.col("docs") >= min_docs)
        .drop("docs")
    )
    marked = groups.select(*GROUP).join(repeated, ["h1", "h2"])
    hits = lines.join(marked, GROUP)
    if keep_first:
        hits = hits.where(~F.struct("doc", "tkey", "pos").eqNullSafe(F.col("first")))
    return hits.groupBy("doc", "tkey").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """The keep bitmap in run-length form: ``array<struct<start, length>>`` of kept runs."""
    none = F.array().cast("array<int>")
    edges = F.concat(F.array(F.lit(-1)), F.coalesce(dropped, none), F.array(n_lines))
    runs = F.transform(
        F.sequence(F.lit(1), F.size(edges) - 1),
        lambda i: F.struct(
            (F.get(edges, i - 1) + 1).alias("start"),
            (F.get(edges, i) - F.get(edges, i - 1) - 1).alias("length"),
        ),
    )
    return F.filter(runs, lambda run: run["length"] > 0)


def _with_keep(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """Every row of ``df`` with ``__n_lines`` and ``__keep`` besides its own columns."""
    bitmaps = keep_bitmaps(df, id_col, text_col, **options).select(
        F.col("doc").alias("__doc"), F.col("tkey").alias("__tkey"), F.col("dropped").alias("__dropped")
    )
    keyed = df.withColumn("__own_tkey", text_key(F.col(text_col)))
    same = keyed[id_col].eqNullSafe(F.col("__doc")) & (F.col("__own_tkey") == F.col("__tkey"))
    n_lines = F.size(_lines_of(F.col(text_col)))
    return (
        keyed.join(bitmaps, same, "left")
        .withColumn("__n_lines", n_lines)
        .withColumn("__keep", keep_runs(F.col("__dropped"), F.col("__n_lines")))
        .drop("__doc", "__tkey", "__dropped", "__own_tkey")
    )


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that a keep bitmap leaves, joined by line feeds."""
    lines = _lines_of(text)
    return F.array_join(
        F.flatten(F.transform(keep, lambda run: F.slice(lines, run["start"] + 1, run["length"]))), "\n"
    )


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, ``n_lines``, ``n_dropped`` and ``keep``, the compressed bitmap."""
    kept = F.aggregate("__keep", F.lit(0), lambda total, run: total + run["length"])
    return _with_keep(df, id_col, text_col, **options).select(
        F.col(id_col),
        F.col("__n_lines").cast("long").alias("n_lines"),
        (F.col("__n_lines") - kept).cast("long").alias("n_dropped"),
        F.col("__keep").alias("keep"),
    )


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with the bitmaps applied to its texts; rows that lose no line stay as they are."""
    rows = _with_keep(whole_rows(df, id_col, text_col), "id", "text", **options)
    changed = F.size("__keep") != 1
    changed = changed | (F.col("__keep")[0]["length"] != F.col("__n_lines"))
    text = F.when(changed, kept_text(F.col("text"), F.col("__keep"))).otherwise(F.col("text"))
    return rows.select(*[
        text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns
    ])


def kept_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, ``n_lines``, ``n_dropped`` and the SHA-256 of the text that is left."""
    kept = F.aggregate("__keep", F.lit(0), lambda total, run: total + run["length"])
    return _with_keep(df, id_col, text_col, **options).select(
        F.col(id_col),
        F.col("__n_lines").cast("long").alias("n_lines"),
        (F.col("__n_lines") - kept).cast("long").alias("n_dropped"),
        F.sha2(kept_text(F.col(text_col), F.col("__keep")).cast("binary"), 256).alias("kept_sha256"),
    )
