"""Substring dedup over words: difference-cover anchors, extended to whole windows.

A word goes if a window of ``width`` words around it also starts anywhere else, in the same document
or in another. To move as little as possible, windows are not sent as they are:

1. A *difference cover* is a set of residues modulo a period such that every difference of two
   positions is one between members. Of two equal windows, at any two positions, some offset
   below the period is therefore a cover position in both, and the words from there on, an
   *anchor* of ``width - period + 1`` words, lie in both. Only anchors at cover positions are hashed
   (5 of 21 for 35 words).
2. Anchors are counted over all documents. A window without an anchor that stands
   elsewhere too cannot be repeated.
3. The other windows are extended from their anchors to the whole ``width`` and counted in turn, by 96 bits
   of two polynomial hashes over word hashes.
4. Words that repeated windows cover are left out.

Documents are dealt into chunks of a few MB. A chunk sends each distinct anchor or window once, so a
passage that a third of all documents hold is one row a chunk, and gets back
the numbers of those that other chunks have as well. Counting is a native shuffle of such rows; no group of
documents or pairs ever meets in one task. Rows are dealt by their id, text and input partition, so
that many copies of one row are no group either.

Defined cases: a NULL text has no words; a text with fewer than ``width`` words keeps all of them; rows
that repeat, ids included, are documents of their own, so they lose their windows; ids may be
NULL and of any type; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from drydock.llm.common import BLANKS
from drydock.llm.words import mix, words_in

WIDTH = 35
#: Words of an anchor, at least, where windows are long enough to allow a cover.
ANCHOR = 15
#: Bytes of text in a chunk, about; and bits that number what a chunk sends.
CHUNK = 4 << 20
ENTRY_BITS = 32
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
#: Bytes as they are hashed: blanks part words, all others stand for themselves.
EXACT = np.arange(1, 257, dtype=np.uint16)
EXACT[np.frombuffer(BLANKS.encode(), np.uint8)] = 0


@lru_cache(maxsize=8)
def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues between whose members every difference occurs."""
    size = 1
    while size * (size - 1) + 1 < period:
        size += 1
    while True:
        for rest in itertools.combinations(range(1, period), size - 1):
            members = (0, *rest)
            if len({(a - b) % period for a in members for b in members}) == period:
                return members
        size += 1


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, np.uint64(base)), np.full(n, np.uint64(pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words:
    """The words of a chunk's texts as hashes, one text after the other.

    ``place`` is a word's number in its text, ``left`` how many words of the text begin there.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.hashes, self.offsets = words_in(texts, EXACT)
        counts = np.diff(self.offsets)
        self.place = np.arange(len(self.hashes)) - np.repeat(self.offsets[:-1], counts)
        self.left = np.repeat(counts, counts) - self.place
        self.total = np.repeat(counts, counts)

    def runs(self, starts: np.ndarray, width: int, base: int) -> np.ndarray:
        """Hashes of the ``width`` words from each start on."""
        up, down = _powers(base, 1 << (len(self.hashes) + 1).bit_length())
        sums = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum(self.hashes * up[: len(self.hashes)], out=sums[1:])
        return mix((sums[starts + width] - sums[starts]) * down[starts])


class Ranked:
    """Hashes numbered in their own order, so that the numbers do not depend on that of rows.

    ``number`` is each one's number, ``sample`` a place of each number, ``several`` whether it occurs twice.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray | None = None) -> None:
        order = np.argsort(first, kind="stable")
        fresh = self._fresh(order, first)
        if second is not None and (second[order][1:] != second[order][:-1])[~fresh[1:]].any():
            order = np.lexsort((second, first))
            fresh = self._fresh(order, first, second)
        self.number = np.empty(len(first), np.int64)
        self.number[order] = np.cumsum(fresh) - 1
        self.sample = order[fresh]
        self.several = np.diff(np.append(np.flatnonzero(fresh), len(first))) > 1

    @staticmethod
    def _fresh(order: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([h[order][1:] != h[order][:-1] for h in hashes], axis=0)
        return fresh

    def elsewhere(self, replies: pa.Table) -> np.ndarray:
        """Which numbers occur twice, here or (as ``replies`` say) in another chunk."""
        found = self.several.copy()
        for entries in replies.column("entries"):
            found[entries.values.to_numpy()] = True
        return found


def _texts(table: pa.Table) -> list[bytes]:
    return table.column("body").to_pylist()


def _in_other_chunks(sent: DataFrame, *key: str) -> DataFrame:
    """Per chunk the numbers of what other chunks sent too. A chunk sends a key once."""
    chunks = F.count(F.lit(1)).over(Window.partitionBy(*key))
    found = sent.withColumn("chunks", chunks).where(F.col("chunks") > 1)
    entry = F.col("at").bitwiseAND(F.lit((1 << ENTRY_BITS) - 1)).cast("int")
    chunk = F.shiftright("at", ENTRY_BITS).alias("chunk")
    return found.groupBy(chunk).agg(F.collect_list(entry).alias("entries"))


def repeated_windows(
    df: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK
) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed``, ``spans`` (the runs of words that go, ``start`` and ``end``) and
    ``kept``, the words that are left, joined by one space.
    """
    if width < 1:
        raise ValueError("a window has at least one word")
    period = max(1, width - ANCHOR + 1)
    cover = np.zeros(period, bool)
    cover[list(difference_cover(period))] = True
    anchor = width - period + 1

    body: Column = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    total = df.agg(F.sum(F.octet_length(body))).first()[0] or 0
    chunks = total // chunk_bytes + 1
    docs = df.select(
        F.pmod(F.xxhash64(F.lit(13), id_col, body, F.spark_partition_id()), F.lit(chunks)).alias("chunk"),
        F.col(id_col).alias("doc"),
        body.alias("body"),
    ).repartition("chunk")

    def anchors_of(words: Words) -> tuple[np.ndarray, Ranked]:
        starts = np.flatnonzero(cover[words.place % period] & (words.left >= anchor) & (words.total >= width))
        return starts, Ranked(words.runs(starts, anchor, BASES[0]))

    def windows_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, Ranked]:
        starts = np.flatnonzero(words.left >= width)
        first, second = (words.runs(starts, width, base) for base in BASES)
        second = second.astype(np.uint32)
        return starts, first, second, Ranked(first, second)

    def place(table: pa.Table, entries: np.ndarray) -> np.ndarray:
        return (table.column("chunk")[0].as_py() << ENTRY_BITS) + entries

    def tell(table: pa.Table) -> pa.Table:
        words = Words(_texts(table))
        starts, ranked = anchors_of(words)
        hashes = words.runs(starts[ranked.sample], anchor, BASES[0])
        return pa.table({"hash": hashes.view(np.int64), "at": place(table, np.arange(len(hashes)))})

    def extend(table: pa.Table, replies: pa.Table) -> pa.Table:
        words = Words(_texts(table))
        starts, anchors = anchors_of(words)
        repeated = np.zeros(len(words.hashes) + 1, np.int64)
        repeated[starts[anchors.elsewhere(replies)[anchors.number]] + 1] = 1
        repeated = np.cumsum(repeated)
        starts, first, second, windows = windows_of(words)
        near = repeated[starts + period] > repeated[starts]
        entries = np.unique(windows.number[near])
        sample = windows.sample[entries]
        return pa.table({
            "hash": first[sample].view(np.int64), "check": second[sample].view(np.int32), "at": place(table, entries),
        })

    def mark(table: pa.Table, replies: pa.Table) -> pa.Table:
        texts = _texts(table)
        words = Words(texts)
        starts, _, _, windows = windows_of(words)
        gone = starts[windows.elsewhere(replies)[windows.number]]
        edges = np.zeros(len(words.hashes) + 1, np.int64)
        edges[gone] += 1
        edges[gone + width] -= 1
        covered = np.cumsum(edges)[:-1] > 0
        n_removed, spans, kept = [], [], []
        for text, lo, hi in zip(texts, words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
            own, parts = covered[lo:hi], text.split()
            runs = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))).reshape(-1, 2)
            n_removed.append(int(own.sum()))
            spans.append([{"start": a, "end": b} for a, b in runs.tolist()])
            kept.append(b" ".join(itertools.compress(parts, (~own).tolist()) if len(runs) else parts))
        arrays = [table.column("doc"), np.diff(words.offsets), n_removed, spans, pa.array(kept, pa.binary())]
        return pa.Table.from_arrays(
            [pa.chunked_array([pa.array(a, f.type)]) if not isinstance(a, pa.ChunkedArray) else a.cast(f.type)
             for a, f in zip(arrays, out_arrow, strict=True)],
            schema=out_arrow,
        )

    out = docs.select(
        "doc", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"), F.col("body").alias("kept"),
    ).schema
    out_arrow = to_arrow_schema(out)
    anchors = docs.groupBy("chunk").applyInArrow(tell, "hash long, at long")
    windows = docs.groupBy("chunk").cogroup(_in_other_chunks(anchors, "hash").groupBy("chunk")).applyInArrow(
        extend, "hash long, check int, at long"
    )
    marked = docs.groupBy("chunk").cogroup(_in_other_chunks(windows, "hash", "check").groupBy("chunk")).applyInArrow(
        mark, out
    )
    return marked.select(F.col("doc").alias(id_col), "n_words", "n_removed", "spans", F.col("kept").cast("string"))
