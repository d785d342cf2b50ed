"""Sharding by a k-d tree over document metadata, split at distributed weighted medians.

Every node splits along the dimension in which its documents spread widest (as a share
of the whole table's spread) at the byte-weighted median, until leaves reach the target
bytes. Medians are found by histograms: each round sums bytes per node and bin on the
executors, the driver picks the bin that holds the median, and the next round looks into
that bin only. Documents that tie in the dimension are ordered by a hash. The driver sees at
most ``BINS`` sums for each node and the tree itself, which is as large as the number of
shards; the tables it broadcasts are that tree. Documents are never moved to be counted.

Defined cases: a NULL text has no bytes and counts as one; NULL metadata is one value of its
own; repeated rows are rows like any other; an empty table gives no rows; other columns are
left alone. Equal texts may lie in different shards, else a group of copies with a third
of all bytes could not be spread evenly.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drydock.llm.common import inline_table, stored

BINS = 1024
#: Hashes that serve as coordinates are below this.
SPAN = 1 << 62
#: A bin with this share of a shard's bytes is not looked into any further.
TOLERANCE = 1 / 4096
#: Documents of a shard are numbered in so many parts at once.
SLOT_PARTS = 256


def coordinate(column: Column) -> Column:
    """A categorical value as a number: equal values lie together, and none lie between."""
    hashed = F.shiftrightunsigned(F.xxhash64(column.cast("string")), 2)
    return F.when(column.isNull(), F.lit(-1).cast("long")).otherwise(hashed)


@dataclass
class Node:
    """A node on its way to a cut: documents at or above (value, lo) go right."""

    number: int
    leaves: int
    dimension: int
    lo: int
    hi: int
    want: float
    weight: int
    below: int = 0
    in_ties: bool = False
    value: int = 0
    done: bool = False

    @property
    def width(self) -> int:
        return max(1, ceil((self.hi - self.lo) / BINS))

    def narrow(self, bins: list[tuple[int, int]], tolerance: float) -> None:
        """Take the bin that holds the median, or cut at its nearer edge if it is small."""
        at = self.below
        for number, weight in bins:
            if at + weight >= self.want:
                break
            at += weight
        else:
            at -= weight
        left, width = self.lo + number * self.width, self.width
        if weight <= tolerance or (width == 1 and self.in_ties):
            nearer = left if self.want - at <= at + weight - self.want else left + width
            self.done = True
            self.value, self.lo = (self.value, nearer) if self.in_ties else (nearer, 0)
            return
        self.below = at
        if width > 1:
            self.lo, self.hi = left, min(self.hi, left + width)
        else:
            self.value, self.in_ties, self.lo, self.hi = left, True, 0, SPAN


def _points(df: DataFrame, id_col: str, text_col: str, dimensions: list[Column]) -> DataFrame:
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    at = [F.coalesce(d.cast("long"), F.lit(-1).cast("long")) for d in dimensions]
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.array(*at).alias("at"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.crc32(body)), 2).alias("tie"),
        F.lit(1).cast("long").alias("node"),
    )


def _placed(points: DataFrame, levels: list[list[Node]]) -> DataFrame:
    """Points moved from the root below the cuts made so far; a node without a cut is a leaf."""
    out = points
    for cuts in levels:
        table = inline_table(
            points.sparkSession,
            [(n.number, n.dimension, n.value, n.lo) for n in cuts],
            "node long, dimension int, value long, tie_cut long",
        )
        here = F.get("at", F.col("dimension"))
        goes_right = (here > F.col("value")) | (
            (here == F.col("value")) & (F.col("tie") >= F.col("tie_cut"))
        )
        child = F.when(F.col("dimension").isNull(), F.col("node")).otherwise(
            2 * F.col("node") + goes_right.cast("long")
        )
        out = out.join(F.broadcast(table), "node", "left").withColumn("node", child).select(*points.columns)
    return out


def _histograms(placed: DataFrame, cutting: list[Node]) -> dict[int, list[tuple[int, int]]]:
    """Bytes per node and bin of the range in which the node's median lies."""
    table = inline_table(
        placed.sparkSession,
        [(n.number, n.dimension, n.in_ties, n.value, n.lo, n.hi, n.width) for n in cutting],
        "node long, dimension int, in_ties boolean, value long, lo long, hi long, width long",
    )
    here = F.get("at", F.col("dimension"))
    key = F.when(F.col("in_ties"), F.col("tie")).otherwise(here)
    sums = (
        placed.join(F.broadcast(table), "node")
        .where(~F.col("in_ties") | (here == F.col("value")))
        .withColumn("key", key)
        .where((F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi")))
        .withColumn("bin", F.expr("(key - lo) div width"))
        .groupBy("node", "bin")
        .agg(F.sum("size").alias("weight"))
    )
    found: dict[int, list[tuple[int, int]]] = {}
    for node, number, weight in sorted(tuple(r) for r in sums.collect()):
        found.setdefault(node, []).append((number, weight))
    return found


def _spreads(placed: DataFrame, dimensions: int, numbers: list[int]) -> dict[int, tuple]:
    """Per node: bytes, then smallest and largest coordinate of each dimension."""
    ends = [
        f(F.get("at", F.lit(d))).alias(f"{f.__name__}{d}") for d in range(dimensions) for f in (F.min, F.max)
    ]
    rows = (
        placed.where(F.col("node").isin(numbers))
        .groupBy("node")
        .agg(F.sum("size").alias("bytes"), *ends)
        .collect()
    )
    return {row[0]: (row[1], [(row[2 + 2 * d], row[3 + 2 * d]) for d in range(dimensions)]) for row in rows}


def kd_tree(
    points: DataFrame, dimensions: int, target_bytes: int | None = None, shards: int | None = None
) -> tuple[list[list[Node]], list[int]]:
    """The cuts by level, and the leaves from left to right.

    The number of leaves is ``shards``, or follows from the total and ``target_bytes``.
    """
    first = _spreads(_placed(points, []), dimensions, [1])
    if not first:
        return [], [1]
    total, whole = first[1]
    shards = shards or max(1, ceil(total / target_bytes))
    target = total / shards
    levels: list[list[Node]] = []
    parts, leaves = {1: shards}, []
    while parts:
        leaves += [number for number, n in parts.items() if n == 1]
        parts = {number: n for number, n in parts.items() if n > 1}
        placed = _placed(points, levels)
        spreads = _spreads(placed, dimensions, list(parts)) if parts else {}
        leaves += [number for number in parts if number not in spreads]
        cuts = []
        for number, (weight, ends) in spreads.items():
            share = [
                (hi - lo) / max(1, top - low) for (lo, hi), (low, top) in zip(ends, whole, strict=True)
            ]
            widest = share.index(max(share))
            lo, hi = ends[widest]
            n = parts[number]
            cuts.append(Node(number, n, widest, lo, hi + 1, weight * (n // 2) / n, weight))
        while cutting := [n for n in cuts if not n.done]:
            histograms = _histograms(placed, cutting)
            for node in cutting:
                node.narrow(histograms[node.number], TOLERANCE * target)
        if cuts:
            levels.append(cuts)
        parts = {
            2 * n.number + side: n.leaves // 2 if side == 0 else n.leaves - n.leaves // 2
            for n in cuts
            for side in (0, 1)
        }
    return levels, sorted(leaves, key=lambda number: bin(number)[3:])


def kd_shards(
    df: DataFrame,
    dimensions: list[Column],
    target_bytes: int | None = None,
    shards: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: ``doc_id, size, text_crc32, shard, slot``; slots count from 0 in each shard."""
    points = stored(_points(df, id_col, text_col, dimensions), "points")
    levels, leaves = kd_tree(points, len(dimensions), target_bytes, shards)
    number = F.create_map(*[F.lit(x).cast(t) for i, leaf in enumerate(leaves) for x, t in ((leaf, "long"), (i, "int"))])
    placed = (
        _placed(points, levels)
        .withColumn("shard", F.element_at(number, F.col("node")))
        .withColumn("part", F.pmod("tie", F.lit(SLOT_PARTS)))
    )
    parts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("before")
    )
    in_part = Window.partitionBy("shard", "part").orderBy("tie", "doc_id", "text_crc32")
    numbered = placed.withColumn("in_part", F.row_number().over(in_part) - 1)
    return numbered.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("in_part")).cast("long").alias("slot")
    )
