"""MinHash near-dedup by min-max hashing, with links confirmed on whole shingle sets.

Every permutation gives two signature values, its minimum and its maximum, so a signature
of 104 values takes 52 hash evaluations of each shingle; both collide with probability J.
Minima and maxima are banded apart, four to a band: two sets with J = 0.8 share none of the 26
bands with a probability of 1e-6.

Texts with equal sets collapse into one node first, so exact copies cost nothing further.
In each bucket of a band the nodes are then compared with one node of it (a star, never all
pairs), and once more with another. A bucket whose nodes end in one component has nothing left to
tell. In those that still hold several components, the nodes outside the largest of them are
compared with all others, as only links across components can still change the result. That
is done in blocks of ``PART`` nodes, and what comes out is one link at most from a node to
a component, never the pairs. So a group that hangs together costs its size, no candidate
is dropped, and hot nodes meet in joins that adaptive execution can split.

Defined cases: NULL, empty and blank texts have no shingles and are linked with nothing; a text of
fewer words than a shingle is one shingle; a row is known by its id (NULL is an id like any
other) and text; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drydock.llm.common import rows_listed, stored, text_key
from drydock.llm.components import components
from drydock.llm.words import batches, mix, shingles_of, words_of

BAND_ROWS = 4
BANDS = 26
#: Nodes of a bucket that are compared as one block, and matching shingles counted at once.
PART = 512
HITS = 1 << 21
#: Shingles permuted at once; small enough for the processor's cache.
BLOCK = 1 << 16


def shingle_sets(texts, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, offsets = words_of(texts)
    return [np.unique(shingles_of(hashes[a:b], width)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n], seeds[n:] | np.uint64(1)


def min_max_signatures(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """One row per (not empty) set: the minima under all permutations, then the maxima."""
    flips, factors = _permutations(permutations)
    out = np.empty((len(sets), 2 * permutations), np.uint64)
    start = 0
    while start < len(sets):
        stop, size = start, 0
        while stop < len(sets) and (size == 0 or size + len(sets[stop]) <= BLOCK):
            size += len(sets[stop])
            stop += 1
        block = np.concatenate(sets[start:stop])
        firsts = np.concatenate(([0], np.cumsum([len(s) for s in sets[start : stop - 1]]))).astype(np.int64)
        for k in range(permutations):
            x = block ^ flips[k]
            x *= factors[k]
            out[start:stop, k] = np.minimum.reduceat(x, firsts)
            out[start:stop, permutations + k] = np.maximum.reduceat(x, firsts)
        start = stop
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band; the band's number is part of it."""
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands)).copy()
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    for i in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys


def _set_ids(sets: list[np.ndarray]) -> list[bytes | None]:
    """128 bits that tell sets apart: two sums over well-mixed shingles."""
    return [
        np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)]).tobytes()
        if len(s)
        else None
        for s in sets
    ]


def _signed(df: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """Per row: id, text key, set size, node (the set's id) and its band keys."""
    permutations = -(-bands * rows // 2)

    def sign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column("text").to_pylist()
            for a, b in batches(texts):
                sets = shingle_sets(texts[a:b], width)
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(min_max_signatures(full, permutations), bands, rows).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        frame.column("doc").slice(a, b - a),
                        frame.column("tkey").slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(_set_ids(sets), pa.binary()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc", "tkey", "n_shingles", "node", "bands"],
                )

    kind = df.schema["doc"].dataType.simpleString()
    return df.mapInArrow(sign, f"doc {kind}, tkey long, n_shingles long, node binary, bands array<long>")


def _sets(df: DataFrame, width: int) -> DataFrame:
    """``node, shingles`` of the rows of ``df(node, text)``."""

    def build(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column("text").to_pylist()
            for a, b in batches(texts):
                packed = [s.tobytes() for s in shingle_sets(texts[a:b], width)]
                yield pa.RecordBatch.from_arrays(
                    [frame.column("node").slice(a, b - a), pa.array(packed, pa.binary())],
                    names=["node", "shingles"],
                )

    return df.mapInArrow(build, "node binary, shingles binary")


def _linked(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose sets have 100 * intersection >= percent * union."""
    small = pairs
    for side in ("u", "v"):
        small = small.join(sizes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}")), side)
    possible = 100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")
    joined = small.where(possible).select("u", "v")
    for side in ("u", "v"):
        joined = joined.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s_{side}")), side)

    def confirm(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            left, right = frame.column("s_u"), frame.column("s_v")
            keep = np.zeros(len(left), bool)
            for i in range(len(left)):
                a = np.frombuffer(left[i].as_buffer(), np.uint64)
                b = np.frombuffer(right[i].as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                common = int((b[at] == a).sum())
                keep[i] = 100 * common >= percent * (len(a) + len(b) - common)
            yield frame.select(["u", "v"]).filter(pa.array(keep))

    return joined.select("u", "v", "s_u", "s_v").mapInArrow(confirm, "u binary, v binary")


def _pairs(a, b) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _open_buckets(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Members ``(key, node, root)`` of buckets whose nodes lie in several components.

    In a bucket of two nodes these have been compared, so nothing is open there.
    """
    rooted = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = (
        rooted.groupBy("key")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"))
        .where((F.col("low") != F.col("high")) & (F.col("members") > 2))
    )
    return rooted.join(several.select("key", "members"), "key")


def _crossing_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(u, v)`` between components of open buckets: from every node outside a bucket's
    largest component, one link to each component in each block, if there is any.
    """
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    parts = F.ceil(F.col("members") / PART).cast("int")
    own = F.array(F.pmod(F.xxhash64("node"), parts).cast("int"))
    every = F.sequence(F.lit(0), parts - 1)
    here = members.select("key", "node", "root", F.lit(False).alias("asks"), F.explode(own).alias("part"))
    outside = members.join(largest, "key").where(F.col("root") != F.col("largest"))
    asking = outside.select("key", "node", "root", F.lit(True).alias("asks"), F.explode(every).alias("part"))
    dealt = here.unionByName(asking).join(sets, "node")
    blocks = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "asks", "node")

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, _Block()
        for frame in frames:
            keys = list(zip(frame.column("key").to_pylist(), frame.column("part").to_pylist(), strict=True))
            asks = frame.column("asks").to_pylist()
            nodes, roots = frame.column("node").to_pylist(), frame.column("root").to_pylist()
            packed = frame.column("shingles").to_pylist()
            found: list[tuple[bytes, bytes]] = []
            at = 0
            while at < len(keys):
                if keys[at] != key:
                    key, block = keys[at], _Block()
                end = at
                while end < len(keys) and keys[end] == key and asks[end] == asks[at]:
                    end += 1
                rows = slice(at, end)
                if asks[at]:
                    found += block.links(nodes[rows], roots[rows], packed[rows], percent)
                else:
                    block.add(nodes[rows], roots[rows], packed[rows])
                at = end
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], names=["u", "v"]
            )

    return blocks.select("key", "part", "asks", "node", "root", "shingles").mapInArrow(
        compare, "u binary, v binary"
    )


class _Block:
    """Sets of a block's nodes, by shingle, and the counting of common shingles with others."""

    def __init__(self) -> None:
        self.nodes: list[bytes] = []
        self.roots: list[bytes] = []
        self.packed: list[bytes] = []
        self.shingles: np.ndarray | None = None

    def add(self, nodes: list[bytes], roots: list[bytes], packed: list[bytes]) -> None:
        self.nodes += nodes
        self.roots += roots
        self.packed += packed

    def _index(self) -> None:
        sets = [np.frombuffer(p, np.uint64) for p in self.packed]
        self.sizes = np.array([len(x) for x in sets])
        holders = np.repeat(np.arange(len(sets)), self.sizes)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.holders = holders[order]
        self.shingles, self.starts = np.unique(every[order], return_index=True)
        self.counts = np.diff(np.append(self.starts, len(every)))

    def links(self, nodes, roots, packed, percent: int) -> list[tuple[bytes, bytes]]:
        if not self.nodes:
            return []
        if self.shingles is None:
            self._index()
        out, at = [], 0
        while at < len(nodes):
            sets, hits, end = [], 0, at
            while end < len(nodes) and (end == at or hits < HITS):
                shingles = np.frombuffer(packed[end], np.uint64)
                place = np.searchsorted(self.shingles, shingles)
                place[place == len(self.shingles)] = 0
                place = place[self.shingles[place] == shingles]
                hits += int(self.counts[place].sum())
                sets.append((len(shingles), place))
                end += 1
            out += self._linked(sets, nodes[at:end], roots[at:end], percent)
            at = end
        return out

    def _linked(self, sets, nodes, roots, percent: int) -> list[tuple[bytes, bytes]]:
        width = len(self.nodes)
        place = np.concatenate([p for _, p in sets])
        asker = np.repeat(np.arange(len(sets)), [len(p) for _, p in sets])
        counts = self.counts[place]
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        holder = self.holders[np.repeat(self.starts[place], counts) + within]
        pairs = np.repeat(asker, counts) * width + holder
        common = np.bincount(pairs, minlength=len(sets) * width).reshape(len(sets), width)
        total = np.array([n for n, _ in sets])[:, None] + self.sizes[None, :]
        linked = (100 * common >= percent * (total - common)) & (common > 0)
        out = []
        for i in np.flatnonzero(linked.any(axis=1)):
            seen = {roots[i]}
            for j in np.flatnonzero(linked[i]):
                if self.roots[j] not in seen:
                    seen.add(self.roots[j])
                    out.append((max(nodes[i], self.nodes[j]), min(nodes[i], self.nodes[j])))
        return out


def near_duplicates(
    df: DataFrame,
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = BAND_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of ``df``: id, ``tkey``, ``n_shingles``, ``component_id`` (the smallest id that
    links reach) and ``leads``, true for the one (id, text) that stands for its component.
    """
    docs = df.select(
        F.col(id_col).alias("doc"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text")
    )
    signed = stored(_signed(docs, width, bands, rows), "signed")
    row = F.struct("doc", "tkey")
    nodes = stored(
        signed.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.min(row).alias("first"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")),
        "nodes",
    )
    banded = nodes.select(F.explode("bands").alias("key"), "node")
    shared = banded.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("centre"))
    buckets = stored(
        banded.join(shared.where(F.col("members") > 1), "key").select("key", "node", "centre"), "buckets"
    )
    sizes = nodes.select("node", "n")
    wanted = buckets.select("node").distinct().join(nodes.select("node", "first"), "node")
    same = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("tkey") == F.col("first.tkey"))
    sets = stored(
        _sets(docs.join(wanted, same).select("node", "text"), width).groupBy("node").agg(F.first("shingles").alias("shingles")),
        "sets",
    )

    tried = stored(
        buckets.where(F.col("node") != F.col("centre")).select(*_pairs("node", "centre")).distinct(), "pairs"
    )
    links = stored(_linked(tried, sets, sizes, percent), "links")
    roots = components(links)
    members = _open_buckets(buckets.select("key", "node"), roots)
    centre = F.min_by(F.struct("node", "root"), F.xxhash64("key", "node")).alias("centre")
    centres = members.groupBy("key").agg(centre)
    new = members.join(centres, "key").where(F.col("root") != F.col("centre.root"))
    new = new.select(*_pairs("node", "centre.node")).distinct().join(tried, ["u", "v"], "left_anti")
    links = links.union(stored(_linked(new, sets, sizes, percent), "links"))
    roots = components(links)
    members = stored(_open_buckets(buckets.select("key", "node"), roots), "members")
    links = links.union(stored(_crossing_links(members, sets, percent).distinct(), "links"))
    roots = components(links)

    least = (
        roots.join(nodes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("lead"))
    )
    labels = roots.join(least, "root").select("node", "lead")
    own = nodes.select("node", "first").join(labels, "node", "left")
    own = own.select("node", F.coalesce("lead", "first").alias("lead"))
    lead = F.coalesce("lead", row)
    return (
        signed.select("doc", "tkey", "n_shingles", "node")
        .join(own, "node", "left")
        .select(
            F.col("doc").alias(id_col),
            "tkey",
            "n_shingles",
            lead["doc"].alias("component_id"),
            row.eqNullSafe(lead).alias("leads"),
        )
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``df`` for each component, that with the smallest id (then text key, then its other columns as JSON)."""
    found = near_duplicates(df, id_col=id_col, text_col=text_col, **options).where("leads")
    leads = rows_listed(df, found, "left_semi", id_col, text_col)
    others = [F.col("row")[c].alias(c) for c in df.columns if c not in (id_col, text_col)]
    one = F.min_by("row", F.to_json(F.struct(F.lit(0).alias("_"), *others))).alias("row")
    return leads.groupBy("id", "tkey").agg(one).select("row.*")
