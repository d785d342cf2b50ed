"""Ranked lexical search: the k best documents of every item, by a dual-tree search.

A document's *impact* for a term is ``(1000000000 * tf) div (1000 * tf + 8 * m)`` with ``m`` from its length, an
item's *weight* for it ``w`` times its count there; a score is their inner product over the item's terms.

1. One pass over the documents counts, per document, the terms that items hold. These sparse vectors are
   stored; the numbers of documents, of terms and of documents per term are sums over them.
2. Every task builds a hierarchy over batches of its documents, and all tasks have one over the items. A node holds
   for each term the largest impact (or weight) below it, so the inner product of two nodes is
   at least the score of any pair below them.
3. The search descends both hierarchies at once. A pair of nodes whose bound is below the weakest kth
   score of the items below is left out with all its pairs; that is exact, as equal bounds are followed.
   Pairs of leaves are scored by a matrix product. Weakest scores carry over from batch to batch.
4. The best k of each task are ranked per item; Spark trims ranks before the shuffle.

Scores are whole numbers below 2^53 (checked), so products of doubles give them exactly. Terms are compared by 64-bit
hashes. Distinct item texts are taken in blocks of ``BLOCK`` bytes, each a pass over the documents, so what goes
to the driver and to tasks is bounded whatever the number of items; a batch takes as many documents as
``MATRIX`` bytes hold.

Defined cases: a NULL or empty text has no terms and is no document of the statistics; an item without
terms, or whose terms no document holds, has no rows; rows that repeat are documents (or items) of
their own; equal scores go by id (NULL last), then by text; empty tables give no rows; other columns are left
alone.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from drydock.llm.common import stored, text_key
from drydock.llm.words import PUNCTUATION_TABLE, words_in

K = 10
#: Bytes of item texts in a block, and of a batch's matrix of impacts.
BLOCK = 1 << 20
MATRIX = 48 << 20
#: Bytes of text that are counted at once.
PART = 8 << 20
#: Items and documents in a leaf, and documents in a batch, at most.
ITEMS, DOCS, BATCH = 8, 16, 2048
EXACT = 2.0**53
#: A term splits a node only if this part of it, at least, lies on either side.
BALANCE = 64


class Sparse:
    """Rows of (term, value) pairs, the terms of a row ascending."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int) -> None:
        self.n, self.terms, self.values = n, terms, values
        self.starts = np.searchsorted(rows, np.arange(n + 1))

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs of some rows lie, and which of these rows each belongs to."""
        counts = self.starts[rows + 1] - self.starts[rows]
        owner = np.repeat(np.arange(len(rows)), counts)
        return np.arange(len(owner)) + np.repeat(self.starts[rows] - (np.cumsum(counts) - counts), counts), owner


def counted(texts: list[bytes], vocabulary: np.ndarray) -> tuple[np.ndarray, Sparse]:
    """Terms of each text with repeats, and how often each holds those of a sorted vocabulary."""
    hashes, offsets = words_in(texts, PUNCTUATION_TABLE)
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    term = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
    known = vocabulary[term] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
    pairs, n = np.unique(rows[known] * max(len(vocabulary), 1) + term[known], return_counts=True)
    rows, terms = np.divmod(pairs, max(len(vocabulary), 1))
    return np.diff(offsets), Sparse(rows, terms, n, len(texts))


class Node:
    """A part of the rows, in ``order[lo:hi]`` of its tree, and the two parts it is split into."""

    __slots__ = ("children", "hi", "lo", "peak", "terms", "weights")

    def __init__(self, lo: int, hi: int) -> None:
        self.lo, self.hi, self.children = lo, hi, ()


def tree(rows: Sparse, weights: np.ndarray, leaf: int) -> tuple[np.ndarray, list[Node]]:
    """Split rows again and again by the term that tells most of them apart; halves if none does.

    Returns the rows in the order of the leaves, and the nodes, the root first and parents before children.
    """
    order = np.arange(rows.n)
    nodes = [Node(0, rows.n)]
    for node in nodes:
        n = node.hi - node.lo
        if n <= leaf:
            continue
        own = order[node.lo : node.hi]
        at, owner = rows.places(own)
        terms = rows.terms[at]
        has = np.bincount(terms, minlength=len(weights))
        less = np.minimum(has, n - has)
        gain = np.where(less * BALANCE >= n, less * weights, 0)
        middle = n // 2
        if len(gain) and gain.max() > 0:
            with_term = np.zeros(n, bool)
            with_term[owner[terms == gain.argmax()]] = True
            order[node.lo : node.hi] = np.concatenate((own[with_term], own[~with_term]))
            middle = int(with_term.sum())
        node.children = (Node(node.lo, node.lo + middle), Node(node.lo + middle, node.hi))
        nodes += node.children
    return order, nodes


class Items:
    """The hierarchy over a block's items; nodes hold the largest weight of each of their terms."""

    def __init__(self, keys: list[str], rows: Sparse, weights: np.ndarray) -> None:
        coefficients = rows.values * weights[rows.terms]
        order, self.nodes = tree(rows, weights, ITEMS)
        self.keys = [keys[i] for i in order]
        self.root = self.nodes[0]
        for node in self.nodes:
            own = order[node.lo : node.hi]
            at, owner = rows.places(own)
            node.terms, local = np.unique(rows.terms[at], return_inverse=True)
            each = np.zeros((len(own), len(node.terms))) if not node.children else None
            if each is not None:
                each[owner, local] = coefficients[at]
                node.weights = each
            node.peak = np.zeros(len(node.terms))
            np.maximum.at(node.peak, local, coefficients[at])
        largest = np.bincount(np.repeat(np.arange(rows.n), np.diff(rows.starts)), coefficients, rows.n)
        if len(largest) and largest.max() * 1e6 >= EXACT:
            raise ValueError("an item is too long for exact scores")


class Best:
    """The best k documents of each item so far, and the score that a further one must reach."""

    def __init__(self, items: Items, k: int) -> None:
        self.items, self.k = items, k
        self.lists: list[list[tuple]] = [[] for _ in items.keys]
        self.least = np.ones(len(items.keys))

    def offer(self, item: int, score: float, document: tuple) -> None:
        best = self.lists[item]
        entry = (-score, *document)
        if len(best) == self.k:
            if entry >= best[-1]:
                return
            best.pop()
        insort(best, entry)
        if len(best) == self.k:
            self.least[item] = -best[-1][0]

    def search(self, impacts: np.ndarray, documents: list[tuple], nodes: list[Node]) -> None:
        """Go through a batch: ``impacts`` of its documents, in the order of the leaves of ``nodes``."""
        for node in reversed(nodes):
            if node.children:
                node.peak = np.maximum(node.children[0].peak, node.children[1].peak)
            else:
                node.peak = impacts[node.lo : node.hi].max(axis=0)
        stack = [(nodes[0], [self.items.root])]
        while stack:
            node, asked = stack.pop()
            asked = self._within_reach(node, asked)
            if not node.children:
                while any(item.children for item in asked):
                    asked = self._within_reach(node, [c for item in asked for c in item.children or (item,)])
                for item in asked:
                    self._score(impacts, documents, node, item)
            elif asked:
                below = [c for item in asked for c in item.children or (item,)]
                stack += sorted(
                    ((child, below) for child in node.children),
                    key=lambda pair: sum(float(item.peak @ pair[0].peak[item.terms]) for item in asked),
                )

    def _within_reach(self, node: Node, items: list[Node]) -> list[Node]:
        return [i for i in items if i.peak @ node.peak[i.terms] >= self.least[i.lo : i.hi].min()]

    def _score(self, impacts: np.ndarray, documents: list[tuple], node: Node, item: Node) -> None:
        scores = item.weights @ impacts[node.lo : node.hi, item.terms].T
        good = np.argwhere(scores >= self.least[item.lo : item.hi, None])
        for i, d in good.tolist():
            self.offer(item.lo + i, scores[i, d], documents[node.lo + d])


def _parts(bodies: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``PART`` bytes each."""
    sizes = np.cumsum(pc.binary_length(bodies).to_numpy().astype(np.int64))
    cuts = (np.flatnonzero(np.diff(sizes // PART)) + 1).tolist()
    return zip([0, *cuts], [*cuts, len(bodies)], strict=True)


def _vectors(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Per document: ``id``, ``tkey``, ``n`` (its terms), and the known terms with their counts."""
    rows = docs.select(
        F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tkey"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"),
    )
    made = rows.select(
        "id", "tkey", F.lit(0).cast("long").alias("n"), F.lit(None).cast("array<int>").alias("terms"),
        F.lit(None).cast("array<int>").alias("counts"),
    ).schema
    arrow = to_arrow_schema(made)

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            bodies = table.column("body")
            for lo, hi in _parts(bodies):
                n, found = counted(bodies[lo:hi].to_pylist(), vocabulary)
                starts = pa.array(found.starts, pa.int32())
                lists = [pa.ListArray.from_arrays(starts, pa.array(x, pa.int32())) for x in (found.terms, found.values)]
                yield pa.RecordBatch.from_arrays(
                    [table.column("id")[lo:hi].cast(arrow[0].type), table.column("tkey")[lo:hi], pa.array(n, pa.int64()), *lists],
                    names=arrow.names,
                )

    return rows.mapInArrow(count, made)


def _searched(vectors: DataFrame, items: Items, n_docs: int, n_terms: int, weights: np.ndarray, k: int) -> DataFrame:
    """The best k documents of each item in each task: ``key``, ``score``, ``id``, ``tkey``."""
    made = vectors.select(F.lit("").alias("key"), F.lit(0).cast("long").alias("score"), "id", "tkey").schema
    arrow = to_arrow_schema(made)
    size = int(min(BATCH, max(1, MATRIX // (8 * max(len(weights), 1)))))

    def search(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, k)
        for table in tables:
            for lo in range(0, table.num_rows, size):
                part = table.slice(lo, size)
                terms, counts = part.column("terms"), part.column("counts")
                owner = np.repeat(np.arange(part.num_rows), np.diff(terms.offsets.to_numpy()))
                tf = counts.flatten().to_numpy().astype(np.int64)
                m = np.array([25 + 75 * n * n_docs // n_terms for n in part.column("n").to_pylist()], np.int64)
                rows = Sparse(owner, terms.flatten().to_numpy(), 10**9 * tf // (1000 * tf + 8 * m[owner]), part.num_rows)
                order, nodes = tree(rows, weights, DOCS)
                impacts = np.zeros((part.num_rows, len(weights)))
                place = np.empty(part.num_rows, np.int64)
                place[order] = np.arange(part.num_rows)
                impacts[place[owner], rows.terms] = rows.values
                ids, keys = part.column("id").to_pylist(), part.column("tkey").to_pylist()
                best.search(impacts, [(ids[i] is None, ids[i], keys[i]) for i in order], nodes)
        rows = [(key, int(-x[0]), x[2], x[3]) for key, own in zip(items.keys, best.lists, strict=True) for x in own]
        columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return vectors.where(F.size("terms") > 0).mapInArrow(search, made)


def _of_block(docs: DataFrame, block: list, k: int, id_col: str, text_col: str) -> DataFrame:
    """The best documents of each task for a bounded list of item texts."""
    texts = [bytes(row.body) for row in block]
    vocabulary = np.unique(words_in(texts, PUNCTUATION_TABLE)[0])
    vectors = stored(_vectors(docs, vocabulary, id_col, text_col), "vectors")
    sums = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    held = np.zeros(len(vocabulary), np.int64)
    for term, n in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        held[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * sums.docs + 2) / (2 * n + 1))) for n in held.tolist()], float)
    items = Items([row.key for row in block], counted(texts, vocabulary)[1], weights)
    return _searched(vectors, items, sums.docs, sums.terms or 1, weights, k)


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK,
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's k best documents with a score above 0."""
    body = F.coalesce(F.col(item_text_col), F.lit("")).cast("binary")
    asked = items.select(F.col(item_col).alias("item"), F.sha2(body, 256).alias("key"), body.alias("body"))
    texts = asked.select("key", "body").distinct()
    blocks = (texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // block_bytes + 1
    number = F.pmod(F.xxhash64("key"), F.lit(blocks))
    found = [
        _of_block(docs, texts.where(number == block).orderBy("key").collect(), k, id_col, text_col)
        for block in range(blocks)
    ]
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("id"), "tkey")
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return asked.select("item", "key").join(best, "key").select(
        F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"
    )
