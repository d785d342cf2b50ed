"""Suffix-array dedup: bytes covered by a string that also starts in an earlier document.

A string of ``length`` bytes is repeated if it also starts in a document with a smaller id. To bring
equal strings together without moving every position, each text is reduced to *anchors*: the
places whose ``GRAM`` bytes have the least hash in some window of ``length`` bytes. Equal strings
have the same anchors at the same places, so a string can only be repeated
where an anchor's bytes are. Four steps, each a grouped job:

1. Texts are dealt into chunks. A chunk tells, for every distinct anchor with its
   surroundings (all the bytes that a string around the anchor can reach), its first document.
   Copies within a chunk so cost nothing further, however many there are.
2. Per range of anchor hashes: surroundings that an earlier document has too are repeated as a
   whole. An anchor that has several different surroundings needs a closer look, and
   the first document of each is asked for the bytes.
3. Those surroundings are sorted as suffixes, to the right of the anchor and (reversed) to its left, by
   mergesort. Two suffixes are compared by their common extension, which a binary
   search finds with the polynomial hashes of all prefixes: a logarithmic number of
   steps. The common extensions of neighbours are then verified byte by byte. With them,
   each string around the anchor is known by the class of its left and that of its right part.
4. Chunks mark the bytes that repeated strings cover.

Each step but the first sends back a few bits per anchor; texts are shuffled once. How many messages are sent
depends on bytes alone: one at most for each chunk and range of hashes, and never more than anchors.

Defined cases: a NULL text is empty; texts shorter than ``length`` bytes keep all bytes; rows with
one id are one document here, so they do not repeat each other; a NULL id is larger than all
others; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drydock.llm.common import text_key
from drydock.llm.words import mix

LENGTH = 50
GRAM = 16
#: Bytes of text in a chunk, and bytes of text whose anchors meet in one group, about.
CHUNK = 2 << 20
GROUP = 8 << 20
#: Bytes that are hashed at once, and surroundings that are sorted at once.
SLICE = 1 << 19
BLOCK = 1 << 14
LAST = np.iinfo(np.int64).max
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, np.uint64(base)), np.full(n, np.uint64(pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def prefix_hashes(values: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2^64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each run of ``width`` values, by doubling."""
    take = np.minimum if least else np.maximum
    reach, out = 1, values
    while 2 * reach <= width:
        out = take(out[:-reach], out[reach:])
        reach *= 2
    return take(out[: len(out) - (width - reach)], out[width - reach :]) if width > reach else out


class Chunk:
    """The documents of a chunk in the order of their ids, with their anchors.

    ``place``, ``owner``: each anchor's first byte and document. ``entry``: which distinct (anchor,
    surroundings) it is, counted in the order of the hashes. ``first``: the entry's first document.
    """

    def __init__(self, table: pa.Table, length: int) -> None:
        ids = table.column("doc").to_pylist()
        keys = table.column("tkey").to_pylist()
        texts = table.column("body").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (LAST if ids[i] is None else ids[i], keys[i]))
        self.raw_ids = [ids[i] for i in order]
        self.keys = [keys[i] for i in order]
        self.texts = [texts[i] for i in order]
        self.ids = np.array([LAST if i is None else i for i in self.raw_ids], np.int64)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.bytes = np.frombuffer(b"".join(self.texts), np.uint8)
        self.length, self.side = length, length - GRAM
        self._find()

    def _find(self) -> None:
        found = [self._anchors(at) for at in range(0, len(self.bytes), SLICE)]
        found = found or [self._nothing()]
        place, owner, self.lo, self.hi, hashes, around = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((owner, around, hashes))
        sorted_hashes, sorted_around = hashes[order], around[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (sorted_hashes[1:] != sorted_hashes[:-1]) | (sorted_around[1:] != sorted_around[:-1])
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(fresh) - 1
        self.place, self.owner, self.entry = place, owner, entry
        self.hashes, self.contexts = sorted_hashes[fresh], sorted_around[fresh]
        self.sample = order[fresh]
        self.first = owner[self.sample]

    @staticmethod
    def _nothing() -> tuple:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)

    def _anchors(self, begin: int) -> tuple:
        """Anchors that begin in one slice of the bytes, with their owners, surroundings and hashes.

        What is read reaches as far before and behind the slice as the windows around its anchors.
        """
        side, length = self.side, self.length
        low, high = max(0, begin - side), min(len(self.bytes), begin + SLICE + length)
        n = high - low
        if n < length:
            return self._nothing()
        values = self.bytes[low:high].astype(np.uint64) + np.uint64(1)
        up, down = _powers(BASES[0], SLICE + 2 * (side + length))
        total = prefix_hashes(values, up)
        grams = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
        # Windows that reach into the next document have no anchors.
        starts = np.arange(low, high - length + 1)
        owners = np.searchsorted(self.ends, starts, side="right")
        whole = starts + length <= self.ends[owners]
        least = np.where(whole, _sliding(grams, side + 1, least=True), np.uint64(0))
        padded = np.concatenate((np.zeros(side, np.uint64), least, np.zeros(side, np.uint64)))
        most = _sliding(padded, side + 1, least=False)
        place = np.flatnonzero((most == grams) & (grams > 0)) + low
        place = place[(place >= begin) & (place < begin + SLICE)]
        owner = np.searchsorted(self.ends, place, side="right")
        lo = np.maximum(self.starts[owner], place - side)
        hi = np.minimum(self.ends[owner], place + length)
        around = (total[hi - low] - total[lo - low]) * down[lo - low]
        up2, down2 = _powers(BASES[1], SLICE + 2 * (side + length))
        total2 = prefix_hashes(values, up2)
        around = mix(around) ^ mix((total2[hi - low] - total2[lo - low]) * down2[lo - low] + np.uint64(7))
        around = mix(around + ((place - lo) * 1024 + (hi - place)).astype(np.uint64))
        # Least hashes are small ones: mixed once more, they are spread over all groups alike.
        return place, owner, lo, hi, mix(grams[place - low] + np.uint64(1)), around

    def surroundings(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes around the first anchor of each entry, and how many are there on each side."""
        at = self.sample[entries]
        columns = self.place[at][:, None] + np.arange(-self.side, self.length)[None, :]
        held = (columns >= self.lo[at][:, None]) & (columns < self.hi[at][:, None])
        body = np.where(held, self.bytes[np.clip(columns, 0, len(self.bytes) - 1)], 0).astype(np.uint8)
        return body, self.place[at] - self.lo[at], self.hi[at] - self.place[at]

    def repeated(self, full: np.ndarray, masked: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Which bytes go, given the entries that are repeated as a whole or by a mask of strings."""
        n, length = len(self.bytes), self.length
        edges = np.zeros(n + 1, np.int64)
        if len(self.place):
            whole = np.zeros(len(self.first), bool)
            whole[full] = True
            whole = whole[self.entry] | (self.ids[self.owner] > self.ids[self.first[self.entry]])
            lo, hi = self.lo[whole], np.minimum(self.place[whole], self.hi[whole] - length)
            some = hi >= lo
            np.add.at(edges, lo[some], 1)
            np.add.at(edges, hi[some] + length, -1)
            bits = np.zeros(len(self.first), np.uint64)
            bits[masked] = masks
            rest = np.flatnonzero(~whole & (bits[self.entry] > 0))
            for back in range(self.side + 1):
                here = rest[(bits[self.entry[rest]] >> np.uint64(back)) & np.uint64(1) == 1]
                np.add.at(edges, self.place[here] - back, 1)
                np.add.at(edges, self.place[here] - back + length, -1)
        return np.cumsum(edges)[:n] > 0


def common_extension(
    totals: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray
) -> np.ndarray:
    """Length of the common prefix of rows a and b, at most ``most``, by binary search on hashes."""
    lo, hi = np.zeros(len(a), np.int64), most.copy()
    while (lo < hi).any():
        middle = (lo + hi + 1) >> 1
        same = totals[a, middle] == totals[b, middle]
        lo, hi = np.where(same, middle, lo), np.where(same, hi, middle - 1)
    return lo


def suffix_sort(group: np.ndarray, body: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group and then by their first ``sizes`` bytes, and each row's common
    extension with the row before it (0 at the start of a group). Rows come sorted by group.

    A mergesort, all merges of a level at once: each row looks up its rank in the sibling run by
    binary search, and two rows are compared through their common extension.
    """
    n = len(group)
    up, down = _powers(BASES[0], body.shape[1] + 1)
    totals = np.zeros((n, body.shape[1] + 1), np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[: body.shape[1]], axis=1, out=totals[:, 1:])
    filled = np.concatenate((body, np.zeros((n, 1), np.uint8)), axis=1).astype(np.int16) + 1

    def before(a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """Whether row a comes before row b; equal rows do if ``ties``."""
        out = group[a] < group[b]
        near = np.flatnonzero(group[a] == group[b])
        x, y = a[near], b[near]
        most = np.minimum(sizes[x], sizes[y])
        at = common_extension(totals, down, x, y, most)
        next_x = np.where(at < sizes[x], filled[x, at], 0)
        next_y = np.where(at < sizes[y], filled[y, at], 0)
        out[near] = (next_x < next_y) | ((next_x == next_y) & ties)
        return out

    order, run = np.arange(n), 1
    while run < n:
        here = np.arange(n)
        block = here // run
        left = block % 2 == 0
        sibling = np.where(left, block + 1, block - 1) * run
        lo, hi = np.minimum(sibling, n), np.minimum(sibling + run, n)
        base = lo.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            middle = (lo[open_] + hi[open_]) >> 1
            # Rows of the left run win ties, so the sort is stable.
            mine, other = order[here[open_]], order[middle]
            earlier = np.empty(len(open_), bool)
            is_left = left[open_]
            earlier[is_left] = before(other[is_left], mine[is_left], False)
            earlier[~is_left] = before(other[~is_left], mine[~is_left], True)
            lo[open_[earlier]] = middle[earlier] + 1
            hi[open_[~earlier]] = middle[~earlier]
        target = (block // 2) * 2 * run + (here - block * run) + (lo - base)
        merged = np.empty(n, np.int64)
        merged[target] = order
        order, run = merged, 2 * run
    a, b = order[:-1], order[1:]
    near = group[a] == group[b]
    most = np.where(near, np.minimum(sizes[a], sizes[b]), 0)
    common = common_extension(totals, down, a, b, most)
    columns = np.arange(body.shape[1])[None, :]
    differ = (body[a] != body[b]) & (columns < most[:, None])
    verified = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    if not np.array_equal(common, verified):
        return _sorted_by_bytes(group, body, sizes)
    return order, np.concatenate(([0], common))


def _sorted_by_bytes(group: np.ndarray, body: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by the bytes themselves, where hashes have collided."""
    rows = [bytes(r[:s]) for r, s in zip(body, sizes, strict=True)]
    order = np.array(sorted(range(len(rows)), key=lambda i: (group[i], rows[i])), np.int64)
    common = [0]
    for i, j in zip(order[:-1], order[1:], strict=True):
        x, y = rows[i], rows[j]
        same = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        common.append(same if group[i] == group[j] else 0)
    return order, np.array(common, np.int64)


def _class_of(order: np.ndarray, common: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    """Rows of one group with equal first ``size`` bytes have one class."""
    fresh = np.ones(len(order), bool)
    fresh[1:] = (common[1:] < size) | (group[order][1:] != group[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def repeated_strings(
    group: np.ndarray, body: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, length: int
) -> np.ndarray:
    """Per surroundings: bit o tells that the string starting o bytes before the anchor also
    stands in the same place around the same anchor of an earlier document.

    Rows come sorted by group (the anchor), and are taken in blocks of whole groups.
    """
    masks = np.empty(len(group), np.uint64)
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
    at = 0
    while at < len(group):
        end = int(ends[min(np.searchsorted(ends, at + BLOCK), len(ends) - 1)])
        rows = slice(at, end)
        masks[rows] = _block_masks(group[rows], body[rows], left[rows], right[rows], doc[rows], length)
        at = end
    return masks


def _block_masks(group, body, left, right, doc, length: int) -> np.ndarray:
    side = length - GRAM
    right_order, right_common = suffix_sort(group, body[:, side:], right)
    left_order, left_common = suffix_sort(group, body[:, side - 1 :: -1] if side else body[:, :0], left)
    masks = np.zeros(len(group), np.uint64)
    for back in range(side + 1):
        there = np.flatnonzero((left >= back) & (right >= length - back))
        by_left = _class_of(left_order, left_common, group, back)[there]
        by_right = _class_of(right_order, right_common, group, length - back)[there]
        order = np.lexsort((doc[there], by_right, by_left))
        x, y, d = by_left[order], by_right[order], doc[there][order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        least = d[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(order) else d
        masks[there[order[d > least]]] |= np.uint64(1) << np.uint64(back)
    return masks


def _planes(values: np.ndarray) -> bytes:
    """Sorted 64-bit values byte by byte, the highest first: these repeat, and compress."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(blob: bytes) -> np.ndarray:
    rows = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(rows.T).view(">u8").ravel().astype(np.uint64)


def _u64(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, np.uint64).tobytes()


def _i64(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, np.int64).tobytes()


_SENT = "chunk long, bucket long, kind int, entry long, a binary, b binary, c binary, d binary"
_SENT_ARROW = pa.schema([
    ("chunk", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("entry", pa.int64()),
    ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()),
])
ANCHORS, FULL, ASKED, BYTES, MASKED = range(5)


def _sent(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _SENT_ARROW]
    return pa.Table.from_arrays(
        [pa.array(c, t.type) for c, t in zip(columns, _SENT_ARROW, strict=True)], schema=_SENT_ARROW
    )


def _bucket_bounds(hashes: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each range of hashes begins among sorted hashes, and which ranges have any."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(number)) >> np.uint64(32)
    kinds, first = np.unique(bucket.astype(np.int64), return_index=True)
    return kinds, np.append(first, len(hashes))


def repeated_spans(
    df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, ``tkey``, ``n_bytes``, ``spans`` (the removed runs of bytes, ``start`` and ``end``)
    and ``kept``, the bytes that are left.
    """
    if not GRAM < length <= GRAM + 63:
        raise ValueError(f"length must be {GRAM + 1} to {GRAM + 63}")
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    total = df.agg(F.sum(F.octet_length(body))).first()[0] or 0
    chunks, buckets = total // CHUNK + 1, total // GROUP + 1
    docs = df.select(
        F.pmod(F.xxhash64(F.lit(3), F.col(id_col), text_key(F.col(text_col))), F.lit(chunks)).alias("chunk"),
        F.col(id_col).alias("doc"),
        text_key(F.col(text_col)).alias("tkey"),
        body.alias("body"),
    ).repartition("chunk")

    def tell(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, length)
        number = table.column("chunk")[0].as_py()
        kinds, bounds = _bucket_bounds(chunk.hashes, buckets)
        rows = []
        for bucket, lo, hi in zip(kinds.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            docs_, local = np.unique(chunk.first[lo:hi], return_inverse=True)
            width = np.uint16 if len(docs_) <= 1 << 16 else np.uint32
            rows.append((
                number, bucket, ANCHORS, lo, _planes(chunk.hashes[lo:hi]), _u64(chunk.contexts[lo:hi]),
                local.astype(width).tobytes(), _i64(chunk.ids[docs_]),
            ))
        return _sent(rows)

    def compare(table: pa.Table) -> pa.Table:
        sent = table.to_pylist()
        bucket = sent[0]["bucket"]
        hashes = np.concatenate([_from_planes(r["a"]) for r in sent])
        around = np.concatenate([np.frombuffer(r["b"], np.uint64) for r in sent])
        docs_ = np.concatenate([_documents(r) for r in sent])
        sizes = [len(r["a"]) // 8 for r in sent]
        order = np.lexsort((docs_, around, hashes))
        h, c, d = hashes[order], around[order], docs_[order]
        new_hash, new_context = np.ones(len(h), bool), np.ones(len(h), bool)
        new_hash[1:] = h[1:] != h[:-1]
        new_context[1:] = new_hash[1:] | (c[1:] != c[:-1])
        contexts = np.add.reduceat(new_context.astype(np.int64), np.flatnonzero(new_hash))
        several = np.repeat(contexts > 1, np.diff(np.append(np.flatnonzero(new_hash), len(h))))
        least = d[np.maximum.accumulate(np.where(new_context, np.arange(len(h)), 0))]
        full, asked = np.empty(len(h), bool), np.empty(len(h), bool)
        full[order] = d > least
        asked[order] = several & (d == least)
        rows = []
        for r, hi, size in zip(sent, np.cumsum(sizes).tolist(), sizes, strict=True):
            for kind, chosen in ((FULL, full[hi - size : hi]), (ASKED, asked[hi - size : hi])):
                if chosen.any():
                    entries = np.flatnonzero(chosen) + r["entry"]
                    rows.append((r["chunk"], bucket, kind, 0, _i64(entries), None, None, None))
        return _sent(rows)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = right.to_pylist()
        asked = [r for r in replies if r["kind"] == ASKED]
        rows = [tuple(r[name] for name in _SENT_ARROW.names) for r in replies if r["kind"] == FULL]
        chunk = Chunk(left, length) if asked else None
        for r in asked:
            entries = np.frombuffer(r["a"], np.int64)
            bodies, before, after = chunk.surroundings(entries)
            sides = np.stack((before, after, chunk.ids[chunk.first[entries]]))
            rows.append((
                r["chunk"], r["bucket"], BYTES, 0, _i64(entries), _u64(chunk.hashes[entries]),
                bodies.tobytes(), _i64(sides),
            ))
        return _sent(rows)

    def sort(table: pa.Table) -> pa.Table:
        sent = table.to_pylist()
        rows = [tuple(r[name] for name in _SENT_ARROW.names) for r in sent if r["kind"] == FULL]
        asked = [r for r in sent if r["kind"] == BYTES]
        if asked:
            width = 2 * length - GRAM
            hashes = np.concatenate([np.frombuffer(r["b"], np.uint64) for r in asked])
            bodies = np.concatenate([np.frombuffer(r["c"], np.uint8).reshape(-1, width) for r in asked])
            sides = np.concatenate([np.frombuffer(r["d"], np.int64).reshape(3, -1) for r in asked], axis=1)
            order = np.argsort(hashes, kind="stable")
            masks = np.empty(len(order), np.uint64)
            masks[order] = repeated_strings(
                hashes[order], bodies[order], sides[0][order], sides[1][order], sides[2][order], length
            )
            at = 0
            for r in asked:
                entries = np.frombuffer(r["a"], np.int64)
                own = masks[at : at + len(entries)]
                at += len(entries)
                if (own > 0).any():
                    rows.append((
                        r["chunk"], r["bucket"], MASKED, 0, _i64(entries[own > 0]), _u64(own[own > 0]), None, None,
                    ))
        return _sent(rows)

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = right.to_pylist()
        chunk = Chunk(left, length)
        none = np.zeros(0, np.int64)
        full = np.concatenate([np.frombuffer(r["a"], np.int64) for r in replies if r["kind"] == FULL] or [none])
        masked = [r for r in replies if r["kind"] == MASKED]
        entries = np.concatenate([np.frombuffer(r["a"], np.int64) for r in masked] or [none])
        masks = np.concatenate([np.frombuffer(r["b"], np.uint64) for r in masked] or [none.astype(np.uint64)])
        gone = chunk.repeated(full, entries, masks)
        spans, kept = [], []
        for text, lo, hi in zip(chunk.texts, chunk.starts.tolist(), chunk.ends.tolist(), strict=True):
            own = gone[lo:hi]
            if not own.any():
                spans.append([])
                kept.append(text)
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
            spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
            kept.append(chunk.bytes[lo:hi][~own].tobytes())
        return pa.Table.from_pydict(
            {"doc": chunk.raw_ids, "tkey": chunk.keys, "n_bytes": chunk.sizes, "spans": spans, "kept": kept},
            schema=out_arrow,
        )

    kind = docs.schema["doc"].dataType.simpleString()
    out_arrow = pa.schema([
        ("doc", {"bigint": pa.int64(), "int": pa.int32()}[kind]), ("tkey", pa.int64()), ("n_bytes", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()),
    ])
    anchors = docs.groupBy("chunk").applyInArrow(tell, _SENT)
    compared = anchors.groupBy("bucket").applyInArrow(compare, _SENT)
    answered = docs.groupBy("chunk").cogroup(compared.groupBy("chunk")).applyInArrow(answer, _SENT)
    sorted_ = answered.groupBy("bucket").applyInArrow(sort, _SENT)
    marked = docs.groupBy("chunk").cogroup(sorted_.groupBy("chunk")).applyInArrow(
        mark, f"doc {kind}, tkey long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )
    return marked.withColumnRenamed("doc", id_col)


def _documents(row: dict) -> np.ndarray:
    """First documents of a chunk's anchors, unpacked."""
    ids = np.frombuffer(row["d"], np.int64)
    local = np.frombuffer(row["c"], np.uint16 if len(ids) <= 1 << 16 else np.uint32)
    return ids[local]
