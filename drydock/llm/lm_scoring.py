"""LM scoring with a log-bilinear model, trained by noise-contrastive estimation in numpy.

The model predicts the class of a token, and where a class has several words with vectors, the word
in its class, from the ``CONTEXT`` tokens before it: the context's vectors, each through the matrix of
its place, add up to a prediction whose product with a class's (or word's) vector, plus its
bias, is the score. The ``SHORTLIST`` most frequent words are classes of their own. The words after
them have vectors too, as many as ``GROWTH`` times the root of the training tokens, if they were seen
``MIN_COUNT`` times: in the order of their counts they are dealt into classes of about the root of
their number. In a context a word's vector is its class's plus its own. Only the rarest words share
classes by like frequency, in which a word has the share of its smoothed count, and words not
seen in training share the last. A token so costs two normalisers of about the root of the
vocabulary, each found by batched matrix products, so the log-probabilities are normalised ones,
over all words seen and one unseen.

Training documents are all documents that are not held out. Every group of partitions trains on all of its
training tokens, in batches of short runs of text, from the same start, with noise drawn from the class frequencies, and evenly from
the word's class. Parameters are then averaged on the cluster, those of a class by tokens and those of
a word by its own tokens. That is repeated ``ROUNDS`` times.

Counts cover the whole corpus. Documents become chunks (one row each) of word codes with the
chunk's own dictionary, so a word meets its count once per chunk and not once per token, however
frequent it is, and texts are read only once. Dictionaries travel as sorted, packed arrays, a
range of word hashes to a group, and only counts come back. What reaches the driver is the
frequencies of counts, the ``SHORTLIST`` words, the counts of words with vectors and the model.

Defined cases: a NULL or empty text is one token, the end; a NULL id counts as the empty
string where documents are held out; repeated rows are documents of their own; without any
training token all words are unseen; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drydock.llm.common import stored
from drydock.llm.words import batches, words_of

SHORTLIST = 400
#: Words with vectors for each root of a training token, and the count below which none has one.
GROWTH = 8
MIN_COUNT = 5
CONTEXT = 2
SIZE = 24
NOISE = 25
WORD_NOISE = 4
BATCH = 4096
#: Tokens that follow each other in a batch, and steps whose noise is drawn at once.
RUN = 32
DRAWN = 64
RATE = 0.05
ROUNDS = 2
#: Rows of parameters that are averaged together, and contexts whose scores are held at once: few enough for a cache.
ROWS = 512
SCORED = 256
#: Up to here the product of two exponentials and their sum are far from what single precision holds.
LARGE = 36.0
#: Context units whose exponentials are kept, the most frequent.
COMMON = 4096
#: How often a unit is common at least, and words of a class that share exponentials.
OFTEN = 4
SHARED = 2048
#: Tokens from which on chunks are scored together, so that they share contexts and exponentials.
POOL = 2 << 20
#: Characters whose words share a dictionary.
CHUNK = 2 << 20
#: Words of chunks' dictionaries that meet in one group, about.
GROUP = 1 << 20
#: How what is stored and shuffled is compressed.
PACKING = pa.Codec("zstd", compression_level=1)
#: The hash that stands for the end of a text.
END = np.uint64(0xE0D0E0D0E0D0E0D1)


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32(id as text) mod folds names the fold that is not learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _encoded(docs: DataFrame) -> DataFrame:
    """One row per chunk: its documents as codes, the words that codes stand for, their counts."""

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for frame in frames:
            texts, ids = frame.column("text").to_pylist(), frame.column("doc").to_pylist()
            held = frame.column("held").to_numpy(zero_copy_only=False).astype(bool)
            for a, b in batches(texts, CHUNK):
                hashes, offsets = words_of(texts[a:b])
                hashes = np.insert(hashes, offsets[1:], END)
                lengths = np.diff(offsets) + 1
                words, codes = np.unique(hashes, return_inverse=True)  # ascending, as they are dealt
                learnt = np.repeat(~held[a:b], lengths)
                counts = np.bincount(codes[learnt], minlength=len(words))
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": [chunk],
                        "ids": [ids[a:b]],
                        "held": [held[a:b].tolist()],
                        "lengths": [lengths],
                        "codes": [_packed(codes.astype(_code_kind(len(words))))],
                        "words": [words.view(np.int64)],
                        "counts": [counts.astype(np.int64)],
                    },
                    schema=arrow,
                )
                chunk += 1

    kind = docs.schema["doc"].dataType.simpleString()
    arrow = pa.schema([
        ("chunk", pa.int64()), ("ids", pa.list_(_arrow_type(kind))), ("held", pa.list_(pa.bool_())),
        ("lengths", pa.list_(pa.int64())), ("codes", pa.binary()), ("words", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())),
    ])
    return docs.mapInArrow(
        encode,
        f"chunk long, ids array<{kind}>, held array<boolean>, lengths array<long>, codes binary, "
        "words array<long>, counts array<long>",
    )


def _arrow_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte and compressed: their high bytes have much in common."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return len(values).to_bytes(8, "little") + PACKING.compress(planes, asbytes=True)


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    planes = PACKING.decompress(blob[8:], decompressed_size=n * size, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).ravel().view(kind)


def _code_kind(codes: int) -> type:
    return np.uint16 if codes <= 1 << 16 else np.uint32


def _counted(encoded: DataFrame, shortlist: int) -> DataFrame:
    """The counts of all chunks' words in all training tokens.

    Rows with a ``chunk`` answer it: from its word number ``start`` on, ``totals`` and ``ranks`` (the
    word's place among the words of its group by count, or -1 where it can have no vector). The other rows, one for each
    group of words, have the ``top`` words of the group and how many words have each count.
    """
    size, tasks = encoded.agg(F.sum(F.size("words"))).first()[0], _tasks(encoded)
    groups = max(2 * tasks, (size or 0) // GROUP)

    def deal(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for chunk, words, counts in zip(*[frame.column(c) for c in ("chunk", "words", "counts")], strict=True):
                chunk = chunk.as_py()
                words = np.sort(words.values.to_numpy().view(np.uint64))
                counts = counts.values.to_numpy().astype(np.uint64)
                group = (((words >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)
                kinds, first = np.unique(group, return_index=True)
                last = np.append(first[1:], len(words))
                yield pa.RecordBatch.from_pydict({
                    "group": kinds,
                    "chunk": np.full(len(kinds), chunk),
                    "start": first,
                    "words": [_packed(words[a:b]) for a, b in zip(first, last, strict=True)],
                    "counts": [_packed(counts[a:b]) for a, b in zip(first, last, strict=True)],
                })

    def total(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        each = [_unpacked(r["words"], np.uint64) for r in rows]
        words = np.concatenate(each)
        counts = np.concatenate([_unpacked(r["counts"], np.uint64) for r in rows])
        distinct, where = np.unique(words, return_inverse=True)
        sums = np.zeros(len(distinct), np.uint64)
        np.add.at(sums, where, counts)
        best = np.lexsort((distinct, -sums.astype(np.int64)))[:shortlist]
        best = best[sums[best] > 0]
        rank = np.full(len(distinct), -1, np.int32)
        ranked = np.lexsort((distinct, -sums.astype(np.int64)))
        ranked = ranked[: max(len(best), int((sums >= MIN_COUNT).sum()))]
        rank[ranked] = np.arange(len(ranked))
        number, times = np.unique(sums[sums > 0], return_counts=True)
        out, at = [], 0
        for r, held in zip(rows, each, strict=True):
            own = where[at : at + len(held)]
            at += len(own)
            out.append((r["group"], r["chunk"], r["start"], _packed(sums[own]), _packed(rank[own]), [], [], [], []))
        out.append((
            rows[0]["group"], None, None, None, None, distinct[best].view(np.int64).tolist(),
            sums[best].astype(np.int64).tolist(), number.astype(np.int64).tolist(), times.tolist(),
        ))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    long = pa.list_(pa.int64())
    arrow = pa.schema([
        ("group", pa.int64()), ("chunk", pa.int64()), ("start", pa.int64()), ("totals", pa.binary()),
        ("ranks", pa.binary()), ("top", long), ("top_counts", long), ("numbers", long), ("times", long),
    ])
    dealt = encoded.select("chunk", "words", "counts").mapInArrow(
        deal, "group long, chunk long, start long, words binary, counts binary"
    )
    return dealt.groupBy("group").applyInArrow(
        total,
        "group long, chunk long, start long, totals binary, ranks binary, top array<long>, "
        "top_counts array<long>, numbers array<long>, times array<long>",
    )


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@dataclass
class Classes:
    """How words fall into classes, and the smoothed mass of each class.

    ``units`` tells what a word is, given its place in its group (``starts`` has each group's first):
    a class of its own, ``number + 1 + i`` for the i-th word with a vector in a larger class, or -1. The
    latter are ``words``, by their counts, most frequent first; ``width`` of them are a class, from
    class ``first`` on.
    """

    starts: np.ndarray
    units: np.ndarray
    masses: np.ndarray
    tokens: int
    types: int
    levels: int
    first: int
    width: int
    words: np.ndarray

    @property
    def number(self) -> int:
        return len(self.masses)

    @staticmethod
    def level(count: np.ndarray) -> np.ndarray:
        """Words of like frequency share a level: two to each doubling, none for unseen words."""
        return np.floor(2 * np.log2(np.maximum(count, 1))).astype(np.int64)

    def of(self, group: int, ranks: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Units of a group's words, given their ranks (-1: none) and counts."""
        at = self.starts[group] + ranks
        inside = (ranks >= 0) & (at < self.starts[group + 1])
        own = np.full(len(ranks), -1, np.int64)
        own[inside] = self.units[at[inside]]
        shared = self.levels + self.level(counts)
        return np.where(counts == 0, self.number - 1, np.where(own >= 0, own, shared))

    def split(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each unit, and its number among the words (their number, if it is none)."""
        word = units - (self.number + 1)
        return np.where(word >= 0, self.first + word // self.width, units), np.where(word >= 0, word, len(self.words))


def _classes(counted: DataFrame, shortlist: int) -> Classes:
    kinds = counted.where(F.col("chunk").isNull())
    each = kinds.select(F.explode(F.arrays_zip("numbers", "times")).alias("x")).groupBy("x.numbers").agg(F.sum("x.times"))
    frequencies = np.array(sorted((tuple(r) for r in each.collect()), reverse=True), np.int64).reshape(-1, 2)
    # Distinct counts: their number grows as the root of the tokens.
    tokens, types = int((frequencies[:, 0] * frequencies[:, 1]).sum()), int(frequencies[:, 1].sum())
    top = (
        kinds.select("group", F.posexplode(F.arrays_zip("top", "top_counts")).alias("rank", "x"))
        .orderBy(F.desc("x.top_counts"), "x.top")
        .limit(shortlist)
        .select("group", "rank", "x.top_counts")
        .collect()
    )
    rows = np.array([tuple(r) for r in top], np.int64).reshape(-1, 3)
    most = max(shortlist, int(GROWTH * tokens**0.5))
    enough = (np.cumsum(frequencies[:, 1]) <= most) & (frequencies[:, 0] >= MIN_COUNT)
    least = int(frequencies[enough, 0].min(initial=np.iinfo(np.int64).max))
    often = F.filter(F.arrays_zip("numbers", "times"), lambda x: x["numbers"] >= least)
    groups = {r[0]: r[1] for r in kinds.select("group", often).collect()}
    # Counts of the words that may have vectors, by group and rank there: descending.
    counts_of = {
        g: np.repeat(*(np.array([x[i] for x in found], np.int64) for i in (0, 1)))[::-1] for g, found in groups.items()
    }
    size = np.zeros(max(groups, default=-1) + 1, np.int64)
    for g, counts in counts_of.items():
        size[g] = len(counts)
    with_vectors = size.copy()
    np.maximum.at(size, rows[:, 0], rows[:, 1] + 1)
    starts = np.concatenate(([0], np.cumsum(size)))
    counts = np.zeros(starts[-1], np.int64)
    for g, own in counts_of.items():
        counts[starts[g] : starts[g] + with_vectors[g]] = own
    listed = starts[rows[:, 0]] + rows[:, 1]
    counts[listed] = 0
    words = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
    width = max(32, int(np.ceil(len(words) ** 0.5)))
    levels = Classes.level(frequencies[:, 0])
    first = len(rows) + int(levels.max(initial=-1)) + 1
    masses = np.zeros(first + -(-len(words) // width) + 1)
    units = np.full(len(counts), -1, np.int64)
    units[listed] = np.arange(len(rows))
    units[words] = len(masses) + 1 + np.arange(len(words))
    masses[: len(rows)] = rows[:, 2] + 0.5
    np.add.at(masses, len(rows) + levels, (frequencies[:, 0] + 0.5) * frequencies[:, 1])
    np.subtract.at(masses, len(rows) + Classes.level(rows[:, 2]), rows[:, 2] + 0.5)
    np.subtract.at(masses, len(rows) + Classes.level(counts[words]), counts[words] + 0.5)
    np.add.at(masses, first + np.arange(len(words)) // width, counts[words] + 0.5)
    masses[-1] = 0.5
    return Classes(
        starts, units, np.round(2 * masses) / 2, tokens, types, len(rows), first, width, counts[words]
    )


def _classified(encoded: DataFrame, counted: DataFrame, classes: Classes) -> DataFrame:
    """One row per chunk: each document's figures that need counts only, its tokens' codes, the units that codes stand for."""
    total = classes.tokens + 0.5 * (classes.types + 1)

    def classify(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        answers = sorted(right.to_pylist(), key=lambda r: r["start"])
        counts = np.concatenate([_unpacked(r["totals"], np.int64) for r in answers])
        units, at = [], 0
        for r in answers:
            ranks = _unpacked(r["ranks"], np.int32).astype(np.int64)
            units.append(classes.of(r["group"], ranks, counts[at : at + len(ranks)]))
            at += len(ranks)
        units = np.concatenate(units)
        lengths = np.array(row["lengths"], np.int64)
        codes = _unpacked(row["codes"], _code_kind(len(counts)))
        starts = np.cumsum(lengths) - lengths
        kinds, _ = classes.split(units)
        smooth = np.log10(counts + 0.5)
        # Words of one unit are told apart no more, and frequent units have the small codes.
        own, same = np.unique(units, return_inverse=True)
        inside = np.where(units < classes.number, smooth - np.log10(classes.masses[kinds]), 0.0)
        return pa.Table.from_pydict(
            {
                "ids": [row["ids"]],
                "held": [row["held"]],
                "lengths": [lengths],
                "known": [np.add.reduceat((counts > 0).astype(np.int64)[codes], starts)],
                "base": [np.add.reduceat(smooth[codes], starts) - lengths * np.log10(total)],
                "inside": [np.add.reduceat(inside[codes], starts)],
                "units": [_packed(own.astype(np.uint32))],
                "codes": [_packed(same.astype(_code_kind(len(own))).take(codes))],
            },
            schema=arrow,
        )

    kind = encoded.schema["ids"].dataType.elementType.simpleString()
    arrow = pa.schema([
        ("ids", pa.list_(_arrow_type(kind))), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())),
        ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("inside", pa.list_(pa.float64())),
        ("units", pa.binary()), ("codes", pa.binary()),
    ])
    left = encoded.select("chunk", "ids", "held", "lengths", "codes")
    right = counted.where(F.col("chunk").isNotNull()).select("chunk", "start", "group", "totals", "ranks")
    return left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(
        classify,
        f"ids array<{kind}>, held array<boolean>, lengths array<long>, known array<long>, "
        "base array<double>, inside array<double>, units binary, codes binary",
    )


def _units_and_codes(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's units, and which of them each token has."""
    units = _unpacked(row["units"], np.uint32).astype(np.int64)
    return units, _unpacked(row["codes"], _code_kind(len(units))).astype(np.int64)


class LogBilinear:
    """Vectors of context and target classes, a matrix for each place of the context, biases.

    ``counts``: of the words with vectors of their own, dealt into classes of ``width``. A context's word
    ``len(counts)`` is none, and adds nothing to its class's vector.
    """

    def __init__(
        self, classes: int, frequencies: np.ndarray, counts: np.ndarray | None = None, width: int = 1
    ) -> None:
        rng = np.random.default_rng(6)
        self.noise = np.maximum(frequencies, 1e-12)
        self.noise = self.noise / self.noise.sum()
        self.inputs = rng.normal(0, 0.1, (classes + 1, SIZE))
        self.places = np.stack([np.eye(SIZE)] * CONTEXT) / CONTEXT
        self.outputs = rng.normal(0, 0.1, (classes, SIZE))
        self.biases = np.log(self.noise)
        counts = np.zeros(0) if counts is None else counts + 0.5
        self.words, self.width = len(counts), width
        self.own = np.concatenate((rng.normal(0, 0.1, (self.words, SIZE)), np.zeros((1, SIZE))))
        self.word_outputs = rng.normal(0, 0.1, (self.words, SIZE))
        masses = np.add.reduceat(counts, np.arange(0, self.words, width)) if self.words else counts
        self.word_biases = np.log(counts / np.repeat(masses, width)[: self.words])

    def parameters(self) -> list[np.ndarray]:
        shared = [self.inputs, self.places, self.outputs, self.biases]
        return [*shared, self.own, self.word_outputs, self.word_biases] if self.words else shared

    def as_kind(self, kind: type) -> LogBilinear:
        out = copy(self)
        for name in ("noise", "inputs", "places", "outputs", "biases", "own", "word_outputs", "word_biases"):
            setattr(out, name, getattr(self, name).astype(kind))
        return out

    def rows(self) -> np.ndarray:
        """All parameters as rows of one width: first those of classes, then one row for each word."""
        shared = np.concatenate([p.ravel() for p in self.parameters()[:4]])
        shared = np.pad(shared, (0, -len(shared) % (2 * SIZE + 1))).reshape(-1, 2 * SIZE + 1)
        words = np.concatenate((self.own[: self.words], self.word_outputs, self.word_biases[:, None]), axis=1)
        return np.concatenate((shared, words))

    def load(self, rows: np.ndarray) -> None:
        shared, at = rows[: len(rows) - self.words].ravel(), 0
        for p in self.parameters()[:4]:
            p[...] = shared[at : at + p.size].reshape(p.shape)
            at += p.size
        words = rows[len(rows) - self.words :]
        self.own[: self.words] = words[:, :SIZE]
        self.word_outputs[...] = words[:, SIZE : 2 * SIZE]
        self.word_biases[...] = words[:, -1]

    def vectors(self, contexts: np.ndarray, words: np.ndarray | None) -> np.ndarray:
        """The vectors of each context's places side by side."""
        out = self.inputs.take(contexts, axis=0)
        if words is not None:
            out += self.own.take(words, axis=0)
        return out.reshape(len(contexts), -1)

    def predicted(self, contexts: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
        return self.vectors(contexts, words) @ self.places.reshape(-1, SIZE)

    def normalisers(self) -> np.ndarray:
        """The log-normaliser of every pair of context classes, a row of contexts at a time."""
        placed = [self.inputs @ self.places[i] for i in range(CONTEXT)]
        out = np.empty((len(self.inputs), len(self.inputs)))
        for first in range(len(self.inputs)):
            out[first] = _log_sums((placed[0][first] + placed[1]) @ self.outputs.T, self.biases)
        return out

    def log_classes(self, predicted: np.ndarray) -> np.ndarray:
        """The log-normaliser of the classes for each prediction."""
        return _log_normalisers(predicted, self.outputs, self.biases)

    def log_classes_of_pairs(self, placed: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
        """``log_classes`` of pairs of context units, given each unit's part of a prediction at each place."""
        safe = all(_within(p, self.outputs, self.biases) for p in placed)
        return _log_normalisers_of_pairs(placed, pairs, self.outputs, self.biases, safe)

    def log_words(self, predicted: np.ndarray, where: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The log-probability of words in their classes; ``where`` has each one's prediction."""
        safe = _within(predicted, self.word_outputs, self.word_biases)
        return self._log_words(lambda part: predicted.take(where[part], axis=0), safe, words)

    def _log_words(
        self,
        predicted: Callable[[np.ndarray], np.ndarray],
        safe: bool,
        words: np.ndarray,
        placed: list[np.ndarray] | None = None,
        pairs: Callable[[np.ndarray], np.ndarray] | None = None,
    ) -> np.ndarray:
        """``log_words`` with ``predicted`` finding the predictions of some of the words, and whether all are ``_within``.

        With ``placed`` and the ``pairs`` of some of the words, those of large classes share exponentials too.
        """
        out = np.empty(len(words))
        cluster = (words // self.width).astype(np.uint16 if self.words <= self.width << 16 else np.uint32)
        order = np.argsort(cluster, kind="stable")
        edges = np.flatnonzero(np.diff(cluster[order])) + 1
        for chosen in np.split(order, edges) if len(order) else ():
            lo = int(cluster[chosen[0]]) * self.width
            outputs, biases = self.word_outputs[lo : lo + self.width], self.word_biases[lo : lo + self.width]
            weights, shared = np.exp(biases) if safe else None, pairs is not None and len(chosen) >= SHARED
            if shared:
                out[chosen] = -_log_normalisers_of_pairs(placed, pairs(chosen), outputs, biases, safe)
            for at in range(0, len(chosen), SCORED):
                part = chosen[at : at + SCORED]
                given, own = predicted(part), words.take(part) - lo
                if shared:
                    out[part] += np.einsum("ij,ij->i", given, outputs.take(own, axis=0)) + biases.take(own)
                    continue
                scores = given @ outputs.T
                found = scores.ravel().take(own + np.arange(0, scores.size, len(biases))) + biases.take(own)
                out[part] = found - _log_sums(scores, biases, weights)
        return out


def _log_normalisers(predicted: np.ndarray, outputs: np.ndarray, biases: np.ndarray) -> np.ndarray:
    """The log of the sum of the scores' exponentials for each prediction."""
    out = np.empty(len(predicted))
    weights = np.exp(biases) if _within(predicted, outputs, biases) else None
    for at in range(0, len(predicted), SCORED):
        out[at : at + SCORED] = _log_sums(predicted[at : at + SCORED] @ outputs.T, biases, weights)
    return out


def _log_normalisers_of_pairs(
    placed: list[np.ndarray], pairs: np.ndarray, outputs: np.ndarray, biases: np.ndarray, safe: bool
) -> np.ndarray:
    """``_log_normalisers`` of pairs of context units, given each unit's part of a prediction at each place.

    The exponential of a sum is the product of the parts' exponentials. Those of ``COMMON`` units are found once
    and those of any other once for each run of pairs that share it; what is left for a pair is an inner product. Pairs without
    a common unit, and those whose product is too small for single precision, are normalised as they are.
    ``safe``: exponentials are in range as they are.
    """
    out = np.full(len(pairs), np.nan)
    for near in range(CONTEXT):
        far = 1 - near
        times = np.bincount(pairs[:, near], minlength=len(placed[0]))
        often = np.flatnonzero(times >= OFTEN)
        if len(often) > COMMON:
            often = often[np.argsort(-times.take(often), kind="stable")[:COMMON]]
        slot = np.full(len(placed[0]), -1)
        slot[often] = np.arange(len(often))
        table, tops = _exponentials(placed[near].take(often, axis=0), outputs, None if near else biases, safe)
        open_ = np.flatnonzero((slot.take(pairs[:, near]) >= 0) & np.isnan(out))
        open_ = open_[np.argsort(pairs[open_, far], kind="stable")]
        for at in range(0, len(open_), 2 * SCORED):
            part = open_[at : at + 2 * SCORED]
            others = pairs[part, far]
            new = np.concatenate(([True], others[1:] != others[:-1]))
            which = np.cumsum(new) - 1
            own, own_tops = _exponentials(placed[far].take(others[new], axis=0), outputs, None if far else biases, safe)
            common = slot.take(pairs[part, near])
            sums = np.vecdot(table.take(common, axis=0), own.take(which, axis=0))
            enough = sums > 1e-20
            logs = np.log(sums[enough]) + tops[common[enough]] + own_tops[which[enough]]
            out[part[enough]] = logs
    rest = np.flatnonzero(np.isnan(out))
    for at in range(0, len(rest), BATCH):
        part = rest[at : at + BATCH]
        predicted = sum(placed[i].take(pairs[part, i], axis=0) for i in range(CONTEXT))
        out[part] = _log_normalisers(predicted, outputs, biases)
    return out


def _exponentials(
    placed: np.ndarray, outputs: np.ndarray, biases: np.ndarray | None, safe: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Of each class's score by one part of a prediction, and what was taken off; biases go with the first part."""
    out, tops = np.empty((len(placed), len(outputs)), placed.dtype), np.zeros(len(placed), placed.dtype)
    for at in range(0, len(placed), SCORED):
        scores = out[at : at + SCORED]
        np.matmul(placed[at : at + SCORED], outputs.T, out=scores)
        if biases is not None:
            scores += biases
        if not safe:
            tops[at : at + SCORED] = scores.max(axis=1)
            scores -= tops[at : at + SCORED, None]
        np.exp(scores, out=scores)
    return out, tops


def _within(vectors: np.ndarray | list[np.ndarray], outputs: np.ndarray, biases: np.ndarray) -> bool:
    """Whether sums of the scores' exponentials are in range without taking the largest score off first.

    A list has the parts whose sums are the vectors.
    """
    parts = vectors if isinstance(vectors, list) else [vectors]
    longest = [np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0)) for x in (*parts, outputs)]
    # Of biases only the largest matters: a sum is between that score's exponential and all classes' as large.
    return bool(sum(longest[:-1]) * longest[-1] + abs(biases.max(initial=-np.inf)) < LARGE)


def _log_sums(scores: np.ndarray, biases: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Logs of the rows' sums of exponentials with the biases; the scores are overwritten.

    ``weights``: the exponentials of the biases, if no sum is large.
    """
    if weights is not None:
        return np.log(np.exp(scores, out=scores) @ weights)
    scores += biases
    top = scores.max(axis=1, keepdims=True)
    scores -= top
    np.exp(scores, out=scores)
    return top[:, 0] + np.log(scores @ np.ones(scores.shape[1], scores.dtype))


class Trainer:
    """Noise-contrastive steps with rates that shrink as a parameter's gradients add up."""

    def __init__(self, model: LogBilinear, seed: int) -> None:
        self.model, self.rng = model, np.random.default_rng(seed)
        self.seen = [np.full_like(p, 1e-6) for p in model.parameters()]
        rows = max(len(p) for p in model.parameters())
        self._place = np.zeros(rows, np.int64)
        self._drawn = np.zeros((0, NOISE), np.int64)

    def _move(self, which: int, rows, gradient: np.ndarray) -> None:
        seen, parameter = self.seen[which], self.model.parameters()[which]
        if isinstance(rows, slice):
            seen[rows] += gradient * gradient
            parameter[rows] -= RATE * gradient / np.sqrt(seen[rows])
            return
        step = seen.take(rows, axis=0)
        step += gradient * gradient
        _put(seen, rows, step)
        np.sqrt(step, out=step)
        np.divide(gradient, step, out=step)
        step *= RATE
        moved = parameter.take(rows, axis=0)
        moved -= step
        _put(parameter, rows, moved)

    def step(
        self,
        contexts: np.ndarray,
        targets: np.ndarray,
        context_words: np.ndarray | None = None,
        target_words: np.ndarray | None = None,
    ) -> None:
        """A step on tokens that each have a context of their own."""
        words = None if context_words is None else context_words.ravel()
        self.step_in(contexts.ravel(), words, np.arange(contexts.size).reshape(contexts.shape), targets, target_words)

    def step_in(
        self,
        kinds: np.ndarray,
        words: np.ndarray | None,
        before: np.ndarray,
        targets: np.ndarray,
        target_words: np.ndarray | None,
    ) -> None:
        """A step on tokens of a text whose positions have ``kinds`` and ``words``.

        ``before`` has the positions of each token's context, the nearest first. At each place a position is in one context
        at most, so what a position adds to a prediction is found once for all tokens after it.
        """
        m, n = self.model, len(targets)
        noise = self._noise()
        given, through = m.vectors(kinds, words), m.places.transpose(1, 0, 2).reshape(SIZE, -1)
        # Each position's part of a prediction at each place, one after the other.
        parts, slots = (given @ through).reshape(-1, SIZE), before * CONTEXT + np.arange(CONTEXT)
        predicted = parts.take(slots[:, 0], axis=0)
        for i in range(1, CONTEXT):
            predicted += parts.take(slots[:, i], axis=0)
        expected = np.log(NOISE * m.noise)
        vectors = m.outputs.take(targets, axis=0)
        drawn = m.outputs.take(noise, axis=0)
        target = np.einsum("ij,ij->i", predicted, vectors) + (m.biases - expected).take(targets)
        other = predicted @ -drawn.T
        other -= m.biases[noise] - expected[noise]
        # Derivatives of the loss by the scores: 1 - p for what was seen, p for the noise.
        scale = predicted.dtype.type(1.0 / n)
        by_target = _logistic(target, -scale)
        by_noise = _logistic(other, scale)
        by_prediction = by_noise @ drawn
        vectors *= by_target[:, None]
        by_prediction += vectors
        by_row = np.empty((n + NOISE, SIZE), predicted.dtype)
        np.multiply(by_target[:, None], predicted, out=by_row[:n])
        np.matmul(by_noise.T, predicted, out=by_row[n:])
        by_bias = np.concatenate((by_target, np.ones(n, by_noise.dtype) @ by_noise))
        found, sums, biases = self._sum_by(np.concatenate((targets, noise)), by_row, by_bias)
        moves = [(2, found, sums), (3, found, biases)]
        if target_words is not None:
            moves += self._words(predicted, by_prediction, target_words, scale)
        by_part = np.zeros_like(parts)
        for i in range(CONTEXT):
            _put(by_part, slots[:, i], by_prediction)
        by_part = by_part.reshape(len(given), -1)
        gradients = by_part @ through.T
        places = (given.T @ by_part).reshape(SIZE, CONTEXT, SIZE).transpose(1, 0, 2)
        moves += [(0, *self._sum_by(kinds, gradients)), (1, slice(None), places)]
        if words is not None:
            some = np.flatnonzero(words < m.words)
            if len(some):
                moves += [(4, *self._sum_by(words.take(some), gradients.take(some, axis=0)))]
        for move in moves:
            self._move(*move)

    def _noise(self) -> np.ndarray:
        """The classes drawn for a step; those of many steps are drawn at once."""
        if not len(self._drawn):
            self._drawn = self.rng.choice(len(self.model.noise), DRAWN * NOISE, p=self.model.noise).reshape(-1, NOISE)
        noise, self._drawn = self._drawn[0], self._drawn[1:]
        return noise

    def _words(self, predicted, by_prediction, target_words, scale) -> list[tuple]:
        """The same for words in their classes, whose noise are the class's words, all alike."""
        m = self.model
        here = np.flatnonzero(target_words < m.words)
        if not len(here):
            return []
        words, given = target_words[here], predicted.take(here, axis=0)
        lo = words // m.width * m.width
        size = np.minimum(m.width, m.words - lo)
        noise = lo[:, None] + (self.rng.random((len(here), WORD_NOISE)) * size[:, None]).astype(np.int64)
        both = np.concatenate((words[:, None], noise), axis=1)
        vectors = m.word_outputs.take(both, axis=0)
        expected = np.log(WORD_NOISE / size).astype(given.dtype)[:, None]
        scores = expected - np.einsum("ijk,ik->ij", vectors, given) - m.word_biases.take(both)
        by_score = _logistic(scores, scale)
        by_score[:, 0] -= scale
        moved = np.einsum("ij,ijk->ik", by_score, vectors)
        moved += by_prediction.take(here, axis=0)
        _put(by_prediction, here, moved)
        by_row = np.einsum("ij,ik->ijk", by_score, given, out=vectors)
        rows, sums, biases = self._sum_by(both.ravel(), by_row.reshape(-1, SIZE), by_score.ravel())
        return [(5, rows, sums), (6, rows, biases)]

    def _sum_by(self, rows: np.ndarray, values: np.ndarray, biases: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """The distinct rows and each one's sum of values, of which a row has an even number, and of ``biases``, one a row."""
        here = np.arange(len(rows))
        self._place[rows] = here
        last = self._place.take(rows) == here
        kept, rest = np.flatnonzero(last), np.flatnonzero(~last)
        found, sums = rows.take(kept), values.take(kept, axis=0)
        out = (found, sums) if biases is None else (found, sums, biases.take(kept))
        if len(rest):
            self._place[found] = here[: len(found)]
            place = self._place.take(rows.take(rest))
            # Two values are added at once, as a complex one.
            kind = np.complex64 if values.dtype == np.float32 else np.complex128
            pairs, wide = values.take(rest, axis=0).view(kind), values.shape[1] // 2
            at = place[:, None] * wide + np.arange(wide)
            np.add.at(sums.view(kind).ravel(), at.ravel(), pairs.ravel())
            if biases is not None:
                np.add.at(out[2], place, biases.take(rest))
        return out


def _logistic(negated: np.ndarray, scale: np.floating) -> np.ndarray:
    """``scale`` times the logistic function of scores, whose negatives are given and overwritten."""
    with np.errstate(over="ignore"):  # one over infinity is nothing
        np.exp(negated, out=negated)
    negated += 1
    return np.divide(scale, negated, out=negated)


def _put(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``table[rows] = values``, each row written as a whole."""
    if table.ndim > 1:
        whole = f"V{table.shape[1] * table.itemsize}"
        table, values = table.view(whole), values.view(whole)
    table.put(rows, values)


def contexts_of(classes: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """The classes before each token, the nearest first; ``start`` before a text's first."""
    begins = np.cumsum(lengths) - lengths
    out = np.empty((len(classes), CONTEXT), np.uint32)
    for i in range(CONTEXT):
        out[i + 1 :, i] = classes[: max(len(classes) - i - 1, 0)]
        for j in range(i + 1):
            out[begins[lengths > j] + j, i] = start
    return out


def _runs(
    codes: np.ndarray, lengths: np.ndarray, start: int, rng: np.random.Generator
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All tokens in batches of runs drawn from all texts: a batch's codes, each token's context and each token, as places in them.

    Texts follow each other, ``CONTEXT`` times ``start`` before each, and are cut every ``RUN`` codes; a run is read with the codes of its
    first token's context.
    """
    text = np.full(-(-(len(codes) + CONTEXT * len(lengths)) // RUN) * RUN + CONTEXT, start)
    text[np.arange(len(codes)) + CONTEXT * np.repeat(np.arange(1, len(lengths) + 1), lengths)] = codes
    order = rng.permutation((len(text) - CONTEXT) // RUN)
    inside = (np.arange(BATCH // RUN)[:, None] * (RUN + CONTEXT) + np.arange(CONTEXT, RUN + CONTEXT)).ravel()
    for at in range(0, len(order), BATCH // RUN):
        some = order[at : at + BATCH // RUN]
        batch = text.take(some[:, None] * RUN + np.arange(RUN + CONTEXT)).ravel()
        tokens = inside[: len(some) * RUN]
        tokens = tokens[batch.take(tokens) != start]
        if len(tokens):
            yield batch, tokens[:, None] - np.arange(1, CONTEXT + 1), tokens


def _round(classified: DataFrame, classes: Classes, model: LogBilinear, turn: int) -> None:
    """Train in every group of partitions and average: rows of classes by tokens, rows of words by theirs."""
    number, start = classes.number, model.as_kind(np.float32)
    # Each trainer sends its parameters once, so their number follows the cores and not the input.
    trainers = 2 * classified.sparkSession.sparkContext.defaultParallelism

    def train(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = start.as_kind(np.float32)
        trainer = Trainer(own, (turn << 32) + TaskContext.get().partitionId())
        tokens, seen = 0, np.zeros(own.words + 1, np.int64)
        for frame in frames:
            for row in frame.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                units, codes = _units_and_codes(row)
                kinds, words = classes.split(np.append(units, number))
                learnt = ~np.array(row["held"], bool)
                codes, lengths = codes[np.repeat(learnt, lengths)], lengths[learnt]
                for text, before, after in _runs(codes, lengths, len(units), trainer.rng):
                    found = kinds.take(text), words.take(text) if own.words else None
                    trainer.step_in(*found, before, *(None if x is None else x.take(after) for x in found))
                tokens += len(codes)
                np.add.at(seen, words, np.bincount(codes, minlength=len(words)))
        if tokens:
            rows = own.rows()
            weights = np.concatenate((np.full(len(rows) - own.words, tokens), seen[:-1])).astype(np.float64)
            for at in range(0, len(rows), ROWS):
                some = at + np.flatnonzero(weights[at : at + ROWS])
                if len(some):
                    yield pa.RecordBatch.from_pydict({
                        "block": [at // ROWS], "rows": [_i64(some)], "weights": [weights[some].tobytes()],
                        "vals": [rows[some].tobytes()],
                    })

    def average(table: pa.Table) -> pa.Table:
        at = table.column("block")[0].as_py() * ROWS
        weight, total = np.zeros(ROWS), np.zeros((ROWS, 2 * SIZE + 1))
        for r in table.to_pylist():
            here, own = np.frombuffer(r["rows"], np.int64) - at, np.frombuffer(r["weights"], np.float64)
            weight[here] += own
            total[here] += np.frombuffer(r["vals"], np.float32).reshape(len(here), -1) * own[:, None]
        some = np.flatnonzero(weight)
        means = (total[some] / weight[some, None]).astype(np.float32)
        return pa.table({"rows": [_i64(some + at)], "vals": [means.tobytes()]})

    trained = classified.select("lengths", "held", "units", "codes").coalesce(trainers).mapInArrow(
        train, "block long, rows binary, weights binary, vals binary"
    )
    values = model.rows()
    for here, means in trained.groupBy("block").applyInArrow(average, "rows binary, vals binary").collect():
        values[np.frombuffer(here, np.int64)] = np.frombuffer(means, np.float32).reshape(-1, 2 * SIZE + 1)
    model.load(values)


def _i64(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, np.int64).tobytes()


def fit(classified: DataFrame, classes: Classes, rounds: int = ROUNDS) -> LogBilinear:
    model = LogBilinear(classes.number, classes.masses, classes.words, classes.width)
    for turn in range(rounds):
        _round(classified, classes, model, turn)
    return model


def _distinct_pairs(contexts: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of two units, ordered by the second, and which of them each row is."""
    wide, low = units.bit_length(), len(contexts).bit_length()
    keys = contexts[:, 1].astype(np.int64)
    keys <<= wide
    keys |= contexts[:, 0]
    if 2 * wide + low < 64:  # sorting keys with their places in them is much faster than finding the order
        keys <<= low
        keys |= np.arange(len(keys))
        keys.sort()
        places = keys & ((1 << low) - 1)
        keys >>= low
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        where = np.empty(len(keys), np.uint32)
        where[places] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        del places
        keys = keys[new]
    else:
        keys, where = np.unique(keys, return_inverse=True)
    return np.stack((keys & ((1 << wide) - 1), keys >> wide), axis=1), where


def log_probabilities(
    model: LogBilinear, classes: Classes, units: np.ndarray, codes: np.ndarray, lengths: np.ndarray
) -> np.ndarray:
    """The natural log-probability of each token, whose unit is ``units[code]``; equal contexts are normalised once."""
    kinds, words = classes.split(np.append(units, classes.number))  # the last is before a text's first token
    vectors = model.vectors(kinds, words)
    placed = [vectors @ place for place in model.places]
    contexts = contexts_of(codes, lengths, len(units))
    pairs, where = _distinct_pairs(contexts, len(units))
    logs = -model.log_classes_of_pairs(placed, pairs).take(where)
    before = np.ascontiguousarray(contexts.T)
    del contexts, pairs, where

    def predicted(some: np.ndarray | slice) -> np.ndarray:
        out = placed[0].take(before[0][some], axis=0)
        for i in range(1, CONTEXT):
            out += placed[i].take(before[i][some], axis=0)
        return out

    for at in range(0, len(codes), BATCH):
        cut = slice(at, at + BATCH)
        found = kinds.take(codes[cut])
        logs[cut] += np.einsum("ij,ij->i", predicted(cut), model.outputs.take(found, axis=0)) + model.biases.take(found)
    words = words.take(codes)
    own = np.flatnonzero(words < model.words)
    safe = _within(placed, model.word_outputs, model.word_biases)
    of = (lambda part: predicted(own[part])), safe, words[own]
    logs[own] += model._log_words(*of, placed, lambda part: before[:, own[part]].T.astype(np.int64))
    return np.minimum(logs, 0.0)  # rounding apart, none is above


def _pools(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """Chunks that are scored together."""
    pool, tokens = [], 0
    for row in rows:
        pool.append(row)
        tokens += sum(row["lengths"])
        if tokens >= POOL:
            yield pool
            pool, tokens = [], 0
    if pool:
        yield pool


def _joined(pool: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The units, codes and lengths of several chunks as those of one."""
    each = [_units_and_codes(row) for row in pool]
    units, where = np.unique(np.concatenate([units for units, _ in each]), return_inverse=True)
    parts, at = [], 0
    for own, codes in each:
        parts.append(where[at : at + len(own)].take(codes))
        at += len(own)
    return units, np.concatenate(parts), np.concatenate([np.array(row["lengths"], np.int64) for row in pool])


def _scored(classified: DataFrame, classes: Classes, model: LogBilinear, kind: str) -> DataFrame:
    model, tokens = model.as_kind(np.float32), classes.tokens

    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pool in _pools(row for frame in frames for row in frame.to_pylist()):
            units, codes, lengths = _joined(pool)
            logs = log_probabilities(model, classes, units, codes, lengths)
            by_model = np.add.reduceat(logs, np.cumsum(lengths) - lengths) / np.log(10)
            at = 0
            for row in pool:
                n = len(row["ids"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], _arrow_type(kind)), pa.array(row["held"], pa.bool_()),
                        pa.array(row["lengths"], pa.int64()), pa.array(row["known"], pa.int64()),
                        pa.array(np.full(n, tokens)), pa.array(row["base"], pa.float64()),
                        pa.array(by_model[at : at + n] + np.array(row["inside"])),
                    ],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
                at += n

    return classified.mapInArrow(
        score,
        f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )


def score_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortlist: int = SHORTLIST, rounds: int = ROUNDS
) -> DataFrame:
    """Per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (smoothed
    unigrams) and ``score``, the model's log10 probability of the text.
    """
    docs = df.select(
        F.col(id_col).alias("doc"), held_out(F.col(id_col)).alias("held"), F.col(text_col).alias("text")
    )
    kind = docs.schema["doc"].dataType.simpleString()
    encoded = stored(_encoded(docs), "encoded")
    counted = stored(_counted(encoded, shortlist), "counted")
    classes = _classes(counted, shortlist)
    classified = stored(_classified(encoded, counted, classes), "classified")
    model = fit(classified, classes, rounds)
    return _scored(classified, classes, model, kind).withColumnRenamed("id", id_col)
