"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every test item gives its rare word n-grams as seeds: those that, by the frequencies of their words in
the whole corpus, would meet by chance less than once in 1 / ``CHANCE`` words. Rarity by words
(and not by counting n-grams) keeps the seeds of a passage that thousands of documents
copy. An item without a rare n-gram gives all its n-grams.

One pass over the training texts keeps the words around every possible seed; whether it is a
seed is first asked of a bitmap of fixed size, then of the seeds themselves by a join. Each
(window, item) pair that shares a seed is scored by a local alignment of words, in which
replaced, dropped and added words cost one each. So edited and paraphrased copies
score high as long as a run of ``NGRAM`` rare words is left.

Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased: neither punctuation
nor case hides a copy. Seeds and windows meet in joins; nothing of the corpus is broadcast,
and of the benchmark only the bitmap (fixed) and its distinct words, whose size is checked.

Defined cases: NULL, empty and wordless texts match nothing, on either side; items shorter
than an n-gram are one seed of their own length; a document is known by its id (NULL is
an id like any other) and text, so repeated rows are one; items with equal ids are one item
with several texts; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drydock.llm.common import rows_listed, stored, text_key
from drydock.llm.words import PUNCTUATION_TABLE, batches, shingles_of, words_of

NGRAM = 3
#: Chance meetings that a seed may have, per word of the corpus.
CHANCE = 1e-9
#: Bits of the bitmap that is asked first.
BITS = 1 << 24
#: Distinct words of the benchmark whose frequencies are looked up by broadcast.
MAX_WORDS = 5_000_000
#: Share of an item's words that the alignment must net: matches less edits.
THRESHOLD = 0.5


def words_in(texts) -> tuple[np.ndarray, np.ndarray]:
    return words_of(texts, PUNCTUATION_TABLE)


def ngrams(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams inside one text, and the place of their first word."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = shingles_of(hashes, width)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    places = np.flatnonzero(owner[: len(grams)] == owner[width - 1 :])
    return grams[places], places


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment (match 1, edit -1): its score, first word and end in the passage."""
    n = len(passage)
    score, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    steps = np.arange(n + 1)
    for word in item:
        match = np.where(passage == word, 1, -1)
        here, start = score - 1, origin.copy()
        diagonal = score[:-1] + match
        better = diagonal > here[1:]
        here[1:] = np.where(better, diagonal, here[1:])
        start[1:] = np.where(better, origin[:-1], start[1:])
        fresh = here <= 0
        here[fresh], start[fresh] = 0, steps[fresh]
        # A gap along the passage: the best of all places before, less their distance.
        lifted = here + steps
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, steps, 0))
        gapped = reach - steps
        moved = gapped > here
        start = np.where(moved, start[source], start)
        here = np.where(moved, gapped, here)
        score, origin = here, start
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(origin[top]), top)
    return best


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Per item text: its words and n-grams with the words they are of."""

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            hashes, offsets = words_in(frame.column("text").to_pylist())
            rows = [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            widths = [min(NGRAM, len(r)) for r in rows]
            grams = [shingles_of(r, NGRAM).view(np.int64) for r in rows]
            parts = [
                [r[i : i + w].view(np.int64).tolist() for i in range(len(g))]
                for r, g, w in zip(rows, grams, widths, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    frame.column("item"),
                    pa.array([r.view(np.int64).tolist() for r in rows], pa.list_(pa.int64())),
                    pa.array(widths, pa.int32()),
                    pa.array([g.tolist() for g in grams], pa.list_(pa.int64())),
                    pa.array(parts, pa.list_(pa.list_(pa.int64()))),
                ],
                names=["item", "words", "width", "grams", "parts"],
            )

    kind = benchmark.schema[item_col].dataType.simpleString()
    return (
        benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
        .mapInArrow(
            read,
            f"item {kind}, words array<long>, width int, grams array<long>, parts array<array<long>>",
        )
        .where(F.col("width") > 0)
        .withColumn("part_of", F.xxhash64("words"))
    )


def _word_counts(docs: DataFrame, words: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each of ``words`` (sorted) stands in the corpus, and how many words it has."""

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(words), np.int64), 0
        for frame in frames:
            texts = frame.column("text").to_pylist()
            for a, b in batches(texts):
                hashes, _ = words_in(texts[a:b])
                total += len(hashes)
                at = np.searchsorted(words, hashes)
                at[at == len(words)] = 0
                counts += np.bincount(at[words[at] == hashes], minlength=len(words))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(held, -1)), pa.array(np.append(counts[held], total))], names=["at", "n"]
        )

    rows = docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).collect()
    found = dict(tuple(r) for r in rows)
    counts = np.zeros(len(words), np.int64)
    for at, n in found.items():
        if at >= 0:
            counts[at] = n
    return counts, found.get(-1, 0)


def _seeds(items: DataFrame, docs: DataFrame) -> DataFrame:
    """``seed, width, item, part_of``: the rare n-grams of each item, or all if none is rare."""
    each = items.select(
        "item", "part_of", "width", F.explode(F.arrays_zip("grams", "parts")).alias("gram")
    ).select("item", "part_of", "width", F.col("gram.grams").alias("seed"), F.col("gram.parts").alias("parts"))
    distinct = items.select(F.explode("words").alias("word")).distinct()
    if (n := distinct.count()) > MAX_WORDS:
        # Too many to broadcast: every n-gram is a seed then, which costs joins and loses nothing.
        return each.select("seed", "width", "item", "part_of").distinct()
    words = np.sort(np.array([r[0] for r in distinct.collect()], np.int64).view(np.uint64))
    counts, total = _word_counts(docs, words) if n else (np.zeros(0, np.int64), 0)
    chances = np.log((counts + 1.0) / max(total, 1))

    def rate(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            logs = [
                float(chances[np.searchsorted(words, np.array(parts, np.int64).view(np.uint64))].sum())
                for parts in frame.column("parts").to_pylist()
            ]
            yield frame.select(["seed", "width", "item", "part_of"]).append_column("log_chance", pa.array(logs))

    kind = items.schema["item"].dataType.simpleString()
    rated = each.select("seed", "width", "item", "part_of", "parts").mapInArrow(
        rate, f"seed long, width int, item {kind}, part_of long, log_chance double"
    )
    rare = F.col("log_chance") <= float(np.log(CHANCE))
    any_rare = rated.groupBy("part_of").agg(F.max(rare).alias("some"))
    return (
        rated.join(any_rare, "part_of").where(rare | ~F.col("some"))
        .select("seed", "width", "item", "part_of").distinct()
    )


def _bitmap(seeds: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Which of BITS hash values have a seed, and the widths that seeds have."""
    bit = F.shiftrightunsigned("seed", 40).alias("bit")
    rows = seeds.select(bit, "width").distinct().collect()
    bitmap = np.zeros(BITS, bool)
    bitmap[[r.bit for r in rows]] = True
    return np.packbits(bitmap, bitorder="little"), sorted({r.width for r in rows})


def _windows(docs: DataFrame, bitmap: np.ndarray, widths: list[int], reach: int) -> DataFrame:
    """Runs of words around possible seeds: ``doc, tkey, start, words, hits``."""

    def scan(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column("text").to_pylist()
            rows, starts, bodies, hits = [], [], [], []
            for a, b in batches(texts):
                hashes, offsets = words_in(texts[a:b])
                found = [_possible(hashes, offsets, width, bitmap) for width in widths]
                places = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
                seeds = np.concatenate([f[1] for f in found] or [np.zeros(0, np.uint64)])
                order = np.argsort(places, kind="stable")
                places, seeds = places[order], seeds[order]
                owner = np.searchsorted(offsets, places, side="right") - 1
                breaks = np.flatnonzero((np.diff(places) > 2 * reach) | (np.diff(owner) > 0)) + 1
                for run in np.split(np.arange(len(places)), breaks):
                    if not len(run):
                        continue
                    row = int(owner[run[0]])
                    lo = max(int(offsets[row]), int(places[run[0]]) - reach)
                    hi = min(int(offsets[row + 1]), int(places[run[-1]]) + reach)
                    rows.append(a + row)
                    starts.append(lo - int(offsets[row]))
                    bodies.append(hashes[lo:hi].tobytes())
                    hits.append(np.unique(seeds[run]).view(np.int64).tolist())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    frame.column("doc").take(at),
                    frame.column("tkey").take(at),
                    pa.array(starts, pa.int64()),
                    pa.array(bodies, pa.binary()),
                    pa.array(hits, pa.list_(pa.int64())),
                ],
                names=["doc", "tkey", "start", "words", "hits"],
            )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(scan, f"doc {kind}, tkey long, start long, words binary, hits array<long>")


def _possible(hashes, offsets, width: int, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams, places = ngrams(hashes, offsets, width)
    bits = grams >> np.uint64(40)
    hit = (bitmap[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return places[hit], grams[hit]


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per document and item found in it: id, ``tkey``, item, ``score`` (matches less edits),
    ``similarity`` (score by the item's words) and the passage's ``first_word`` and ``end_word``.
    """
    docs = df.select(
        F.col(id_col).alias("doc"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text")
    )
    items = stored(_items(benchmark, item_col, item_text_col), "items")
    seeds = stored(_seeds(items, docs), "seeds")
    bitmap, widths = _bitmap(seeds)
    longest = items.agg(F.max(F.size("words"))).first()[0] or 0
    windows = stored(_windows(docs, bitmap, widths, 2 * longest), "windows")
    place = ["doc", "tkey", "start"]
    pairs = (
        windows.select(*place, F.explode("hits").alias("seed"))
        .join(seeds.select("seed", "item", "part_of"), "seed")
        .select(*place, "item", "part_of")
        .distinct()
    )
    # NULL ids are ids like any other here, so the windows' rows are keyed by a hash as well.
    key = F.xxhash64(*place).alias("window")
    wanted = pairs.select(key, *[F.col(c).alias(f"own_{c}") for c in place], "item", "part_of")
    same = F.col("window") == F.xxhash64(*place)
    for c in place:
        same = same & F.col(c).eqNullSafe(F.col(f"own_{c}"))
    bodies = windows.select(*place, F.col("words").alias("passage")).dropDuplicates(place)
    texts = items.select("part_of", F.col("item").alias("own_item"), F.col("words").alias("wanted"))
    matched = bodies.join(wanted, same).join(
        texts, (wanted["part_of"] == texts["part_of"]) & wanted["item"].eqNullSafe(texts["own_item"])
    )

    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            passages = [np.frombuffer(x, np.int64) for x in frame.column("passage").to_pylist()]
            wanted = [np.array(x, np.int64) for x in frame.column("wanted").to_pylist()]
            found = [align(p, w) for p, w in zip(passages, wanted, strict=True)]
            scores, firsts, ends = (np.array([f[i] for f in found], np.int64) for i in range(3))
            share = scores / np.maximum([len(w) for w in wanted], 1)
            start = np.array(frame.column("start").to_pylist(), np.int64)
            out = pa.RecordBatch.from_arrays(
                [
                    *[frame.column(c) for c in ("doc", "tkey", "item")],
                    pa.array(scores), pa.array(share), pa.array(firsts + start), pa.array(ends + start),
                ],
                names=["doc", "tkey", "item", "score", "similarity", "first_word", "end_word"],
            )
            yield out.filter(pa.array(share >= threshold))

    kinds = {c: matched.schema[c].dataType.simpleString() for c in ("doc", "item")}
    scored = matched.select("doc", "tkey", "item", "start", "passage", "wanted").mapInArrow(
        score,
        f"doc {kinds['doc']}, tkey long, item {kinds['item']}, score long, similarity double, "
        "first_word long, end_word long",
    )
    best = F.max(F.struct("similarity", "score", (-F.col("first_word")).alias("f"), "end_word")).alias("best")
    return scored.groupBy("doc", "tkey", "item").agg(best).select(
        F.col("doc").alias(id_col),
        "tkey",
        F.col("item").alias(item_col),
        "best.score",
        "best.similarity",
        (-F.col("best.f")).alias("first_word"),
        "best.end_word",
    )


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` without the documents that hold a copy of a test item."""
    found = contaminated(df, benchmark, id_col, text_col, **options)
    leaks = stored(found.select(id_col, "tkey").distinct(), "leaks")
    return rows_listed(df, leaks, "left_anti", id_col, text_col).select("row.*")
