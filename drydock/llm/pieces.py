"""SentencePiece encoding and decoding by suffix-array matching and relaxation.

The segments of a batch of texts are laid end to end and indexed by a suffix array. Every
piece of the vocabulary is looked up in it by binary search, one character at a time and for
all pieces at once; the ranges found are the piece's occurrences. Occurrences are edges between
text positions. Sorted by position, they are relaxed from left to right, in step over all
segments of the batch.

What relaxing an edge means depends on the model. In a unigram model the best sum of scores
wins. In a BPE model (such as the public vocabulary that the queries use) scores are merge
ranks, and their sum is not what merging minimises. There an edge is taken if it continues
the tokens before it as merging would: the last token and the new one, written
together, must merge to just these two. Every prefix of a text has one such last token, so the
relaxation gives the tokens of the model's own encoder; the tests compare the two.

Texts are first cut where no piece can reach across (before runs of blanks, if the
vocabulary allows it), and segments that a worker has met lately are not encoded again. What a worker
keeps is bounded in bytes, and texts of a batch are taken a few MB at a time, so its memory does not
grow with the input.

Defined cases: a NULL text has NULL ids and a NULL decoded text; an empty text has no tokens;
characters outside the vocabulary become byte pieces, or the unknown piece in a model without
them; a text's own U+2581 decodes to a blank, as it stands for one; repeated rows are encoded
alike; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from drydock.llm.words import INVERSE, ODD, mix

BLANK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters indexed by one suffix array, and how many times as many bytes of texts are taken at once.
INDEXED = 1 << 18
TAKEN = 8
#: Bytes of segments that a worker remembers, what one takes besides its characters and ids, and
#: places for verdicts on pairs of tokens (a power of two).
REMEMBERED = 160 << 20
ENTRY = 220
VERDICTS = 1 << 21
#: What a unigram model's unknown character scores below its worst piece (fixed by the format).
UNKNOWN_PENALTY = 10.0


@dataclass
class Model:
    """What the encoder needs of a model file; as large as the vocabulary."""

    name: str
    kind: int
    pieces: list[str]
    scores: list[float]
    types: list[int]
    dummy_prefix: bool
    trim_blanks: bool


def load_model(path: str) -> Model:
    """Read a model file on the driver; tasks get the parsed vocabulary with their code."""
    from sentencepiece import sentencepiece_model_pb2 as format_

    proto = format_.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    kind, rules = proto.trainer_spec.model_type, proto.normalizer_spec
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    if rules.precompiled_charsmap or not rules.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models with identity normalisation and leading blanks are supported")
    types = [p.type for p in proto.pieces]
    if USER in types:
        raise ValueError("models with user-defined symbols are not supported")
    return Model(
        path, kind, [p.piece for p in proto.pieces], [p.score for p in proto.pieces], types,
        rules.add_dummy_prefix, rules.remove_extra_whitespaces,
    )


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next ``depth`` codes, by prefix doubling."""
    n = len(codes)
    ahead = np.concatenate((codes, np.zeros(2, codes.dtype)))
    key, seen = (ahead[:n] << 42) | (ahead[1 : n + 1] << 21) | ahead[2:], 3  # codes have 21 bits
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if seen >= depth or rank.max(initial=0) == n - 1:
            return order
        key = rank * (n + 1)
        key[: max(0, n - seen)] += rank[seen:] + 1
        seen *= 2


def _bound(codes, suffixes, at, lo, hi, wanted, right: bool) -> np.ndarray:
    """Per query: the first suffix in [lo, hi) whose code at ``at`` is not below (or above) wanted."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        middle = (lo[open_] + hi[open_]) >> 1
        here = codes[suffixes[middle] + at]
        below = here <= wanted[open_] if right else here < wanted[open_]
        lo[open_[below]] = middle[below] + 1
        hi[open_[~below]] = middle[~below]
    return lo


def occurrences(codes: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, piece) of every occurrence of every piece, by binary search in a suffix array."""
    depth = int(lengths.max(initial=1))
    padded = np.concatenate((codes, np.zeros(depth + 1, codes.dtype)))
    suffixes = suffix_array(codes, depth).astype(np.int32)
    alive = np.arange(len(pieces))
    lo, hi = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(codes), np.int64)
    for at in range(depth):
        alive = alive[(lengths[alive] > at) & (lo[alive] < hi[alive])]
        wanted = pieces[alive, at]
        first = _bound(padded, suffixes, at, lo[alive], hi[alive], wanted, right=False)
        last = _bound(padded, suffixes, at, first, hi[alive], wanted, right=True)
        lo[alive], hi[alive] = first, last
    counts = hi - lo
    found = np.repeat(np.arange(len(pieces), dtype=np.int32), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return suffixes[np.repeat(lo, counts) + within], found


class Decoder:
    """What each id stands for."""

    def __init__(self, model: Model) -> None:
        self.dummy_prefix = model.dummy_prefix
        self.surface = []
        for piece, kind in zip(model.pieces, model.types, strict=True):
            text = " ⁇ " if kind == UNKNOWN else "" if kind == CONTROL else piece.replace(BLANK, " ")
            self.surface.append(bytes([int(piece[1:-1], 16)]) if kind == BYTE else text.encode("utf-8", "surrogatepass"))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class Memo:
    """The ids of segments met lately, in about ``limit`` bytes.

    It has two halves; when the young one is full it takes the place of the old one, and only what has been asked for
    since then stays.
    """

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def add(self, segment: str, ids: bytes) -> None:
        if self.size > self.limit // 2:
            self.young, self.old, self.size = {}, self.young, 0
        self.young[segment] = ids
        self.size += ENTRY + 2 * len(segment) + len(ids)


class Encoder:
    """A model with its tables, as each Python worker keeps it."""

    def __init__(self, model: Model, remembered: int | None = None, indexed: int | None = None) -> None:
        self.model = model
        self.indexed = INDEXED if indexed is None else indexed
        usable = [i for i, t in enumerate(model.types) if t in (NORMAL, UNUSED) and model.pieces[i]]
        if model.kind == UNIGRAM:
            usable = [i for i in usable if model.types[i] == NORMAL]
        self.ids = np.array(usable, np.int64)
        self.rank = {model.pieces[i]: model.scores[i] for i in usable}
        self.lengths = np.array([len(model.pieces[i]) for i in usable], np.int64)
        width = int(self.lengths.max(initial=1))
        self.codes = np.zeros((len(usable), width), np.int64)
        for row, i in enumerate(usable):
            self.codes[row, : len(model.pieces[i])] = [ord(c) + 1 for c in model.pieces[i]]
        self.byte_ids = {
            int(model.pieces[i][1:-1], 16): i for i, t in enumerate(model.types) if t == BYTE
        }
        self.unknown = model.types.index(UNKNOWN) if UNKNOWN in model.types else 0
        # Tokens are rows of self.codes; characters that no piece spells follow them.
        self.spelled = [model.pieces[i] for i in usable]
        self.outside: dict[str, int] = {}
        self.token_lengths = self.lengths
        self.known_pairs = np.full(VERDICTS, -1, np.int64)
        self.known_verdicts = np.zeros(VERDICTS, bool)
        self.memo = Memo(REMEMBERED if remembered is None else remembered)
        #: Whether no piece reaches across the begin of a run of blanks.
        self.parted = not any(BLANK in p.lstrip(BLANK) for p in self.rank)

    def normalised(self, text: str) -> str:
        if self.model.trim_blanks:
            text = re.sub(" +", " ", text.strip(" "))
        text = text.replace(" ", BLANK)
        return BLANK + text if self.model.dummy_prefix and text else text

    def merged(self, text: str) -> list[str]:
        """Merging itself, for short strings: the best-ranked pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def _spelling(self, token: int) -> str:
        return self.spelled[token]

    def _continues(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each token (after ``before``, or at the start where that is -1) stays as it is.

        A pair has one place among the known ones, and a new one takes that of an older one.
        """
        pairs = (before.astype(np.int64) + 1) * (1 << 32) + tokens
        place = (mix(pairs.view(np.uint64)) & np.uint64(VERDICTS - 1)).astype(np.int64)
        verdicts = self.known_verdicts[place]
        fresh = np.flatnonzero(self.known_pairs[place] != pairs)
        if fresh.size:
            new, sample, where = np.unique(pairs[fresh], return_index=True, return_inverse=True)
            found = np.empty(len(new), bool)
            for i, pair in enumerate(new.tolist()):
                left, right = (pair >> 32) - 1, self.spelled[pair & 0xFFFFFFFF]
                parts = [right] if left < 0 else [self.spelled[left], right]
                found[i] = self.merged("".join(parts)) == parts
            verdicts[fresh] = found[where]
            self.known_pairs[place[fresh[sample]]] = new
            self.known_verdicts[place[fresh[sample]]] = found
        return verdicts

    def _edges(self, segments: list[str]) -> tuple:
        """Segment starts and lengths, and all edges as (start, token)."""
        lengths = np.array([len(s) for s in segments], np.int64)
        codes = np.frombuffer("\0".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        codes[(starts + lengths)[:-1]] = 0
        at, tokens = occurrences(codes, self.codes, self.lengths)
        alone = np.ones(len(codes), bool)
        alone[at[self.lengths[tokens] == 1]] = False
        alone &= codes > 0
        outside = np.flatnonzero(alone)
        extra = []
        for code in codes[outside].tolist():
            char = chr(code - 1)
            if char not in self.outside:
                self.outside[char] = len(self.spelled)
                self.spelled.append(char)
            extra.append(self.outside[char])
        if len(self.spelled) > len(self.token_lengths):
            ones = np.ones(len(self.spelled) - len(self.lengths), np.int64)
            self.token_lengths = np.concatenate((self.lengths, ones))
        at = np.concatenate((at, outside))
        tokens = np.concatenate((tokens, np.array(extra, np.int64)))
        return starts, lengths, at.astype(np.int32), tokens.astype(np.int32)

    def _relaxed(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment."""
        starts, lengths, at, tokens = self._edges(segments)
        size = int(starts[-1] + lengths[-1] + 2)
        # A node is a position in its own segment; a segment's end is the place of its separator.
        first = np.repeat(starts, lengths + 1).astype(np.int32)
        ends = at + self.token_lengths[tokens].astype(np.int32)
        steps = ends - first[at]
        small = steps.max(initial=0) < 1 << 16
        order = np.argsort(steps.astype(np.uint16) if small else steps, kind="stable")
        at, tokens, ends, steps = at[order], tokens[order], ends[order], steps[order]
        last = np.full(size, -1, np.int64)
        bounds = np.searchsorted(steps, np.arange(1, int(steps.max(initial=0)) + 2))
        if self.model.kind == UNIGRAM:
            worst = min(self.model.scores[i] for i in self.ids) - UNKNOWN_PENALTY
            scores = np.full(len(self.spelled), worst)
            scores[: len(self.ids)] = np.array(self.model.scores)[self.ids]
            best = np.full(size, -np.inf)
            best[starts] = 0.0
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            if self.model.kind == UNIGRAM:
                total = best[at[a:b]] + scores[tokens[a:b]]
                by_score = np.argsort(total, kind="stable")
                best[ends[a:b][by_score]] = total[by_score]
                last[ends[a:b][by_score]] = tokens[a:b][by_score]
                continue
            begins = at[a:b] == first[at[a:b]]
            before = np.where(begins, -1, last[at[a:b]])
            reached = np.flatnonzero(begins | (before >= 0))
            good = reached[self._continues(before[reached], tokens[a:b][reached])]
            last[ends[a:b][good]] = tokens[a:b][good]
        return self._traced(segments, starts, starts + lengths, last)

    def _traced(self, segments, starts, ends, last) -> list[bytes]:
        now, owners, taken = ends.copy(), [], []
        open_ = np.arange(len(segments))
        lost = np.zeros(len(segments), bool)
        while open_.size:
            token = last[now[open_]]
            lost[open_[token < 0]] = True
            open_, token = open_[token >= 0], token[token >= 0]
            owners.append(open_)
            taken.append(token)
            now[open_] -= self.token_lengths[token]
            open_ = open_[now[open_] > starts[open_]]
        owner, token = np.concatenate(owners)[::-1], np.concatenate(taken)[::-1]
        token = token[np.argsort(owner, kind="stable")]
        bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(segments)))))
        return self._as_bytes(segments, token, bounds, lost)

    def _as_bytes(self, segments, token, bounds, lost) -> list[bytes]:
        """Ids of each segment as 32-bit numbers. Segments with characters outside the vocabulary,
        and those the relaxation could not reach, are put together one by one.
        """
        plain = token < len(self.ids)
        blob = self.ids[np.where(plain, token, 0)].astype(np.int32).tobytes()
        out = [blob[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        odd = lost.copy()
        odd[np.searchsorted(bounds, np.flatnonzero(~plain), side="right") - 1] = True
        index = {s: i for i, s in enumerate(self.spelled)} if lost.any() else {}
        for i in np.flatnonzero(odd).tolist():
            tokens = token[bounds[i] : bounds[i + 1]].tolist()
            if lost[i]:
                tokens = [index[p] for p in self.merged(segments[i])]
            out[i] = np.array(self._ids_of(tokens), np.int32).tobytes()
        return out

    def _ids_of(self, tokens: list[int]) -> list[int]:
        out: list[int] = []
        for token in tokens:
            if token < len(self.ids):
                out.append(int(self.ids[token]))
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in self.spelled[token].encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _learn(self, segments: list[str]) -> dict[str, bytes]:
        """The ids of new segments, some of them indexed together."""
        found, group, size = {}, [], 0
        for number, segment in enumerate(segments, 1):
            group.append(segment)
            size += len(segment) + 1
            if size >= self.indexed or number == len(segments):
                found.update(zip(group, self._relaxed(group), strict=True))
                group, size = [], 0
        for segment, ids in found.items():
            self.memo.add(segment, ids)
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The ids of each text. Texts are laid end to end; each distinct segment is looked up or encoded once."""
        normal = ["" if t is None else self.normalised(t) for t in texts]
        whole, ends = "".join(normal), np.cumsum([len(t) for t in normal])
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        cut = np.zeros(len(codes) + 1, bool)
        cut[np.concatenate(([0], ends)).astype(np.int64)] = True
        if self.parted:
            blank = codes == ord(BLANK)
            cut[1:-1] |= blank[1:] & ~blank[:-1]
        starts = np.flatnonzero(cut[:-1])
        lengths = np.diff(np.append(starts, len(codes)))
        number, sample = alike(codes, starts, lengths)
        distinct = [whole[a : a + n] for a, n in zip(starts[sample].tolist(), lengths[sample].tolist(), strict=True)]
        known = self._known(distinct)
        sizes = np.array([len(ids) >> 2 for ids in known], np.int64)
        flat, first = np.frombuffer(b"".join(known), np.int32), np.cumsum(sizes) - sizes
        counts = sizes[number]
        ids = flat[np.arange(counts.sum()) + np.repeat(first[number] - (np.cumsum(counts) - counts), counts)]
        owner = np.searchsorted(ends, starts, side="right")
        per_text = np.bincount(owner, counts, len(texts)).astype(np.int64)
        parts = np.split(ids, np.cumsum(per_text)[:-1]) if texts else []
        return [None if t is None else part for t, part in zip(texts, parts, strict=True)]

    def _known(self, segments: list[str]) -> list[bytes]:
        """The ids of distinct segments, remembered or new."""
        young, old = self.memo.young, self.memo.old
        known = {s: young.get(s) for s in segments}
        for segment in [s for s, ids in known.items() if ids is None and s in old]:
            known[segment] = old[segment]
            self.memo.add(segment, old[segment])
        known.update(self._learn([s for s, ids in known.items() if ids is None]))
        return [known[s] for s in segments]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, ODD), np.full(n, INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def alike(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each run of codes, the same for equal ones, and a sample of each number.

    Runs are brought together by hash and then compared code by code, so equal numbers mean equal runs.
    """
    up, down = _powers(1 << max(20, (len(codes) + 1).bit_length()))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint32(1)) * up[: len(codes)], out=sums[1:])
    hashes = mix((sums[starts + lengths] - sums[starts]) * down[starts] + lengths.astype(np.uint64))
    _, sample, number = np.unique(hashes, return_index=True, return_inverse=True)
    shift = starts[sample][number] - starts
    same = (lengths[sample][number] == lengths).all() and np.array_equal(
        codes, codes[np.arange(len(codes)) + np.repeat(shift, lengths)]
    )
    if same:
        return number, sample
    runs = [codes[a : a + n].tobytes() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    _, sample, number = np.unique(np.array(runs, object), return_index=True, return_inverse=True)
    return number, sample


_KEPT: dict[tuple, Encoder | Decoder] = {}


def _kept(kind: type, model: Model, *options: int) -> Encoder | Decoder:
    """One of a kind per model and worker, so that what it has learnt is used again."""
    key = (kind, model.name, *options)
    if key not in _KEPT:
        _KEPT[key] = kind(model, *options)
    return _KEPT[key]


def _parts(texts: pa.Array, taken: int) -> Iterator[pa.Array]:
    """Slices of a column with about ``taken`` bytes each; they become Python strings one after the other."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(sizes // taken)) + 1).tolist(), len(texts)]
    return (texts.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def _id_lists(found: list[np.ndarray | None]) -> pa.Array:
    lengths = [0 if x is None else len(x) for x in found]
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    values = np.concatenate([x for x in found if x is not None] or [np.zeros(0, np.int32)])
    missing = pa.array([x is None for x in found], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=missing)


def encode(text: Column, model: Model) -> Column:
    """The ids of a text, ``array<int>``."""

    @F.arrow_udf("array<int>")
    def ids(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _kept(Encoder, model)
        for column in columns:
            yield pa.concat_arrays([_id_lists(encoder.encode(part.to_pylist())) for part in _parts(column, INDEXED * TAKEN)])

    return ids(text)


def decode(ids: Column, model: Model) -> Column:
    """The text that ids stand for."""

    @F.arrow_udf("string")
    def text(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _kept(Decoder, model)
        for column in columns:
            yield pa.array([None if x is None else decoder.decode(x) for x in column.to_pylist()], pa.string())

    return text(ids)


def tokenised(df: DataFrame, text: Column, model: Model, *keep: str, remembered: int = REMEMBERED, indexed: int = INDEXED) -> DataFrame:
    """Both ways in one pass: ``row`` (a struct of the kept columns), ``ids``, ``decoded`` and ``round_trip``.

    ``round_trip`` says whether the ids decode to the very text, for a NULL text too. ``remembered`` bytes of segments
    are kept by each worker, and ``indexed`` characters go into one suffix array; fewer cost time, never other ids.
    """
    rows = df.select(F.struct(*[F.col(c) for c in keep]).alias("row"), text.cast("string").alias("text"))
    made = rows.select(
        "row", F.lit(None).cast("array<int>").alias("ids"), F.col("text").alias("decoded"), F.lit(True).alias("round_trip")
    ).schema
    arrow = to_arrow_schema(made)

    def both(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _kept(Encoder, model, remembered, indexed), _kept(Decoder, model)
        for table in tables:
            at = 0
            for part in _parts(table.column("text"), indexed * TAKEN):
                texts = part.to_pylist()
                ids = encoder.encode(texts)
                decoded = [None if x is None else decoder.decode(x.tolist()) for x in ids]
                same = [a == b for a, b in zip(texts, decoded, strict=True)]
                kept = table.column("row").slice(at, len(texts)).cast(arrow.field("row").type)
                at += len(texts)
                yield pa.RecordBatch.from_arrays([kept, _id_lists(ids), pa.array(decoded, pa.string()), pa.array(same)], schema=arrow)

    return rows.mapInArrow(both, made)
