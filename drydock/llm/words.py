"""Words of a batch of texts as 64-bit hashes, found and hashed by whole-array numpy steps."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once; texts beyond are cut between words, so that memory stays bounded.
PIECE = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))


def byte_table(separators: bytes) -> np.ndarray:
    """Bytes as they are hashed: A-Z lower-cased, separators 0, all others one up."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[65:91] += 32
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


BLANK_TABLE = byte_table(b" \t\n\x0b\x0c\r")
PUNCTUATION_TABLE = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: the finalising steps of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, ODD), np.full(n, INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _word_hashes(blob: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of ``blob``."""
    values = table[blob]
    inside = np.empty(len(values) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.not_equal(values, 0, out=inside[1:-1].view(bool))
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    n = max(PIECE, 1 << (len(values) + 1).bit_length())
    up, down = _powers(n)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _pieces(texts: list[bytes], table: np.ndarray) -> Iterator[tuple[list[bytes], list[int]]]:
    """Texts gathered to about PIECE bytes; a longer text is cut at separators."""
    held, rows, size = [], [], 0
    for row, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = at + PIECE
            if end < len(text):
                while end < len(text) and table[text[end]]:
                    end += 1
            part = text[at:end]
            at = end
            if held and size + len(part) > PIECE:
                yield held, rows
                held, rows, size = [], [], 0
            held.append(part)
            rows.append(row)
            size += len(part) + 1
    if held:
        yield held, rows


def words_of(texts, table: np.ndarray = BLANK_TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin.

    ``offsets`` has one entry more than there are texts. None counts as an empty text.
    """
    return words_in([t.encode("utf-8", "surrogatepass") if t else b"" for t in texts], table)


def words_in(encoded: list[bytes], table: np.ndarray = BLANK_TABLE) -> tuple[np.ndarray, np.ndarray]:
    """``words_of`` for texts in UTF-8."""
    found, counts = [], np.zeros(len(encoded), np.int64)
    for parts, rows in _pieces(encoded, table):
        blob = np.frombuffer(b" ".join(parts), np.uint8)
        hashes, starts = _word_hashes(blob, table)
        lengths = np.array([len(p) + 1 for p in parts])
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        per_part = np.diff(np.searchsorted(starts, bounds))
        np.add.at(counts, rows, per_part)
        found.append(hashes)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), offsets


def shingles_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of all words as one run if there are fewer."""
    if len(hashes) == 0:
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = np.full(n, np.uint64(width))
    for i in range(width):
        out = mix(out * ODD + hashes[i : i + n])
    return out


def batches(texts, limit: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters each."""
    start, size = 0, 0
    for row, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= limit:
            yield start, row + 1
            start, size = row + 1, 0
    if start < len(texts):
        yield start, len(texts)
