"""Language ID by Bayesian fusion of text, declared language, address suffix and host.

The posterior of a language is the product of four kinds of evidence:

* the likelihood of the text's letter trigrams, from counts over a bounded sample of labelled
  texts (``sample_rows``, the one bounded fit here), tempered because trigrams overlap;
* the likelihood of the declared language, from the table of declared languages against
  what texts alone say, summed over all rows;
* the prior of the host, smoothed towards that of its address suffix, which is smoothed
  towards that of all rows, each summed over all rows by grouped aggregation. A row's own
  share is left out of its host's sums.

A further class, ``und``, has equally likely trigrams and stands for what is no language at
all. Rows are rejected when it wins, when no language is likelier than ``min_probability``, or
when nothing in the text is a letter.

Whole texts are read. Only sums per host move between tasks, and sums per language, whose
number is a parameter, reach the driver.

Defined cases: NULL, empty and letterless texts are ``und`` and rejected; NULL hosts,
suffixes and declarations are values of their own, and a declared language outside the list is
"other"; repeated rows count as often as they stand there and get the same answer; an empty
table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drydock.llm.common import rows_listed, stored, text_key
from drydock.llm.words import batches

LANGUAGES = ("de", "en", "es", "fr")
UNDETERMINED = "und"
HASHES = 1 << 15
#: Rows, about, from which trigrams are counted.
SAMPLE_ROWS = 4000
#: Trigrams, at most, whose evidence is taken as independent, and the weight of each.
EVIDENCE, WEIGHT = 200, 0.25
#: What a trigram counts that no labelled text of a language has.
UNSEEN = 0.1
#: Rows as much as which the wider group's prior counts.
SMOOTHING = 10.0
#: A declared language counts as right this often before rows are looked at.
TRUST = 0.8
PIECE = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point: 1 if it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all trigrams of letters and word ends, and the text of each."""
    lowered = "\0".join(t.lower() for t in texts)
    codes = np.frombuffer(f"\0{lowered}\0".encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = np.flatnonzero(codes == 0)
    letters = _letters()[codes]
    codes = np.where(letters, codes, 0)
    kept = letters.copy()
    kept[1:] |= letters[:-1]
    kept[marks] = True
    kept = np.flatnonzero(kept)
    owner = np.searchsorted(marks, kept, side="right") - 1
    codes, owner = codes[kept], np.minimum(owner, len(texts) - 1)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = (codes[i : len(codes) - 2 + i].astype(np.uint64) for i in range(3))
    mixed = (a * np.uint64(0x9E3779B1) + b) * np.uint64(0x85EBCA77) + c
    mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)
    inside = (b > 0) & (owner[:-2] == owner[1:-1])
    return mixed[inside].astype(np.int64), owner[1:-1][inside]


def _cut(texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Texts in groups of about PIECE characters; a longer text is cut between characters."""
    held, rows, size = [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), PIECE):
            held.append(text[at : at + PIECE])
            rows.append(row)
            size += len(held[-1])
            if size >= PIECE:
                yield held, rows
                held, rows, size = [], [], 0
    if held:
        yield held, rows


def text_scores(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the mean log-likelihood in each column of ``table``, and the trigrams seen."""
    sums, counts = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    for parts, rows in _cut(texts):
        hashes, owner = trigrams(parts)
        seen = np.bincount(owner, minlength=len(parts))
        np.add.at(counts, rows, seen)
        for k in range(table.shape[1]):
            np.add.at(sums[:, k], rows, np.bincount(owner, table[hashes, k], minlength=len(parts)))
    return sums / np.maximum(counts, 1)[:, None], counts


def fit(labelled: DataFrame, languages: tuple[str, ...], sample_rows: int) -> np.ndarray:
    """Log-likelihoods of trigram hashes, one column per language, from ``(text, label)`` rows.

    A text counts each of its trigrams once, so that no repetitive text shapes a language. The
    sample is drawn by a hash of the text, so that it is the same for the same rows.
    """
    rows = labelled.where(F.col("label").isin(*languages))
    n = rows.count()
    share = min(1.0, sample_rows / max(n, 1))
    drawn = F.pmod(F.xxhash64(F.lit(8), "text"), F.lit(1 << 20)) < int(share * (1 << 20))

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for frame in frames:
            texts, labels = frame.column("text").to_pylist(), frame.column("label").to_pylist()
            for language in set(labels):
                own = [t for t, x in zip(texts, labels, strict=True) if x == language]
                for parts, _ in _cut(own):
                    hashes, owner = trigrams(parts)
                    once = np.unique(owner * HASHES + hashes) % HASHES
                    totals[language] = totals.get(language, 0) + np.bincount(once, minlength=HASHES)
        for language, sums in totals.items():
            hashes = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(hashes)), pa.array(hashes), pa.array(sums[hashes])],
                names=["label", "hash", "n"],
            )

    counted = (
        rows.where(drawn).select("text", "label").mapInArrow(count, "label string, hash long, n long")
        .groupBy("label", "hash").agg(F.sum("n").alias("n")).collect()
    )  # at most HASHES rows for each language
    counts = np.full((HASHES, len(languages)), UNSEEN)
    for label, key, number in counted:
        counts[key, languages.index(label)] += number
    return np.log(counts / counts.sum(axis=0))


def _evidence(df: DataFrame, table: np.ndarray) -> DataFrame:
    """Per row: what identifies it, and the tempered log-likelihood of its text in each class."""
    classes = table.shape[1] + 1
    whole = np.concatenate((table, np.full((HASHES, 1), -np.log(HASHES))), axis=1)

    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column("text").to_pylist()
            names = ["id", "tkey", "declared", "suffix", "host"]
            for a, b in batches(texts):
                means, seen = text_scores(texts[a:b], whole)
                tempered = means * (WEIGHT * np.minimum(seen, EVIDENCE))[:, None]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(tempered.ravel()), classes)
                yield pa.RecordBatch.from_arrays(
                    [frame.column(n).slice(a, b - a) for n in names]
                    + [pa.array(seen), lists.cast(pa.list_(pa.float64()))],
                    names=[*names, "letters", "logs"],
                )

    kind = df.schema["id"].dataType.simpleString()
    schema = f"id {kind}, tkey long, declared string, suffix string, host string, letters long, logs array<double>"
    return df.select("id", "tkey", "declared", "suffix", "host", "text").mapInArrow(score, schema)


def _with_shares(df: DataFrame, logs: str, shares: str) -> DataFrame:
    """``df`` with the array ``logs`` as shares that sum to one, and ``top``, its maximum."""
    powers = F.transform(logs, lambda x: F.exp(x - F.col("top")))
    total = F.aggregate("powers", F.lit(0.0), lambda a, x: a + x)
    return (
        df.withColumn("top", F.array_max(logs))
        .withColumn("powers", powers)
        .withColumn("total", total)
        .withColumn(shares, F.transform("powers", lambda x: x / F.col("total")))
        .drop("powers", "total")
    )


def _declared_logs(scored: DataFrame, languages: tuple[str, ...], n: int) -> Column:
    """The log-likelihood of a row's declaration, as an array over the classes.

    From soft counts of declarations per class over all rows; the table has a row
    for each language of the list and two for "other" and none.
    """
    kinds = [*languages, "other", "none"]
    sums = [F.sum(F.get("alone", F.lit(k))).alias(f"s{k}") for k in range(n)]
    soft = {r[0]: r[1:] for r in scored.groupBy("declared").agg(*sums).collect()}
    counts = np.array([[soft.get(kind, [0.0] * n)[k] or 0.0 for k in range(n)] for kind in kinds])
    for i in range(len(kinds)):
        for k in range(n):
            expected = TRUST if i == k else (1 - TRUST) / (len(kinds) - 1)
            counts[i, k] += SMOOTHING * (1 / len(kinds) if k == n - 1 else expected)
    logs = np.log(counts / counts.sum(axis=0))
    rows = [F.array(*[F.lit(float(x)) for x in logs[i]]) for i in range(len(kinds))]
    choice = F.when(F.col("declared") == kinds[0], rows[0])
    for kind, row in zip(kinds[1:], rows[1:], strict=True):
        choice = choice.when(F.col("declared") == kind, row)
    return choice


def identify(
    df: DataFrame,
    table: np.ndarray,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    suffix: Column | None = None,
    languages: tuple[str, ...] = LANGUAGES,
    min_probability: float = 0.5,
) -> DataFrame:
    """Per row: id, ``tkey``, ``lang``, ``probability``, ``letters`` and ``kept``."""
    n = len(languages) + 1
    nothing = F.lit(None).cast("string")
    said = F.lower(F.regexp_extract(F.coalesce(declared if declared is not None else nothing, F.lit("")), r"^\s*([A-Za-z]+)", 1))
    kind = F.when(said == "", "none").when(said.isin(*languages), said).otherwise("other")
    rows = df.select(
        F.col(id_col).alias("id"),
        text_key(F.col(text_col)).alias("tkey"),
        kind.alias("declared"),
        F.coalesce(suffix if suffix is not None else nothing, F.lit("")).alias("suffix"),
        F.coalesce(host if host is not None else nothing, F.lit("")).alias("host"),
        F.col(text_col).alias("text"),
    )
    scored = stored(_with_shares(_evidence(rows, table), "logs", "alone").drop("top"), "language")

    def summed(*keys: str) -> DataFrame:
        sums = [F.sum(F.get("alone", F.lit(k))).alias(f"s{k}") for k in range(n)]
        return scored.groupBy(*keys).agg(F.count("*").alias("n"), *sums)

    total = scored.agg(F.count("*"), *[F.sum(F.get("alone", F.lit(k))) for k in range(n)]).first()
    base = [(x or 0.0) + 1.0 for x in total[1:]]
    base = [x / sum(base) for x in base]
    suffixes = summed("suffix").select(
        "suffix",
        *[((F.col(f"s{k}") + SMOOTHING * base[k]) / (F.col("n") + SMOOTHING)).alias(f"wide{k}") for k in range(n)],
    )
    hosts = summed("suffix", "host").join(suffixes, "suffix")

    joined = scored.join(hosts, ["suffix", "host"]).withColumn("said", _declared_logs(scored, languages, n))
    logs = []
    for k in range(n):
        others = F.greatest(F.col(f"s{k}") - F.get("alone", F.lit(k)), F.lit(0.0))
        prior = (others + SMOOTHING * F.col(f"wide{k}")) / (F.col("n") - 1 + SMOOTHING)
        logs.append(F.get("logs", F.lit(k)) + F.get("said", F.lit(k)) + F.log(prior))
    fused = _with_shares(joined.withColumn("fused", F.array(*logs)), "fused", "shares")
    names = F.array(*[F.lit(name) for name in [*languages, UNDETERMINED]])
    none = F.col("letters") == 0
    found = fused.select(
        "id",
        "tkey",
        "letters",
        F.when(none, UNDETERMINED)
        .otherwise(F.element_at(names, F.array_position("fused", F.col("top")).cast("int")))
        .alias("lang"),
        F.when(none, 1.0).otherwise(F.array_max("shares")).alias("probability"),
    )
    return found.select(
        F.col("id").alias(id_col),
        "tkey",
        "lang",
        "probability",
        "letters",
        ((F.col("lang") != UNDETERMINED) & (F.col("probability") >= min_probability)).alias("kept"),
    )


def page_columns(html: Column, url: Column) -> dict[str, Column]:
    """Text, declared language, host and address suffix of a web page."""
    address = F.lower(url)
    host = F.nullif(F.regexp_extract(address, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return {
        "text": F.regexp_replace(plain, r"<[^>]*>|&#?\w+;", " "),
        "declared": F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1),
        "host": host,
        "suffix": F.nullif(F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1), F.lit("")),
    }


def drop_undetermined(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` without the rows that :func:`identify` rejects; these few rows are what moves."""
    found = identify(df, id_col=id_col, text_col=text_col, **options).where(~F.col("kept"))
    rejected = stored(found.select(id_col, "tkey").distinct(), "rejected")
    return rows_listed(df, rejected, "left_anti", id_col, text_col).select("row.*")
