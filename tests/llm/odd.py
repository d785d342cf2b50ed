"""Fixtures that several tests import: odd documents, and none."""

from __future__ import annotations

import pytest

#: Texts that every operator must take: none, blank, short, long, repeated.
ODD_TEXTS = [
    None, "", " ", "\n", "\n\n \t\n", "a", "A", "a b", "ß ü 漢字 🙂", "x" * 20000, "w " * 20000,
    "\x00\x01", "▁ ▁", "a\r\nb\x0bc\x0cd",
]


@pytest.fixture
def odd_docs(spark):
    """Odd texts under ids of which some repeat and one is NULL, and columns with clashing names."""
    rows = [(i, text) for i, text in enumerate(ODD_TEXTS)]
    rows += [(5, "a"), (5, "a"), (5, "b"), (None, "a"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.selectExpr(
        "doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars",
        "1 AS doc", "2 AS tkey", "3 AS row", "4 AS node", "'k' AS key", "5 AS shard", "6 AS keep",
        "7 AS hash", "8 AS pos", "9 AS first", "'h' AS host", "10 AS `a.b`",
    )


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
