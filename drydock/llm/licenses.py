"""Licence scan: canonical digests of whole texts, looked up among known licence texts.

A unit of text (a whole document, and each of its paragraphs and lines) is brought to a
canonical form: lower case, lines that name a copyright owner out, equivalent spellings made equal,
everything but letters and digits a blank. Its SHA-256 is joined with the digests of the known
texts. These are the short notices of ``NOTICES`` and a table of whole texts: the files of
``known_licenses``, or the caller's DataFrame (``license_id, text``). The digests of this package's texts are
broadcast; those of a caller's table only if Spark finds them small enough. Documents are read and
canonicalised in one pass; what is shuffled is a row a document and one for each notice found.

Defined cases: a NULL or empty text, and one without letters or digits, matches nothing; repeated
rows each get their own answer; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drydock.llm.common import inline_table, text_key

# Spellings that mean the same, in the order in which they are replaced.
EQUIVALENT = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https://", "http://"),
    ("(c)", ""),
    ("©", ""),
    ("&", " and "),
]
#: Words that follow "copyright" in the wording of licences, where it is no owner's line.
WORDING = (
    r"(notices?|holders?|owners?|ownership|licen[sc]es?|laws?|statements?|interests?|disclaimers?|protections?|"
    r"treaty|treaties|infringement|permissions?|status|rights?|works?|material|act|and|or|in|on|is|are|as|to|of|for|under|"
    r"with|which|that|can|may|has|have|applies|if|unless|subsists|doctrines?)\b"
)
#: Lines that begin so (after blanks and comment signs) name an owner, and are not compared.
OWNER_LINE = (
    r"^[\s/*#;-]*(copyright\b[\s:,]*(\(c\)|©|[0-9]{4}|[<{\[])|copyright[\s:]+(?!" + WORDING + r")\p{L}|©|"
    r"\(c\)[\s:,]*(copyright|[0-9]{4})|all rights reserved)"
)

# Notices and short licences, as their owners publish them.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of "
        "this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
        "whom the Software is furnished to do so, subject to the following conditions:\n\nThe above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "ISC": [
        "SPDX-License-Identifier: ISC",
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose "
        "with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
        "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
}


def canonical(text: Column) -> Column:
    """Case, copyright lines, equivalent spellings and punctuation made equal."""
    lines = F.filter(F.split(F.lower(text), "\n"), lambda line: ~line.rlike(OWNER_LINE))
    joined = F.array_join(lines, " ")
    for spelling, usual in EQUIVALENT:
        joined = F.replace(joined, F.lit(spelling), F.lit(usual))
    return F.btrim(F.regexp_replace(joined, r"[^\p{L}\p{Nd}]+", " "))


def digest(text: Column) -> Column:
    """The canonical form's SHA-256, NULL where nothing is left to compare."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form.cast("binary"), 256))


TEXTS = Path(__file__).parent / "known_licenses"
END = "END OF TERMS AND CONDITIONS"


def _variants(text: str) -> list[str]:
    """A text as it is, without what follows its terms, and each of them without its title."""
    head, end, _ = text.partition(END)
    forms = [text, head + end, head] if end else [text]
    untitled = [form.strip().partition("\n\n") for form in forms]
    return [*forms, *[rest for title, _, rest in untitled if rest and len(title) <= 120]]


def published() -> list[tuple[str, str]]:
    """Licence and whole text of the files of ``known_licenses``; ID+note.txt is one of several texts of a licence."""
    paths = sorted(TEXTS.glob("*.txt"))
    return [(p.name.removesuffix(".txt").partition("+")[0], p.read_text(encoding="utf-8")) for p in paths]


def identifier_lines(name: str) -> list[str]:
    """A licence's SPDX lines."""
    endings = ("", "-only", "-or-later") if "GPL" in name or "GFDL" in name else ("",)
    return [f"SPDX-License-Identifier: {name}{ending}" for ending in endings]


def license_texts(spark: SparkSession) -> DataFrame:
    """``license_id, text``: the whole texts that come with this package, their variants and SPDX lines."""
    rows = [(name, form) for name, text in published() for form in [*_variants(text), *identifier_lines(name)]]
    names, texts = zip(*rows, strict=True)
    return spark.createDataFrame(pa.table({"license_id": list(names), "text": list(texts)}))


def known_licenses(
    spark: SparkSession, notices: dict[str, list[str]] = NOTICES, texts: DataFrame | None = None
) -> DataFrame:
    """``license_id, digest``, one row for each digest."""
    rows = [(name, text) for name, texts in notices.items() for text in texts]
    table = inline_table(spark, rows, "license_id string, text string")
    if texts is not None:
        table = table.unionByName(texts.select("license_id", "text"))
    known = table.select("license_id", digest(F.col("text")).alias("digest")).where(F.col("digest").isNotNull())
    return known.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def _units(text: Column) -> Column:
    """The text itself, its paragraphs if it has several, and its lines if it has several."""

    def split(pattern: str) -> Column:
        found = F.split(text, pattern)
        return F.when(F.size(found) > 1, found).otherwise(F.array().cast("array<string>"))

    return F.concat(F.array(text), split(r"\n[ \t\r]*\n"), split("\n"))


def scan_licenses(
    df: DataFrame,
    notices: dict[str, list[str]] = NOTICES,
    id_col: str = "doc_id",
    text_col: str = "text",
    texts: DataFrame | None = None,
) -> DataFrame:
    """Per row: id, ``license_id`` of the entire text (else NULL), ``notices`` (ids of the
    licences that a paragraph or line states, sorted) and ``n_notices`` (how many do). ``texts``
    has the known whole texts (``license_id, text``), those of this package if it is not given.
    """
    own = texts is None
    known = known_licenses(df.sparkSession, notices, license_texts(df.sparkSession) if own else texts)
    known = F.broadcast(known) if own else known
    docs = df.select(
        F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text")
    )
    nothing = F.concat(F.lit("nothing "), F.col("tkey"))  # no digest, and not the same of all documents
    units = docs.select("id", "tkey", F.posexplode(_units(F.col("text"))).alias("pos", "unit"))
    found = (
        units.select("id", "tkey", "pos", F.coalesce(digest(F.col("unit")), nothing).alias("digest"))
        .join(known, "digest", "left")
        .where((F.col("pos") == 0) | F.col("license_id").isNotNull())
    )
    whole, stated = F.col("pos") == 0, F.when(F.col("pos") > 0, F.col("license_id"))
    answers = found.groupBy("id", "tkey").agg(
        F.count_if(whole).alias("copies"),
        F.max(F.when(whole, F.col("license_id"))).alias("license_id"),
        F.array_sort(F.collect_set(stated)).alias("notices"),
        F.size(F.collect_set(F.when(stated.isNotNull(), F.col("pos")))).cast("long").alias("n_notices"),
    )
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return answers.select(F.col("id").alias(id_col), "license_id", "notices", "n_notices", each.alias("copy")).drop("copy")
