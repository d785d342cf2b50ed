from __future__ import annotations

import textwrap

import duckdb
from pyspark.sql import functions as F
from odd import no_docs, odd_docs  # noqa: F401

from drydock.llm import licenses as L
from drydock.llm import queries

MIT = L.NOTICES["MIT"][-1]


def scanned(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: (r.license_id, r.notices, r.n_notices) for r in L.scan_licenses(df).collect()}


def test_whole_texts_in_many_forms(spark):
    mangled = "/*\n * Copyright (c) 2020 Somebody\n */\n" + MIT.upper().replace("LICENSE", "LICENCE").replace(
        ",", " ;").replace("\n", "\r\n  * ")
    found = scanned(spark, MIT, mangled, MIT.replace("Software", "Hardware"), MIT[:-20], "")
    assert [found[i][0] for i in range(5)] == ["MIT", "MIT", None, None, None]


def test_notices_inside_texts(spark):
    text = "Prose.\nReleased under the MIT Licence!\nmore\nlicensed under cc by-nc 4.0\n\n" + MIT + "\n\nend"
    assert scanned(spark, text) == {0: (None, ["CC-BY-NC-4.0", "MIT"], 2)}  # MIT itself is several paragraphs


def test_known_table_is_one_row_per_digest(spark):
    known = L.known_licenses(spark, {"B": ["Same text."], "A": ["same TEXT", "other"]})
    assert sorted(r.license_id for r in known.collect()) == ["A", "A"]


def test_punctuation_and_spellings(spark):
    df = spark.createDataFrame([("Sub-License & Licence © x",), ("sublicense AND license x",)], "t string")
    assert len({r[0] for r in df.select(L.canonical(F.col("t"))).collect()}) == 1


def test_odd_texts_and_columns(odd_docs, no_docs):
    rows = L.scan_licenses(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all((r.license_id, r.notices, r.n_notices) == (None, [], 0) for r in rows)
    assert L.scan_licenses(no_docs).count() == 0
    long = odd_docs.limit(1).withColumn("text", F.concat(F.repeat(F.lit("word, " * 50), 4000), F.lit("\n"), F.lit(MIT)))
    assert L.scan_licenses(long).first().n_notices == 0  # the licence is no paragraph of its own


def test_repeated_rows_get_their_own_answers(spark):
    df = spark.createDataFrame([(1, MIT), (1, MIT), (1, "x"), (None, MIT)], "doc_id bigint, text string")
    rows = sorted((str(r.doc_id), str(r.license_id)) for r in L.scan_licenses(df).collect())
    assert rows == [("1", "MIT"), ("1", "MIT"), ("1", "None"), ("None", "MIT")]


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))


def test_texts_wrapped_at_any_width(spark):
    """Wording that a line happens to begin with 'copyright' stays; lines that name an owner go."""
    isc, widths = L.NOTICES["ISC"][-1], range(20, 100)
    texts = [wrapped(text, w) for text in (MIT, isc) for w in widths]
    assert sum(line.lower().startswith("copyright") for text in texts for line in text.split("\n")) > 20
    found = scanned(spark, *texts)
    assert [found[i][0] for i in range(len(texts))] == ["MIT"] * len(widths) + ["ISC"] * len(widths)


def test_lines_that_name_an_owner(spark):
    owners = ["Copyright (c) 2020 A", "(C) 2020 A", "# © A", "Copyright 2020, A", "Copyright <YEAR> <OWNER>", "Copyright A Inc."]
    wording = ["copyright notice and", "Copyright holders be", "copyright, patent and", "(c) You must retain", "copyright"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(owners + wording)], "i int, t string")
    left = {r[0]: r[1] for r in df.select("i", L.canonical(F.col("t"))).collect()}
    assert [left[i] == "" for i in range(len(left))] == [True] * len(owners) + [False] * len(wording)


def test_whole_texts_of_the_usual_licences(spark):
    """As published, without title or appendix, and wrapped otherwise with an owner's line."""
    names = [
        "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC",
        "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense",
    ]
    texts = {n: (L.TEXTS / f"{n}.txt").read_text() for n in names}
    wraps = ["Copyright (c) 2021 Somebody\n\n" + " \n".join(texts[n].split("\n")).upper() for n in names]
    found = scanned(spark, *texts.values(), *wraps, texts["GPL-3.0"].partition(L.END)[0] + L.END, texts["MIT"][:-40])
    assert [found[i][0] for i in range(len(found))] == [*names, *names, "GPL-3.0", None]


def test_known_texts_from_a_table(spark):
    texts = spark.createDataFrame([("House-1.0", "Use it at home.\n\nNowhere else."), ("Empty", "")], "license_id string, text string")
    df = spark.createDataFrame([(1, "Copyright 2020 A\nuse it\nAT HOME; nowhere else"), (2, "")], "doc_id bigint, text string")
    assert [r.license_id for r in L.scan_licenses(df, texts=texts).orderBy("doc_id").collect()] == ["House-1.0", None]


def test_the_sql_knows_the_same_texts_and_lines(spark):
    """Whole texts in several forms, owners' lines and licence wording: the same rows from both."""
    texts = [text for _, text in L.published()]
    texts += ["Copyright (c) 2021 Somebody\n\n" + text.upper() for text in texts]
    texts += [text.partition(L.END)[0] for text in texts] + [text.partition("\n\n")[2] for text in texts]
    texts += [wrapped(L.NOTICES["ISC"][-1], width) for width in range(20, 100, 7)]
    texts += [f"{line}\nReleased under the MIT License." for line in (
        "Copyright notice and", "copyright: Some Body", "Copyright\t2020", "(c) You", "# \u00a9 A", "copyrighted works", "COPYRIGHT \u00c9mile")]
    texts += ["SPDX-License-Identifier: MPL-2.0\nx\n\ny", None, "", "--", "\n\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = L.scan_licenses(df.union(df.limit(3)))
    got = [(r.doc_id, r.license_id, ",".join(r.notices), r.n_notices) for r in found.collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [*enumerate(texts), *list(enumerate(texts))[:3]])
    wanted = con.execute(queries.SQL["op9_license_scan"]).fetchall()
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert sum(row[1] is not None for row in got) > 100
