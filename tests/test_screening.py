from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from drydock.functions import screening
from drydock.functions.text import replay_on, slug

# Guarded forms by verb; each is tried on names that may be written and on others.
FORMS = {
    "INSERT": ["INSERT INTO {t} SELECT k FROM feed", "insert overwrite table {t} values (4)"],
    "UPDATE": ["UPDATE {t} SET weight = weight + 1", "UPDATE\n\t{t}\nSET  weight = 2"],
    "DELETE": ["DELETE FROM {t} WHERE weight > 9"],
    "MERGE": ["MERGE INTO {t} USING feed ON {t}.k = feed.k WHEN MATCHED THEN DELETE"],
    "DROP": ["DROP TABLE {t}", "drop view if exists {t}", "DROP/* now */TABLE/**/{t}"],
    "ALTER": ["ALTER TABLE {t} DROP COLUMN weight"],
    "TRUNCATE": ["TRUNCATE TABLE {t}", "TRUNCATE {t}"],
    "CREATE OR REPLACE": ["CREATE OR REPLACE TABLE {t} AS SELECT k FROM feed"],
}
NAMES = {
    "sbx_parcels": True, "SBX_Parcels": True, "depot.sbx_parcels": True, '"sbx_parcels"': True,
    "`depot` . `sbx_parcels`": True, "qg_quality_results": True, "depot.QG_Quality_Results": True,
    "parcels": False, "depot.parcels": False, '"parcels"': False, "`depot` . `parcels`": False,
    "sbx_depot.parcels": False, "old_sbx_parcels": False,
}


def shown(name):
    return name.replace(" . ", ".").translate({ord(c): None for c in "`\""}).lower()


GUARDED = [
    (form.format(t=name), "allow" if ok else "blocked", [(verb, shown(name), "allow" if ok else "blocked")])
    for (verb, forms), (name, ok) in itertools.product(FORMS.items(), NAMES.items())
    for form in forms
]
# text, batch verdict, (operation, target, verdict) of each statement
SPECIAL = [
    ("TRUNCATE sbx_parcels, parcels", "blocked", [("TRUNCATE", "sbx_parcels,parcels", "blocked")]),
    ("TRUNCATE TABLE sbx_a , depot.sbx_b", "allow", [("TRUNCATE", "sbx_a,depot.sbx_b", "allow")]),
    ("CREATE TABLE sbx_crates AS SELECT k FROM feed", "allow", [("CREATE", "sbx_crates", "allow")]),
    ("CREATE TABLE IF NOT EXISTS crates (k INT)", "review", [("CREATE", "crates", "review")]),
    ("SELECT k FROM parcels WHERE note = 'TRUNCATE parcels; --'", "allow", [("SELECT", "", "allow")]),
    ("(SELECT k FROM a) EXCEPT (SELECT k FROM b)", "allow", [("SELECT", "", "allow")]),
    ("SELECT k INTO crates FROM parcels", "review", [("SELECT", "", "review")]),
    ("WITH heavy AS (SELECT k FROM parcels) SELECT k FROM heavy", "allow", [("WITH", "", "allow")]),
    ("WITH heavy AS (SELECT k FROM feed) UPDATE parcels SET k = 0", "review", [("WITH", "", "review")]),
    ("VACUUM parcels", "review", [("VACUUM", "", "review")]),
    ("nonsense 1 2 3", "review", [("NONSENSE", "", "review")]),
    ("UPDATE", "blocked", [("UPDATE", "", "blocked")]),
    ("SELECT 'open", "blocked", [("SELECT", "", "blocked")]),
    ('SELECT "open', "blocked", [("SELECT", "", "blocked")]),
    ("SELECT k /* open", "blocked", [("SELECT", "", "blocked")]),
    (r"SELECT '\'; TRUNCATE parcels; --'", "blocked", None),
    (r"SELECT 'ends in a backslash\' AS k", "review", [("SELECT", "", "allow")]),
    ("", "allow", []),
    ("-- nothing but a remark", "allow", []),
    (";; ; ", "allow", []),
    ("/* x; y */ DELETE FROM sbx_a WHERE k = '--;' -- z; w\n; DELETE FROM b", "blocked",
     [("DELETE", "sbx_a", "allow"), ("DELETE", "b", "blocked")]),
    ("DELETE FROM sbx_a WHERE note = 'don''t; stop'; SELECT 2", "allow",
     [("DELETE", "sbx_a", "allow"), ("SELECT", "", "allow")]),
    ('UPDATE sbx_a SET "k--k" = 3; DROP TABLE parcels', "blocked",
     [("UPDATE", "sbx_a", "allow"), ("DROP", "parcels", "blocked")]),
]
CASES = GUARDED + SPECIAL


@pytest.fixture(scope="module")
def screened(spark):
    log = spark.createDataFrame(list(enumerate(c[0] for c in CASES)), "id int, sql string")
    return {r["id"]: r for r in screening.screen_log(log, "id", "sql").collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0][:40] for c in CASES])
def test_verdicts(screened, i):
    _, verdict, found = CASES[i]
    row = screened[i]
    assert row["verdict"] == verdict
    if found is not None:
        assert [(f["operation"], f["target"], f["verdict"]) for f in row["findings"]] == found


def test_rows_per_statement(spark):
    log = spark.createDataFrame(
        [(1, "SELECT 1; DROP TABLE sbx_a"), (2, ""), (3, None)], "id int, sql string"
    )
    rows = screening.screen_statements(log, "id", "sql").orderBy("statement_no").collect()
    assert [(r["id"], r["statement_no"], r["operation"], r["is_read"], r["is_ddl"]) for r in rows] == [
        (1, 1, "SELECT", True, False), (1, 2, "DROP", False, True)
    ]
    batches = {r["id"]: r["verdict"] for r in screening.screen_log(log, "id", "sql").collect()}
    assert batches == {1: "allow", 2: "allow", 3: "allow"}


def test_very_long_texts(spark):
    """Patterns must not recurse per character."""
    long = spark.range(1).select(
        "id",
        F.concat(F.lit("UPDATE sbx_a SET x = '"), F.repeat(F.lit("a'';--"), 200000),
                 F.lit("' /* "), F.repeat(F.lit("b "), 200000), F.lit("*/; SELECT "),
                 F.repeat(F.lit('"c", '), 100000), F.lit("1")).alias("sql")
    )
    row = screening.screen_log(long, "id", "sql").first()
    assert (row["verdict"], len(row["findings"])) == ("allow", 2)


SANDBOX = "sbx_crate_7"


@pytest.mark.parametrize("before", ["", "x = ", "(", "SELECT k FROM ", "'"])
@pytest.mark.parametrize("after", ["", " WHERE k = 1", ")", ".k", ";"])
@pytest.mark.parametrize(
    ("name", "wanted"),
    [
        (SANDBOX, "crate"), (SANDBOX.upper(), "crate"), (f"depot.{SANDBOX}", "depot.crate"),
        (f"DEPOT.{SANDBOX}", "depot.crate"), (f"other.{SANDBOX}", "other.crate"),
        (f"{SANDBOX}1", None), (f"x{SANDBOX}", None), (f"depotx{SANDBOX}", None), (f"{SANDBOX}_8", None),
    ],
)
def test_replay_in_any_surroundings(spark, before, after, name, wanted):
    text = f"{before}{name}{after} and {before}{name}{after}"
    kept = text.replace(name, wanted or name)
    df = spark.createDataFrame([(text, SANDBOX, "crate", "depot")], "q string, b string, p string, s string")
    assert df.select(replay_on(df.q, df.b, df.p, df.s)).first()[0] == kept


def test_replay_takes_names_literally(spark):
    rows = [("UPDATE d.sbx_a.b SET x", "sbx_a.b", r"we$1ird\name", "d"),
            ("UPDATE dXsbx_aXb SET x", "sbx_a.b", "t", "d"), (None, "sbx_a", "t", "d")]
    df = spark.createDataFrame(rows, "q string, b string, p string, s string")
    got = [r[0] for r in df.select(replay_on(df.q, df.b, df.p, df.s)).collect()]
    assert got == [r"UPDATE d.we$1ird\name SET x", "UPDATE dXsbx_aXb SET x", None]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("Weigh 20% more!", "weigh-20-more"), ("..crates..", "crates"), ("", ""), ("?&/", ""),
     ("Up  DOWN", "up-down")],
)
def test_slug(spark, text, wanted):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(slug(df.t)).first()[0] == wanted
    assert len(df.select(slug(F.repeat(df.t, 30), 10)).first()[0]) <= 10
