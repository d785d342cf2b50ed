from __future__ import annotations

import string

import pytest
from pyspark.sql import functions as F

from drydock.operators.guard import ProductionWriteBlocked, TableName, guard_target, writable

WRITABLE = ["sbx_orders_1", "SBX_ORDERS", "analytics.sbx_a", '"sbx_a"', "`db`.`sbx_a`",
            "qg_quality_results", "QG_Quality_Results", "db.qg_quality_results"]
PROTECTED = ["orders", "analytics.orders", '"orders"', "my_sbx_orders", "sbx_db.orders",
             "qg_quality_results_2", "sbx"]


@pytest.mark.parametrize("name", WRITABLE)
def test_writable(name):
    assert guard_target(name) == name


@pytest.mark.parametrize("name", PROTECTED)
def test_protected(name):
    with pytest.raises(ProductionWriteBlocked, match="refused"):
        guard_target(name)


def test_column_form_agrees(spark):
    df = spark.createDataFrame([(n,) for n in WRITABLE + PROTECTED], "name string")
    found = {r["name"]: r["ok"] for r in df.select("name", writable(F.col("name")).alias("ok"))
             .collect()}
    assert found == {n: TableName.quoted(n).may_be_written() for n in WRITABLE + PROTECTED}


def test_other_prefix():
    assert TableName.quoted("tmp_a").may_be_written(prefix="TMP_", audit="log")
    assert TableName.quoted("LOG").may_be_written(prefix="TMP_", audit="log")
    assert not TableName.quoted("sbx_a").may_be_written(prefix="TMP_", audit="log")


def is_plain(name):
    try:
        return str(TableName.plain(name, "schema")) == name.strip()
    except ValueError as error:
        assert str(error).startswith("schema ")
        return False


def test_every_character_at_first_and_later_places():
    """The rule, for all of ASCII and some beyond, between other characters."""
    letters = string.ascii_letters + "_"
    for char in [chr(i) for i in range(256)] + ["\u0430", "\u4e2d", "\u2028"]:
        assert is_plain(f"{char}x") == (char in letters or char.isspace()), char
        assert is_plain(f"x{char}x") == (char in letters + string.digits + "."), char


def test_blanks_and_parts():
    assert TableName.plain("  a.b  ") == TableName(("a", "b"))
    assert TableName.plain("a.b").table == "b"
    for blank in ("", " ", "\t\n"):
        with pytest.raises(ValueError, match="must not be empty"):
            TableName.plain(blank)
