"""Screening a log of SQL text: what each statement does, to what, and whether it may.

This classifies rows of a query-history table with built-in column functions; only the
verdict on a whole batch, which its id names, brings statements together. It is best
effort, and anything it cannot read is not waved through; the barrier that actually
protects production is the typed guard in front of every sink.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drydock.operators.guard import AUDIT_TABLE, SANDBOX_PREFIX
from drydock.operators.sides import named

# String literals and comments, or (group 1) a quoted identifier, which is kept.
QUOTED = r"""'[^']*'|--[^\n]*|/\*[\s\S]*?\*/|("[^"]*"|`[^`]*`)"""
# What is left once closed identifiers are removed too must hold none of these.
IDENTIFIER = r""""[^"]*"|`[^`]*`"""
UNCLOSED = r"""['"`]|/\*"""
NAME = r"""(?:"[^"]+"|`[^`]+`|[A-Za-z0-9_]+)(?:\.(?:"[^"]+"|`[^`]+`|[A-Za-z0-9_]+))*"""
NAMES = rf"{NAME}(?: ?, ?{NAME})*"
WRITE = (
    r"(?i)^(INSERT(?: OR [A-Z]+)?(?: INTO| OVERWRITE)?(?: TABLE)?|UPDATE|DELETE FROM|MERGE INTO"
    r"|DROP (?:TABLE|VIEW|SCHEMA|DATABASE)(?: IF EXISTS)?|ALTER (?:TABLE|VIEW)(?: IF EXISTS)?"
    r"|TRUNCATE(?: TABLE)?|CREATE OR REPLACE(?: TEMP| TEMPORARY)?(?: TABLE| VIEW)"
    rf"|CREATE(?: TEMP| TEMPORARY)?(?: TABLE| VIEW)(?: IF NOT EXISTS)?) ({NAMES})"
)
VERB = r"(?i)^\(* ?(CREATE OR REPLACE|[A-Z]+)"
INTO = r"(?i)\bINTO\b"
WRITES = r"(?i)\b(INSERT|UPDATE|DELETE|MERGE|INTO)\b"

# Verbs that must name a sandbox or the audit table.
GUARDED = ["INSERT", "UPDATE", "DELETE", "MERGE", "DROP", "ALTER", "TRUNCATE", "CREATE OR REPLACE"]
FOUND = ("operation", "target", "verdict", "is_read", "is_ddl")
DDL = ["ALTER", "DROP", "CREATE", "CREATE OR REPLACE", "TRUNCATE"]


def _holds(text: Column, parts: Iterable[str]) -> Column:
    return reduce(or_, [text.contains(part) for part in parts])


def _where_any(text: Column, parts: Iterable[str], change: Callable[[Column], Column]) -> Column:
    """The changed text where it holds any of the parts; the text stands in an array, so it is made once."""
    once = F.transform(F.array(text), lambda t: F.when(_holds(t, parts), change(t)).otherwise(t))
    return once[0]


def split_statements(sql: Column) -> Column:
    """The statements of a batch, without comments, literals and repeated blanks.

    A pattern is only tried on texts that hold what it looks for.
    """
    bare = _where_any(sql, [*"'\"`", "--", "/*"], lambda text: F.regexp_replace(text, QUOTED, " $1 "))
    blank = _where_any(bare, ["  ", *"\n\t\r\x0b\x0c"], lambda text: F.regexp_replace(text, r"\s{2,}|[^\S ]", " "))
    tidy = _where_any(blank, [" .", ". "], lambda text: F.regexp_replace(text, r" \. ?|\. ", "."))
    return F.filter(F.transform(F.split(tidy, ";"), lambda s: F.trim(s)), lambda s: s != "")


def _statements(log: DataFrame, id_column: str, sql_column: str) -> DataFrame:
    """The statements of a log, one per row: batch id, ``_pos``, ``_text`` and ``_doubt``.

    A batch without statements keeps one row, whose ``_pos`` is NULL. Exploding first lets all
    that follows be plain column functions, which compile. A backslash before a quote ends the
    literal in one dialect and not in another, so such a batch is in doubt.
    """
    doubt = F.coalesce(named(sql_column).contains("\\'"), F.lit(False))
    return log.select(
        named(id_column),
        doubt.alias("_doubt"),
        F.posexplode_outer(split_statements(named(sql_column))).alias("_pos", "_text"),
    )


def _judged(
    log: DataFrame, id_column: str, sql_column: str, prefix: str = SANDBOX_PREFIX, audit: str = AUDIT_TABLE
) -> DataFrame:
    """One row per statement with what is found about it.

    blocked: a guarded verb outside sandboxes, or text that cannot be read.
    review: verbs the rules don't know, plain CREATE elsewhere, WITH around a write.
    """
    text, operation, target = F.col("_text"), F.col("operation"), F.col("target")
    written = F.when(operation.isin(*GUARDED, "CREATE"), F.regexp_extract(text, WRITE, 2)).otherwise("")
    names = F.col("_names")
    unclosed = F.regexp_replace(text, IDENTIFIER, "").rlike(UNCLOSED)
    read = (
        _statements(log, id_column, sql_column)
        .withColumn("operation", F.upper(F.regexp_extract(text, VERB, 1)))
        .withColumn("_names", F.trim(F.translate(written, "\"`", "")))
        .withColumn("target", F.lower(F.when(names.contains(","), F.regexp_replace(names, " ?, ?", ",")).otherwise(names)))
        .withColumn("_unclosed", F.when(_holds(text, [*"'\"`", "/*"]), unclosed).otherwise(False))
    )
    safe = target.rlike(_all_writable(prefix, audit))
    is_read = ((operation == "SELECT") & ~text.rlike(INTO)) | (
        (operation == "WITH") & ~text.rlike(WRITES)
    )
    verdict = (
        F.when(F.col("_unclosed"), "blocked")
        .when(operation.isin(GUARDED), F.when(safe, "allow").otherwise("blocked"))
        .when(is_read, "allow")
        .when((operation == "CREATE") & safe, "allow")
        .otherwise("review")
    )
    return (
        read.withColumn("verdict", verdict)
        .withColumn("is_read", is_read)
        .withColumn("is_ddl", operation.isin(DDL))
    )


def _all_writable(prefix: str, audit: str) -> str:
    """A pattern for lists of names that all are sandboxes or the audit table."""
    table = rf"(?:\Q{prefix.lower()}\E[^.,]*|\Q{audit.lower()}\E)"
    name = rf"(?:[^.,]+\.)*{table}"
    return rf"^{name}(?:,{name})*$"


def _batch_verdict(worst: Column, doubt: Column) -> Column:
    """A batch is as bad as its worst statement, and an empty batch is allowed; one in doubt
    is at best left for review.
    """
    rank = F.greatest(F.coalesce(worst, F.lit(0)), doubt.cast("int"))
    return F.when(rank == 2, "blocked").when(rank == 1, "review").otherwise("allow")


def _rank(verdict: Column) -> Column:
    return F.when(verdict == "blocked", 2).when(verdict == "review", 1).otherwise(0)


def screen_log(log: DataFrame, id_column: str, sql_column: str, **names: str) -> DataFrame:
    """One row per id: ``findings`` (one struct per statement) and the batch ``verdict``."""
    finding = F.struct((F.col("_pos") + 1).alias("statement_no"), *FOUND)
    found = F.when(F.col("_pos").isNotNull(), finding)
    rank = F.when(F.col("_pos").isNotNull(), _rank(F.col("verdict")))
    return (
        _judged(log, id_column, sql_column, **names)
        .groupBy(named(id_column))
        .agg(
            F.sort_array(F.collect_list(found)).alias("findings"),
            _batch_verdict(F.max(rank), F.max("_doubt")).alias("verdict"),
        )
    )


def screen_statements(log: DataFrame, id_column: str, sql_column: str, **names: str) -> DataFrame:
    """One row per statement: id, position, finding and the verdict of its batch."""
    worst = F.max(_rank(F.col("verdict"))).over(Window.partitionBy(named(id_column)))
    judged = _judged(log, id_column, sql_column, **names).where(F.col("_pos").isNotNull())
    return judged.select(
        named(id_column),
        (F.col("_pos") + 1).alias("statement_no"),
        *FOUND,
        _batch_verdict(worst, F.col("_doubt")).alias("batch_verdict"),
    )
