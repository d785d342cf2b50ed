"""Data dictionary: column descriptions guessed from column names, and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wording and name patterns, in the order in which they are tried.
# "{}" stands for the part of the name that the rule extracts.
RULES = (
    ("is", ("id",), "Unique identifier for this record."),
    ("ends", ("_id",), "Reference to the associated {}."),
    ("is_or_ends", ("status",), "Current status of the record."),
    (
        "has",
        ("amount", "price", "cost", "revenue", "total", "value"),
        "Monetary value in the record's currency.",
    ),
    (
        "is",
        ("created_at", "created_on", "creation_date"),
        "Timestamp when the record was created.",
    ),
    (
        "is",
        ("updated_at", "modified_at", "last_updated"),
        "Timestamp of the most recent update to this record.",
    ),
    (
        "is",
        ("deleted_at", "deleted_on"),
        "Soft-delete timestamp; NULL when the record is active.",
    ),
    ("ends", ("_at", "_date", "_time"), "Timestamp recording when {} occurred."),
    ("has", ("type", "kind", "category"), "Categorical classification of the record."),
    ("flag", ("is_", "has_", "flag"), "Boolean flag."),
    ("has", ("pct", "percent", "rate", "ratio"), "Ratio or percentage value."),
    ("count", ("count", "qty", "quantity"), "Numeric count."),
    (
        "has",
        ("name", "title", "label", "description", "desc"),
        "Human-readable label or name.",
    ),
    ("has", ("email", "phone", "address"), "Contact field: {}."),
    (
        "is",
        ("country", "region", "city", "state", "zip", "postal_code"),
        "Geographic field: {}.",
    ),
)
UNKNOWN = "_What does `{}` represent? What values can it have?_"


def _matches(kind: str, words: tuple[str, ...], name: Column) -> Column:
    if kind == "is":
        return name.isin(*words)
    if kind == "ends":
        return name.rlike(f"({'|'.join(words)})$")
    if kind == "is_or_ends":
        return name.rlike(f"(^|_)({'|'.join(words)})$")
    if kind == "flag":
        return name.rlike("^(is_|has_)|flag")
    if kind == "count":
        return name.isin(*words) | name.rlike("_count$|^count_")
    return name.rlike("|".join(words))


def _extract(words: tuple[str, ...], name: Column) -> Column:
    """The words of the name that a description quotes."""
    if words == ("_id",):
        return F.regexp_replace(F.regexp_replace(name, "_id$", ""), "_", " ")
    if "_at" in words:
        event = name
        for word in words:
            event = F.replace(event, F.lit(word), F.lit(""))
        return F.trim(F.regexp_replace(event, "_", " "))
    return F.regexp_replace(name, "_", " ")


def _fill(template: str, value: Column) -> Column:
    before, _, after = template.partition("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def description_for(column_name: Column) -> Column:
    """A description from the first rule the column's name satisfies."""
    name = F.lower(column_name)
    text = None
    for kind, words, template in RULES:
        value = _fill(template, _extract(words, name)) if "{}" in template else F.lit(template)
        condition = _matches(kind, words, name)
        text = F.when(condition, value) if text is None else text.when(condition, value)
    return text.otherwise(_fill(UNKNOWN, column_name))


def describe_columns(columns: DataFrame) -> DataFrame:
    """``table_name, column_name, data_type, description`` for a catalog's columns."""
    return columns.select(
        "table_name", "column_name", "data_type",
        description_for(F.col("column_name")).alias("description"),
    )


def undocumented(columns: DataFrame, documented: DataFrame) -> DataFrame:
    """Generated rows for columns the dictionary lacks; names compare without case."""
    known = documented.select(
        F.col("table_name").alias("_table"), F.lower("column_name").alias("_column")
    ).distinct()
    new = columns.join(
        known,
        (F.col("table_name") == F.col("_table")) & (F.lower("column_name") == F.col("_column")),
        "left_anti",
    )
    return describe_columns(new)


def update_dictionary(columns: DataFrame, documented: DataFrame) -> DataFrame:
    """The documented rows, untouched, followed by rows for new columns.

    Columns the table no longer has stay documented.
    """
    return documented.select(
        "table_name", "column_name", "data_type", "description"
    ).unionByName(undocumented(columns, documented))
