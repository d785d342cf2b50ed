"""CSV and TSV ingest into a new production table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drydock.sources.catalog import Catalog
from drydock.workspace import existing_path

# Candidate separators, and the raw text each type accepts. A number
# with a leading zero is an identifier and stays text.
SEPARATORS = (",", "\t", "|", ";")
TEXT_FORMS = {
    "boolean": r"(?i)^(true|false)$",
    "bigint": r"^[+-]?(0|[1-9][0-9]*)$",
    "decimal(38,0)": r"^[+-]?(0|[1-9][0-9]*)$",
    "double": r"^[+-]?((0|[1-9][0-9]*)\.[0-9]*|\.[0-9]+|(0|[1-9][0-9]*)(\.[0-9]*)?[eE][+-]?[0-9]+)$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "timestamp_ntz": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?$",
}
# Which types a value can have, by its first character, and by the one that follows a year.
NUMBERS = ("bigint", "decimal(38,0)", "double")
TIMES = ("date", "timestamp_ntz")
AFTER_YEAR = "-"
CORRUPT = "_malformed_line"
UNSAFE = frozenset("'\";<>\n\r")


def _reader(spark: SparkSession, sep: str, multiline: bool):
    return (
        spark.read.option("header", True).option("sep", sep).option("escape", '"')
        .option("multiLine", multiline)
    )


def _header(spark: SparkSession, path: str) -> str:
    lines = spark.read.text(path).head(1)
    if not lines:
        raise ValueError(f"{path} holds no header line")
    return lines[0][0]


def _kind(column: Column) -> Column:
    """A bit for the narrowest type that can read the value; NULL for no value.

    Up to 18 digits without a leading zero need neither pattern nor cast. For the rest, one or two characters say
    which kinds are possible at all, and only those are tried: pattern first, then cast.
    """
    kinds = list(TEXT_FORMS)
    text = F.lit(1 << len(kinds))

    def narrowest(names: tuple[str, ...]) -> Column:
        found = F
        for name in names:
            fits = column.rlike(TEXT_FORMS[name]) & column.try_cast(name).isNotNull()
            found = found.when(fits, F.lit(1 << kinds.index(name)))
        return found.otherwise(text)

    first, length = F.substring(column, 1, 1), F.length(column)
    plain = length.between(1, 18) & (F.translate(column, "0123456789", "") == "") & ((first != "0") | (length == 1))
    return (
        F.when(column.isNull(), F.lit(None))
        .when(plain, F.lit(1 << kinds.index("bigint")))
        .when(first.isin(*"tTfF"), narrowest(("boolean",)))
        .when(first.between("0", "9") & (F.substring(column, 5, 1) == AFTER_YEAR), narrowest(TIMES))
        .when(first.between("0", "9") | first.isin(*"+-."), narrowest(NUMBERS))
        .otherwise(text)
    )


def _common_type(kinds: int | None) -> str:
    """The type that reads every value, given the bits of all their kinds."""
    for widest, *narrower in (["boolean"], ["bigint"], ["decimal(38,0)", "bigint"],
                              ["double", "bigint"], ["date"], ["timestamp_ntz", "date"]):
        allowed = sum(1 << i for i, t in enumerate(TEXT_FORMS) if t in [widest, *narrower])
        if kinds and not kinds & ~allowed:
            return widest
    return "string"


def infer_schema(spark: SparkSession, path: str, sep: str, multiline: bool) -> T.StructType | None:
    """Column types from all values, in one pass; None if lines have the wrong shape.

    The first of boolean, bigint, decimal, double, date, timestamp that reads every value
    without loss is taken, else (or if there are no values) string. Whole numbers beyond bigint
    are decimals, and text if there are broken numbers beside them.
    """
    names = _reader(spark, sep, multiline).csv(path).columns
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    raw = (
        _reader(spark, sep, multiline)
        .option("columnNameOfCorruptRecord", CORRUPT).schema(text).csv(path)
    )
    facts = [F.count(CORRUPT).alias("malformed")]
    facts += [F.bit_or(_kind(F.col(f"`{n}`"))).alias(f"kinds_{i}") for i, n in enumerate(names)]
    found = raw.agg(*facts).first()
    if found["malformed"]:
        return None
    return T.StructType([
        T.StructField(name, T.DataType.fromDDL(_common_type(found[f"kinds_{i}"])))
        for i, name in enumerate(names)
    ])


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    sep: str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """A headed CSV / TSV file or folder as a DataFrame.

    Give a schema for large inputs: without one the data is read once more to infer
    it. ``multiline`` (line breaks inside quotes) makes every file one task, so it must be
    asked for. Malformed input is an error.
    """
    if schema is None or sep is None:
        header = _header(spark, path)
        sep = sep or max(SEPARATORS, key=header.count)
    if schema is None:
        schema = infer_schema(spark, path, sep, multiline)
        if schema is None:
            raise ValueError(
                f"{path} has lines that do not fit its header; with line breaks inside quotes, ask for multiline"
            )
    return (
        _reader(spark, sep, multiline).option("mode", "FAILFAST").schema(schema).csv(path)
    )


def ingest_csv(
    catalog: Catalog,
    table: str,
    source: str,
    schema: T.StructType | str | None = None,
    sep: str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Load a delimited file into a new table; an existing table is refused.

    The source is an absolute path or a URI of any file system that Spark reads. Whether it is one, and what
    is there, the file system says; names may hold blanks.
    """
    if UNSAFE & set(source):
        raise ValueError("source must be an absolute path or URI without quotes, ';', '<' or '>'")
    path = existing_path(catalog.spark, source.strip())
    if catalog.exists(table):
        raise ValueError(f"table {table!r} already exists")
    return catalog.create(table, read_delimited(catalog.spark, path, schema, sep, multiline))
