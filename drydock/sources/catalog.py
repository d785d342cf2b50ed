"""Production tables: listing, description, counts, and create-only writes."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drydock.operators.guard import (
    AUDIT_TABLE,
    DEFAULT_SCHEMA,
    SANDBOX_PREFIX,
    ProductionWriteBlocked,
    TableName,
)
from drydock.workspace import workspace_root

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*:)/+"
#: Marks tables that a loader may drop and make again.
RECREATED = "drydock.recreated"

# SQL names of Spark types in listings.
SQL_TYPES = {
    "tinyint": "TINYINT",
    "smallint": "SMALLINT",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "float": "FLOAT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp": "TIMESTAMP WITH TIME ZONE",
    "timestamp_ntz": "TIMESTAMP",
    "binary": "BLOB",
}


def sql_type(data_type: T.DataType) -> str:
    if isinstance(data_type, T.ArrayType):
        return f"{sql_type(data_type.elementType)}[]"
    name = data_type.simpleString()
    return SQL_TYPES.get(name, name.upper())


def production_names(
    names, prefix: str = SANDBOX_PREFIX, audit: str = AUDIT_TABLE
) -> list[str]:
    """Sorted table names without sandboxes and the audit table (case is ignored)."""
    return sorted(n for n in names if n and not TableName.quoted(n).may_be_written(prefix, audit))


def column_list(tables: Mapping[str, DataFrame]) -> list[tuple[str, str, str, bool, int]]:
    """``table, column, type, nullable, position`` of all columns; reads schemas only."""
    return [
        (table, f.name, sql_type(f.dataType), f.nullable, position)
        for table, df in sorted(tables.items())
        for position, f in enumerate(df.schema, start=1)
    ]


def columns(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The columns of all tables as rows: the input of the data dictionary."""
    return spark.createDataFrame(
        column_list(tables),
        "table_name string, column_name string, data_type string, nullable boolean, position int",
    )


# Options of a Parquet read that leave its set of files as it is.
HARMLESS = {"path", "paths", "basepath", "mergeschema", "serialization.format"}


def _parquet_roots(df: DataFrame) -> dict[str, str]:
    """The paths of a DataFrame that is a Parquet table and nothing else, by URI; none for any other."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() == "SubqueryAlias":
        plan = plan.child()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return {}
    relation = plan.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.fileFormat().toString() != "Parquet":
        return {}
    files, options = relation.location(), set(relation.options().keys().mkString("\n").lower().split())
    if files.getClass().getSimpleName() != "InMemoryFileIndex" or options - HARMLESS:
        return {}
    roots = [files.rootPaths().apply(i) for i in range(files.rootPaths().size())]
    return {_flat(root.toUri().toString()): root.toString() for root in roots}


def _flat(uri: str) -> str:
    """A URI with one slash after its scheme, however many it was given with."""
    return re.sub(SCHEME, r"\1/", uri)


def _footer_counts(spark: SparkSession, roots: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """``table_name, row_count`` of Parquet tables given by name and paths, from one scan of all their files.

    No column is read, so counts come from the footers, in tasks over all files together. A file's rows count
    for every table whose path is the file or lies above it.
    """
    paths = {uri: path for own in roots.values() for uri, path in own.items()}
    outer = [path for uri, path in sorted(paths.items()) if not paths.keys() & set(_ancestors(uri))]
    files = spark.read.schema("_none int").option("recursiveFileLookup", True).parquet(*outer)
    file = F.regexp_replace("_metadata.file_path", SCHEME, "$1/").alias("file")
    counted = files.groupBy(file).agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    placed = counted.select(F.explode(above).alias("root"), "n").groupBy("root").agg(F.sum("n").alias("n"))
    named = [(name, uri) for name, own in roots.items() for uri in own]
    names = spark.createDataFrame(named, "table_name string, root string")
    return names.join(placed, "root", "left").groupBy("table_name").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count")
    )


def _ancestors(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[:n]) for n in range(1, len(parts))]


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, row_count`` of many tables in one job.

    All plain Parquet tables are one scan together, which reads footers only; a DataFrame of any other kind is
    counted by a plan of its own.
    """
    roots = {name: _parquet_roots(df) for name, df in tables.items()}
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in sorted(tables.items()) if not roots[name]
    ]
    if any(roots.values()):
        counts.append(_footer_counts(next(iter(tables.values())).sparkSession, roots))
    return reduce(DataFrame.unionByName, counts)


def list_tables(
    tables: Mapping[str, DataFrame], prefix: str = SANDBOX_PREFIX, audit: str = AUDIT_TABLE
) -> DataFrame:
    """``table_name, row_count, columns`` of the production tables, by name."""
    shown = {name: tables[name] for name in production_names(tables, prefix, audit)}
    texts = {name: [] for name in shown}
    for table, column, data_type, _, _ in column_list(shown):
        texts[table].append(f"{column} ({data_type})")
    text = F.create_map(
        *[F.lit(part) for name in shown for part in (name, ", ".join(texts[name]))]
    )
    return row_counts(shown).withColumn("columns", text[F.col("table_name")]).orderBy("table_name")


def describe_table(name: str, df: DataFrame) -> DataFrame:
    """``column_name, data_type, nullable, position, row_count`` of one table."""
    described = columns(df.sparkSession, {name: df}).drop("table_name")
    return described.withColumn("row_count", row_count(df).scalar())


def row_count(df: DataFrame) -> DataFrame:
    """One row; for parquet answered from file footers."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


class Catalog:
    """The tables of one database of the Spark session."""

    def __init__(self, spark: SparkSession, schema: str = DEFAULT_SCHEMA, root: str | None = None):
        self.spark = spark
        self.schema = str(TableName.plain(schema, "schema"))
        self.root = root

    def _full(self, table: str) -> str:
        return f"{self.schema}.{TableName.plain(table, 'table')}"

    def ensure_schema(self) -> None:
        root = (self.root or workspace_root(self.spark)).rstrip("/")
        self.spark.sql(
            f"CREATE DATABASE IF NOT EXISTS {self.schema} LOCATION '{root}/{self.schema}.db'"
        )

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self._full(table))

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self._full(table))

    def tables(self) -> dict[str, DataFrame]:
        """All base tables of the database, sandboxes included."""
        found = self.spark.catalog.listTables(self.schema)
        return {
            t.name: self.table(t.name) for t in found if not t.isTemporary and t.tableType != "VIEW"
        }

    def create(self, table: str, df: DataFrame) -> DataFrame:
        """Create a table; an existing one is an error, never overwritten."""
        self.ensure_schema()
        df.write.mode("errorifexists").format("parquet").saveAsTable(self._full(table))
        return self.table(table)

    def recreate(self, table: str, df: DataFrame) -> DataFrame:
        """Drop and create, for loaders that may run many times.

        Only tables that were made by this method, which marks them, are ever dropped.
        """
        self.ensure_schema()
        full = self._full(table)
        if self.exists(table):
            marks = self.spark.sql(f"SHOW TBLPROPERTIES {full} ('{RECREATED}')").first()
            if marks["value"] != "true":
                raise ProductionWriteBlocked(f"{full} was not made by a loader; it is kept")
            self.spark.sql(f"DROP TABLE {full}")
        self.create(table, df)
        self.spark.sql(f"ALTER TABLE {full} SET TBLPROPERTIES ('{RECREATED}' = 'true')")
        return self.table(table)
