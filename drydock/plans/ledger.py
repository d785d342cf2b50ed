"""Append-only ledgers: sandbox versions (with the changes that made them), saved suites, check results.

A ledger is a parquet folder; the current state is always derived from its rows. Any number of
sessions may append at once: every append is written apart and then moved in as a folder of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drydock.operators.transforms import latest_per_key
from drydock.plans.profile import PROFILE_TYPE
from drydock.workspace import child_names, delete_path, move_folder, workspace_root

SCHEMAS = {
    "sandboxes": (
        "sandbox_name string, source_table string, created_at timestamp, version int, path string,"
        " partition_by array<string>, n_rows bigint, dropped boolean,"
        " recorded_at timestamp,"
        " columns array<struct<column_name: string, data_type: string>>,"
        f" operation string, statement string, profile {PROFILE_TYPE}"
    ),
    "check_suites": (
        "sandbox_name string, suite_id string, saved_at timestamp, position int, kind string,"
        " arguments string, name string, description string"
    ),
    "quality_results": (
        "run_id string, sandbox_name string, sandbox_version int, source_table string,"
        " `check` string, definition string, status string, result string, expected string,"
        " detail string, run_at timestamp, run_date date"
    ),
}
# The folders in which a reader finds the few rows it wants without listing the rest.
PARTITIONS = {
    "sandboxes": ["sandbox_name"],
    "check_suites": ["sandbox_name"],
    "quality_results": ["run_date"],
}


#: Tells the rows of a ledger apart, so that one that stands in two files counts once.
ENTRY = "entry"
FOLDED = "folded-"


class Ledger:
    """The ledger tables under one workspace folder.

    Below a table there is a folder per partition, and in it one per append. ``fold`` brings the
    many small files of a partition together.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or workspace_root(spark)).rstrip("/") + "/ledger"

    def append(self, table: str, rows: Iterable[Mapping] | DataFrame) -> None:
        """Add rows; a handful of records becomes one small file.

        Two writers never share a folder, so neither waits for the other or removes its files. The rows of
        a partition become visible at once.
        """
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame(list(rows), SCHEMAS[table]).coalesce(1)
        self._publish(table, rows.withColumn(ENTRY, F.uuid()), uuid.uuid4().hex)

    def _publish(self, table: str, rows: DataFrame, name: str) -> None:
        """Write rows apart and move them in, as a folder ``name`` in each of their partitions."""
        staged = f"{self.root}/_staged/{uuid.uuid4().hex}"
        try:
            rows.write.partitionBy(*PARTITIONS[table]).parquet(staged)
            for partition in child_names(self.spark, staged):
                move_folder(self.spark, f"{staged}/{partition}", f"{self.root}/{table}/{partition}/{name}")
        finally:
            delete_path(self.spark, staged)

    def read(self, table: str, folder: str | None = None, once: bool = True) -> DataFrame:
        """All rows ever appended, or those of one partition; none if there are none yet.

        Who looks for the newest row only can spare the shuffle that makes folded rows come ``once``.
        """
        entries = self._entries(table, folder)
        return (entries.dropDuplicates([ENTRY]) if once else entries).drop(ENTRY)

    def _entries(self, table: str, folder: str | None = None) -> DataFrame:
        schema, base = f"{SCHEMAS[table]}, {ENTRY} string", f"{self.root}/{table}"
        path = f"{base}/{PARTITIONS[table][0]}={folder}" if folder else base
        try:
            return self.spark.read.schema(schema).option("basePath", base).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def fold(self, table: str, folder: str, at_least: int = 2, keep_sources: bool = True) -> int:
        """Fold a partition's small files into one; returns how many folders it now has.

        The folded rows are moved in as one more folder, and as an entry counts once, readers never see
        rows twice. Those who listed the files before may still be reading them, so what was
        folded goes with the next fold (or at once, without ``keep_sources``). Only folders of which
        every entry stands in a folded one are ever removed.
        """
        place = f"{self.root}/{table}/{PARTITIONS[table][0]}={folder}"
        self._remove_folded(table, folder, place)
        names = child_names(self.spark, place)
        if len(names) >= at_least:
            rows = self._entries(table, folder).dropDuplicates([ENTRY]).coalesce(1)
            self._publish(table, rows, FOLDED + uuid.uuid4().hex)
            if not keep_sources:
                self._remove_folded(table, folder, place, names)
        return len(child_names(self.spark, place))

    def _remove_folded(self, table: str, folder: str, place: str, names: list[str] | None = None) -> None:
        """Remove the folders (of ``names``, if given) of which a folded folder holds every entry."""
        found = child_names(self.spark, place)
        folds = [name for name in found if name.startswith(FOLDED)]
        if not folds:
            return
        parent = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        entries = self._entries(table, folder).select(ENTRY, parent.alias("parent")).distinct()
        # An entry is needed in the largest folded folder that has it.
        size = F.count(F.lit(1)).over(Window.partitionBy("parent"))
        rank = F.struct(F.col("parent").startswith(FOLDED).alias("folded"), size.alias("size"), F.col("parent"))
        ranked = entries.select(ENTRY, rank.alias("rank"))
        best = ranked.groupBy(ENTRY).agg(F.max("rank").alias("rank")).select(F.col("rank.parent").alias("best"))
        needed = [row[0] for row in best.select("best").distinct().collect()]
        for name in set(found if names is None else names) - set(needed):
            delete_path(self.spark, f"{place}/{name}")


def run_summary(results: DataFrame) -> DataFrame:
    """Checks, failures and the overall flag of every run."""
    failed = F.count_if(F.col("status") != "PASS")
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("checks"),
        failed.alias("failed"),
        (failed == 0).alias("all_passed"),
    )


def latest_run_status(results: DataFrame) -> DataFrame:
    """Whether the latest run of each sandbox passed.

    Results are reduced to runs before the latest is chosen, so the number of
    checks per run does not matter.
    """
    failed = F.count_if(F.col("status") != "PASS")
    runs = results.groupBy("sandbox_name", "run_id").agg(
        F.max("run_at").alias("run_at"), (failed == 0).alias("quality_passed")
    )
    return latest_per_key(runs, ["sandbox_name"], "run_at", F.desc("run_id"))
