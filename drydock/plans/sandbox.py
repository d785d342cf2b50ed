"""Sandbox snapshots: versioned parquet copies of a production table.

Spark's parquet tables can neither be updated nor overwritten while they are read,
so a change writes the next version and the ledger moves on to it. A version
becomes visible only when its write has finished.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drydock.functions.text import replay_on
from drydock.operators import transforms
from drydock.operators.guard import (
    AUDIT_TABLE,
    DEFAULT_SCHEMA,
    SANDBOX_PREFIX,
    TableName,
    guard_target,
)
from drydock.operators.check import Check
from drydock.operators.sides import named
from drydock.operators.transforms import deduplicate, latest_per_key
from drydock.plans.ledger import Ledger
from drydock.plans.profile import Profile, Profiled
from drydock.workspace import delete_path, workspace_root

class _Order:
    """The order of a sandbox's records, the one that counts first; made when it is used."""

    def __iter__(self):
        return iter([F.desc("dropped"), F.desc("version"), F.asc("recorded_at"), F.asc("path")])


NEWEST = _Order()


@dataclass(frozen=True)
class Sandbox:
    """The current version of a sandbox."""

    sandbox_name: str
    source_table: str
    created_at: datetime
    version: int
    path: str
    partition_by: list[str]
    n_rows: int
    columns: list[tuple[str, str]]
    profile: Profile = field(default_factory=dict)


class SandboxStore:
    """Creates, reads, changes and drops sandboxes under one workspace folder.

    The measures of the scalar checks in ``profile`` are taken in the pass that writes a version and kept with it,
    so that these checks need not read it.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str | None = None,
        schema: str = DEFAULT_SCHEMA,
        prefix: str = SANDBOX_PREFIX,
        audit: str = AUDIT_TABLE,
        profile: Sequence[Check] = (),
    ):
        self.spark = spark
        self.profile = profile
        self.root = (root or workspace_root(spark)).rstrip("/")
        self.schema = str(TableName.plain(schema, "schema"))
        self.prefix, self.audit = prefix, audit
        self.ledger = Ledger(spark, self.root)

    def create(
        self, source_table: str, prod: DataFrame, partition_by: Sequence[str] = ()
    ) -> Sandbox:
        """Copy a production table: all its rows, in one pass that also counts them.

        Name the table's partition columns to keep them as folders in every version,
        so that filters on them go on skipping files. A copy that cannot be recorded is removed.
        """
        new = self._write(prod, partition_by=list(partition_by), **self._first_version(source_table))
        try:
            return self._record(new)
        except BaseException:
            delete_path(self.spark, f"{self.root}/sandboxes/{new.sandbox_name}")
            raise

    def _first_version(self, source_table: str) -> dict:
        bare = TableName.plain(source_table, "source table").table
        now = datetime.now(timezone.utc)
        name = f"{self.prefix}{bare}_{now:%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:6]}"
        return dict(sandbox_name=name, source_table=bare, created_at=now, version=0)

    def get(self, sandbox_name: str) -> Sandbox:
        """The named sandbox's latest version, or an error if there is none.

        Of two records of one version the earlier counts (then the smaller path), so that
        everybody sees the same one.
        """
        name = str(TableName.plain(sandbox_name, "sandbox"))
        rows = self.ledger.read("sandboxes", name, once=False).orderBy(*NEWEST).head(1)
        if not rows or rows[0]["dropped"]:
            raise ValueError(f"no sandbox named {sandbox_name!r}; create it first")
        row = rows[0].asDict()
        row["profile"] = {name: tuple(measure) for name, measure in (row["profile"] or {}).items()}
        return Sandbox(**{f: row[f] for f in Sandbox.__dataclass_fields__})

    def latest_for(self, source_table: str) -> Sandbox | None:
        """The sandbox of a table that was created last."""
        rows = latest_per_key(
            self.current().where(F.col("source_table") == source_table),
            ["source_table"], "created_at", F.desc("sandbox_name"),
        ).head(1)
        return self.get(rows[0]["sandbox_name"]) if rows else None

    def current(self) -> DataFrame:
        """One ledger row per sandbox that has not been dropped."""
        newest = deduplicate(self.ledger.read("sandboxes", once=False), ["sandbox_name"], NEWEST)
        return newest.where(~F.col("dropped")).drop(
            "dropped", "recorded_at", "operation", "statement", "profile"
        )

    def transformations(self, sandbox_name: str | None = None) -> DataFrame:
        """The changes applied to one or all sandboxes, also as production statements."""
        versions = self.ledger.read("sandboxes", sandbox_name, once=False)
        changes = deduplicate(
            versions.where(~F.col("dropped") & (F.col("version") > 0)), ["sandbox_name", "version"], NEWEST
        )
        prod_statement = replay_on(
            F.col("statement"), F.col("sandbox_name"), F.col("source_table"), F.lit(self.schema)
        )
        return changes.select(
            "sandbox_name", F.col("version").alias("seq"), "operation", "statement",
            prod_statement.alias("prod_statement"), F.col("recorded_at").alias("applied_at"),
        )

    def _resolve(self, sandbox: Sandbox | str) -> Sandbox:
        return sandbox if isinstance(sandbox, Sandbox) else self.get(sandbox)

    def read(self, sandbox: Sandbox | str) -> DataFrame:
        """The rows of a sandbox: of its current version by name, or of the given version."""
        version = self._resolve(sandbox)
        schema = ", ".join(f"`{name}` {data_type}" for name, data_type in version.columns)
        rows = self.spark.read.schema(schema).parquet(version.path)
        return rows.select([named(name) for name, _ in version.columns])

    def commit(
        self,
        sandbox: Sandbox | str,
        df: DataFrame,
        operation: str = "REPLACE",
        statement: str | None = None,
    ) -> Sandbox:
        """Write the next version of a sandbox and record the change that led to it.

        Chain any number of rewrites lazily and commit once: each commit costs a
        full write, and cuts the plan's lineage. A commit on top of a version that is
        no longer the current one is refused, before it writes if that is known by then; what a
        refused commit has written is removed. Every attempt has its own folder, so that one that
        was cut short can be repeated.
        """
        old = self._resolve(sandbox)
        guard_target(old.sandbox_name, self.prefix, self.audit)
        self._require_current(old)
        new = self._write(
            df,
            sandbox_name=old.sandbox_name,
            source_table=old.source_table,
            created_at=old.created_at,
            version=old.version + 1,
            partition_by=old.partition_by,
        )
        try:
            self._require_current(old)
            self._record(new, operation=operation, statement=statement)
            if self.get(old.sandbox_name).path != new.path:
                raise ValueError(f"{old.sandbox_name} has moved on from version {old.version}")
        except BaseException:
            delete_path(self.spark, new.path)
            raise
        return new

    def _require_current(self, sandbox: Sandbox) -> None:
        if self.get(sandbox.sandbox_name).path != sandbox.path:
            raise ValueError(f"{sandbox.sandbox_name} has moved on from version {sandbox.version}")

    def transform(
        self, sandbox: Sandbox | str, change: Callable[[DataFrame], DataFrame], operation: str
    ) -> Sandbox:
        """Apply any rewrite and commit the result; it is logged without a statement."""
        return self._changed(sandbox, change, operation)

    def _changed(
        self,
        sandbox: Sandbox | str,
        change: Callable[[DataFrame], DataFrame],
        operation: str,
        statement: str | None = None,
    ) -> Sandbox:
        old = self._resolve(sandbox)
        guard_target(old.sandbox_name, self.prefix, self.audit)
        return self.commit(old, change(self.read(old)), operation, statement)

    # Changes given as SQL expressions: the log's statement is written from the same arguments.

    def update(
        self, sandbox: Sandbox | str, set: Mapping[str, str], where: str | None = None
    ) -> Sandbox:
        """Assign columns, each by an SQL expression, on the rows where ``where`` is true."""
        old = self._resolve(sandbox)
        values = {name: F.expr(value) for name, value in set.items()}
        assigned = ", ".join(f"{name} = {value}" for name, value in set.items())
        statement = f"UPDATE {self._full(old)} SET {assigned}" + (f" WHERE {where}" if where else "")
        return self._changed(old, lambda df: transforms.update(df, values, where), "UPDATE", statement)

    def delete(self, sandbox: Sandbox | str, where: str) -> Sandbox:
        """Drop the rows where ``where`` is true."""
        old = self._resolve(sandbox)
        statement = f"DELETE FROM {self._full(old)} WHERE {where}"
        return self._changed(old, lambda df: transforms.delete(df, where), "DELETE", statement)

    def add_column(
        self, sandbox: Sandbox | str, name: str, data_type: str, default: str = "NULL"
    ) -> Sandbox:
        """Append a column holding one default value, an SQL expression."""
        old = self._resolve(sandbox)
        statement = f"ALTER TABLE {self._full(old)} ADD COLUMN {name} {data_type} DEFAULT {default}"
        return self._changed(
            old, lambda df: transforms.add_column(df, name, data_type, F.expr(default)), "ALTER", statement
        )

    def _full(self, sandbox: Sandbox) -> str:
        return f"{self.schema}.{sandbox.sandbox_name}"

    def truncate(self, sandbox: Sandbox | str) -> Sandbox:
        """An empty next version with the same columns."""
        old = self._resolve(sandbox)
        return self._changed(old, lambda df: df.limit(0), "TRUNCATE", f"TRUNCATE TABLE {self._full(old)}")

    def drop(self, sandbox: Sandbox | str) -> None:
        """Retire a sandbox in the ledger, then remove the files it owns."""
        old = self._resolve(sandbox)
        guard_target(old.sandbox_name, self.prefix, self.audit)
        self._record(old, dropped=True)
        delete_path(self.spark, f"{self.root}/sandboxes/{old.sandbox_name}")

    def vacuum(self, sandbox: Sandbox | str, keep: int = 1) -> int:
        """Remove the files of all versions but the last ``keep``; their record stays.

        Returns how many were removed. Nobody may still be reading them.
        """
        old = self._resolve(sandbox)
        guard_target(old.sandbox_name, self.prefix, self.audit)
        if keep < 1:
            raise ValueError("the current version must be kept")
        folder = f"{self.root}/sandboxes/{old.sandbox_name}"
        stale = range(0, old.version + 1 - keep)
        return sum(delete_path(self.spark, f"{folder}/v={version}") for version in stale)

    def _write(
        self,
        df: DataFrame,
        sandbox_name: str,
        source_table: str,
        created_at: datetime,
        version: int,
        partition_by: list[str],
    ) -> Sandbox:
        guard_target(sandbox_name, self.prefix, self.audit)
        path = f"{self.root}/sandboxes/{sandbox_name}/v={version}/{uuid.uuid4().hex}"
        try:
            written = self._written(df, path, partition_by, self.profile)
        except Exception:
            if not self.profile:
                raise
            delete_path(self.spark, path)  # a measure may be what failed, and must not keep a version from being
            written = self._written(df, path, partition_by, ())
        return Sandbox(
            sandbox_name=sandbox_name, source_table=source_table, created_at=created_at,
            version=version, path=path, partition_by=partition_by,
            n_rows=written.n_rows, columns=_columns(df), profile=written.profile,
        )

    @staticmethod
    def _written(df: DataFrame, path: str, partition_by: list[str], checks: Sequence[Check]) -> Profiled:
        profiled = Profiled(df, checks)
        profiled.df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
        return profiled

    def _record(
        self,
        sandbox: Sandbox,
        dropped: bool = False,
        operation: str | None = None,
        statement: str | None = None,
    ) -> Sandbox:
        entry = dict(
            sandbox.__dict__, dropped=dropped, operation=operation, statement=statement,
            recorded_at=datetime.now(timezone.utc),
        )
        self.ledger.append("sandboxes", [entry])
        return sandbox


def _columns(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema]
