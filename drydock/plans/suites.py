"""Suites of checks that are saved for a sandbox and run later by its name.

A saved check is data: the kind of check and its arguments, or a SELECT. Tables are saved by name
and looked up when the suite runs, so it can run in another session than the one that saved it.
"""

from __future__ import annotations

import inspect
import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drydock.operators import categorical, integrity, numeric, volume
from drydock.operators.check import Check
from drydock.operators.guard import guard_target
from drydock.plans.ledger import Ledger
from drydock.plans.query import sql_check
from drydock.plans.runner import run_checks
from drydock.plans.sandbox import Sandbox, SandboxStore
from drydock.sources.catalog import Catalog

KINDS = {
    f.__name__: f
    for f in (
        volume.row_count_comparison, volume.row_count_match, volume.new_rows_inspection,
        numeric.mean_drift, numeric.sum_comparison, numeric.min_max_bounds,
        categorical.value_set_drift, categorical.distribution_shift,
        integrity.uniqueness_on_keys, integrity.foreign_key_integrity, integrity.referential_completeness,
        integrity.null_check,
    )
}
SQL = "sql"
# Arguments that name a table, and the one that takes any number of values.
TABLE_ARGUMENTS = ("referenced",)
KEYS = "keys"


@dataclass(frozen=True)
class CheckSpec:
    """A check as data.

    ``kind`` names a check of the library and ``arguments`` are its own, with tables given by name. Or it is
    'sql', with ``sql`` (over the source table and the sandbox by their names) and ``tables``, the names of others.
    """

    kind: str
    arguments: Mapping[str, object] = field(default_factory=dict)
    name: str = ""
    description: str = ""

    @classmethod
    def of_sql(cls, name: str, sql: str, description: str = "", tables: Sequence[str] = ()) -> CheckSpec:
        return cls(SQL, {"sql": sql, "tables": list(tables)}, name, description)

    def validate(self) -> CheckSpec:
        """Refuse what could never be built or kept: the error shows when a suite is saved, not when it runs."""
        json.dumps(self.arguments)
        if self.kind == SQL:
            if set(self.arguments) - {"sql", "tables"} or not isinstance(self.arguments.get("sql"), str):
                raise ValueError(f"check {self.name!r} needs 'sql', and may have 'tables'")
        elif self.kind not in KINDS:
            raise ValueError(f"there is no check {self.kind!r}; known are {SQL}, {', '.join(sorted(KINDS))}")
        else:
            named = {k: v for k, v in self.arguments.items() if k != KEYS}
            try:
                inspect.signature(KINDS[self.kind]).bind(*self.arguments.get(KEYS, ()), **named)
            except TypeError as error:
                raise ValueError(f"check {self.kind!r}: {error}") from error
        return self

    def tables(self) -> set[str]:
        """The names of the further tables that the check reads."""
        if self.kind == SQL:
            return set(self.arguments.get("tables", ()))
        return {str(v) for k, v in self.arguments.items() if k in TABLE_ARGUMENTS}

    def build(self, sandbox: Sandbox, tables: Mapping[str, DataFrame]) -> Check:
        if self.kind == SQL:
            others = {name: tables[name] for name in self.arguments.get("tables", ())}
            return sql_check(
                self.name, self.arguments["sql"], sandbox.source_table, sandbox.sandbox_name, self.description, **others
            )
        arguments = {k: tables[v] if k in TABLE_ARGUMENTS else v for k, v in self.arguments.items()}
        return KINDS[self.kind](*arguments.pop(KEYS, ()), **arguments, **({"name": self.name} if self.name else {}))


class SavedSuites:
    """The suites saved for the sandboxes of a store. The one saved last for a sandbox counts."""

    def __init__(self, store: SandboxStore, catalog: Catalog | None = None):
        self.store = store
        self.catalog = catalog or Catalog(store.spark, store.schema)

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    @property
    def ledger(self) -> Ledger:
        return self.store.ledger

    def save(self, sandbox_name: str, specs: Sequence[CheckSpec]) -> str:
        """Keep a suite in place of the one before; returns its id."""
        sandbox = self.store.get(guard_target(sandbox_name, self.store.prefix, self.store.audit))
        if not specs:
            raise ValueError("no quality checks defined")
        suite_id = uuid.uuid4().hex
        saved = dict(sandbox_name=sandbox.sandbox_name, suite_id=suite_id, saved_at=datetime.now(timezone.utc))
        self.ledger.append("check_suites", [
            dict(saved, position=position, kind=spec.validate().kind, arguments=json.dumps(spec.arguments),
                 name=spec.name, description=spec.description)
            for position, spec in enumerate(specs)
        ])
        return suite_id

    def load(self, sandbox_name: str) -> list[CheckSpec]:
        """The suite saved last, in its order; none is an error."""
        name = self.store.get(sandbox_name).sandbox_name
        saved = self.ledger.read("check_suites", name)
        last = saved.agg(F.max(F.struct("saved_at", "suite_id")).alias("last")).select("last.suite_id").scalar()
        rows = saved.where(F.col("suite_id") == last).orderBy("position").collect()
        if not rows:
            raise ValueError(f"no quality checks saved for {name!r}; save some first")
        return [CheckSpec(r["kind"], json.loads(r["arguments"]), r["name"], r["description"]) for r in rows]

    def run(
        self,
        sandbox_name: str,
        tables: Mapping[str, DataFrame] | None = None,
        run_id: str | None = None,
    ) -> DataFrame:
        """Run a sandbox's saved suite against production, record the results and return them.

        Production and further tables are those of ``tables``, or of the catalog. Measures that were
        taken when the version was written are not taken again.
        """
        specs = self.load(sandbox_name)
        sandbox = self.store.get(sandbox_name)
        found = dict(tables or {})
        for name in {sandbox.source_table, *(t for spec in specs for t in spec.tables())} - set(found):
            found[name] = self.catalog.table(name)
        return run_checks(
            found[sandbox.source_table], self.store.read(sandbox), [s.build(sandbox, found) for s in specs],
            sandbox.sandbox_name, sandbox.source_table, self.ledger, run_id, sandbox.version, sandbox.profile,
        )
