"""What a quality check is.

A check compares a production table with a sandbox and returns rows in one of two
styles: rows carrying a ``status`` of PASS / FAIL, or violation rows (none = PASS).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drydock.operators.sides import pair_row

RowsFn = Callable[[DataFrame, DataFrame], DataFrame]
ListFn = Callable[[DataFrame, DataFrame, "int | None"], DataFrame]
ColumnsFn = Callable[[], Mapping[str, Column]]


@dataclass(frozen=True)
class Check:
    """A named comparison of production with sandbox.

    ``definition`` is what a ledger keeps of it: the check with its parameters, or its SQL.
    """

    name: str
    compare: RowsFn
    description: str = ""
    definition: str = ""

    def __post_init__(self):
        object.__setattr__(self, "name", self.name or "unnamed_check")

    @property
    def expected(self) -> str:
        return self.description or self.name

    def rows(self, prod: DataFrame, sbx: DataFrame) -> DataFrame:
        return self.compare(prod, sbx)


@dataclass(frozen=True)
class ScalarCheck(Check):
    """A check that needs only whole-table aggregates and returns one row.

    ``measures`` are computed once per side; ``outputs`` turns the resulting
    ``prod_<m>`` / ``sbx_<m>`` columns into the check's columns. Several scalar
    checks over one pair of tables can therefore share a single pass. Both are
    functions, so that a check can be defined before there is a Spark session.
    """

    compare: RowsFn | None = None
    measures: ColumnsFn = dict
    outputs: ColumnsFn = dict

    def rows(self, prod: DataFrame, sbx: DataFrame) -> DataFrame:
        return pair_row(prod, sbx, self.measures()).select(
            *[value.alias(name) for name, value in self.outputs().items()]
        )


@dataclass(frozen=True)
class KeyCheck(Check):
    """A check that follows from how often each key stands on either side.

    ``listed`` gives its rows in a total order, the first ``limit`` or (None) all; ``totals`` one
    row ``n_rows, n_failed`` over all of them, so that a verdict never counts a cut listing.
    Several such checks over the same ``keys`` read one shuffle. A check that could do with
    less than that when it runs alone has a ``shared`` form for suites.
    """

    compare: RowsFn | None = None
    keys: tuple[str, ...] = ()
    limit: int | None = None
    listed: ListFn | None = None
    totals: RowsFn | None = None
    shared: Check | None = None

    def rows(self, prod: DataFrame, sbx: DataFrame) -> DataFrame:
        return self.listed(prod, sbx, self.limit)


def defined(check: str, **parameters: object) -> str:
    """A check and its parameters as text, for the ledger."""
    return f"{check}({', '.join(f'{name}={value!r}' for name, value in parameters.items())})"


def pass_if(condition: Column) -> Column:
    """PASS when the condition is true; FAIL when it is false or NULL."""
    return F.when(condition, F.lit("PASS")).otherwise(F.lit("FAIL"))
