"""Measures of a sandbox that are taken while it is written.

A version's scalar checks need whole-table aggregates. Observed in the very pass that writes the
version, they cost no scan of their own; kept with the version, they hold as long as it does, since a
version never changes.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date, datetime

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drydock.operators.check import Check, ScalarCheck

#: Per measure its type and its value as text; NULL stays NULL.
Profile = Mapping[str, tuple[str, str | None]]
PROFILE_TYPE = "map<string, struct<type: string, value: string>>"
# Types whose values come back from their text exactly, whatever the session's time zone.
KEPT = (T.IntegralType, T.FractionalType, T.StringType, T.BooleanType, T.DateType, T.TimestampNTZType)


class Profiled:
    """A DataFrame whose next pass also takes the measures of the scalar checks among ``checks``.

    Measures that the DataFrame cannot give (say, of a column it does not have) are left out.
    """

    def __init__(self, df: DataFrame, checks: Iterable[Check]) -> None:
        self.types: dict[str, T.DataType] = {}
        measures = {}
        for check in checks:
            if isinstance(check, ScalarCheck):
                for name, measure in check.measures().items():
                    kind = self._kind(df, measure)
                    if isinstance(kind, KEPT):
                        self.types[name], measures[name] = kind, measure
        self.observation = Observation()
        rows = F.count(F.lit(1)).alias("n_rows")
        numbered = [m.alias(f"m{i}") for i, m in enumerate(measures.values())]
        self.df = df.observe(self.observation, rows, *numbered)

    @staticmethod
    def _kind(df: DataFrame, measure: Column) -> T.DataType | None:
        try:
            df.observe("probe", measure.alias("m"))
            return df.agg(measure.alias("m")).schema["m"].dataType
        except PySparkException:
            return None

    @property
    def n_rows(self) -> int:
        return self.observation.get["n_rows"]

    @property
    def profile(self) -> dict[str, tuple[str, str | None]]:
        """What was measured; waits for the pass."""
        found = self.observation.get
        return {
            name: (kind.simpleString(), _text(found[f"m{i}"])) for i, (name, kind) in enumerate(self.types.items())
        }


def _text(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, (date, bool)):
        return str(value)
    return repr(value) if isinstance(value, float) else str(value)


def known_measures(profile: Profile) -> dict[str, Column]:
    """A profile as literal columns."""
    return {name: F.lit(value).cast(kind) for name, (kind, value) in profile.items()}
