"""Read-only SQL and bounded previews over given tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from drydock.operators.check import Check
from drydock.operators.sides import quoted


def query(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Run one SELECT over the named tables.

    The text is placed in a subquery, where Spark's grammar admits queries only: a
    statement that writes is refused when it is parsed. The tables are known under their names inside this
    query alone: views of the session that have the same names stay as they are.
    """
    views = {f"_q_{uuid.uuid4().hex}": (name, df) for name, df in tables.items()}
    bound = ", ".join(f"{quoted(name)} AS (SELECT * FROM {view})" for view, (name, _) in views.items())
    text = (f"WITH {bound} " if bound else "") + f"SELECT * FROM (\n{sql.strip().rstrip(';')}\n)"
    try:
        for view, (_, df) in views.items():
            df.createOrReplaceTempView(view)
        return spark.sql(text)  # the plan holds the tables; their names are not needed any more
    finally:
        for view in views:
            spark.catalog.dropTempView(view)


def sql_check(
    name: str, sql: str, prod_name: str, sbx_name: str, description: str = "", **others: DataFrame
) -> Check:
    """A bespoke check in SQL over the production, sandbox and further tables."""

    def compare(prod: DataFrame, sbx: DataFrame) -> DataFrame:
        return query(prod.sparkSession, sql, {prod_name: prod, sbx_name: sbx, **others})

    return Check(name, compare, description, sql)


@dataclass(frozen=True)
class Preview:
    rows: list[Row]
    truncated: bool


def previewed(df: DataFrame, n: int = 50) -> DataFrame:
    """What a preview fetches: one row more than it shows; the limit is part of the plan."""
    return df.limit(n + 1)


def preview(df: DataFrame, n: int = 50) -> Preview:
    """The first ``n`` rows, and whether there are more."""
    rows = previewed(df, n).collect()
    return Preview(rows[:n], len(rows) > n)
