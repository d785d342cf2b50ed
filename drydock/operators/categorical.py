"""Categorical checks: new values and shifted shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drydock.operators.check import Check, defined, pass_if
from drydock.operators.sides import named, side_counts


def value_set_drift(column: str, name: str = "value_set_drift") -> Check:
    """Values of the column that production does not have. NULL always counts as new."""

    def compare(prod: DataFrame, sbx: DataFrame) -> DataFrame:
        counts = side_counts(prod, sbx, [column])
        return counts.where((F.col("sbx_n") > 0) & (F.col("prod_n") == 0)).select(
            named(column).alias("new_value"), F.lit("not present in production").alias("issue")
        ).orderBy("new_value")

    return Check(
        name, compare, f"no new values of {column}", defined("value_set_drift", column=column)
    )


def share_of_total(counts: DataFrame, *count_columns: str) -> list[Column]:
    """Each count as a percentage of its column's sum.

    The totals are one scalar subquery, not windows over all rows: those would bring
    every group into one task. The subquery reads the same columns as the counts, so
    the shuffle behind them is done once.
    """
    total = counts.agg(F.struct(*[F.sum(c).alias(c) for c in count_columns])).scalar()
    return [
        F.round(F.col(c) * F.lit(100.0) / F.nullif(total[c], F.lit(0)), 2) for c in count_columns
    ]


def distribution_shift(
    column: str, points: float = 5, name: str = "distribution_shift"
) -> Check:
    """Every value's share of its table moves by at most ``points`` percentage points.

    Shares are rounded to two places before they are compared. NULL appears once
    per side, because it does not match itself.
    """

    def compare(prod: DataFrame, sbx: DataFrame) -> DataFrame:
        counts = side_counts(prod, sbx, [column])
        prod_share, sbx_share = share_of_total(counts, "prod_n", "sbx_n")
        shares = counts.select(
            named(column).alias("category_value"),
            F.coalesce(prod_share, F.lit(0.0)).alias("prod_pct"),
            F.coalesce(sbx_share, F.lit(0.0)).alias("sbx_pct"),
        )
        shift = F.abs(F.col("sbx_pct") - F.col("prod_pct"))
        return shares.select(
            "*", F.round(shift, 2).alias("shift_pct"), pass_if(shift <= points).alias("status")
        ).orderBy(F.desc("shift_pct"), "category_value", "prod_pct")

    definition = defined("distribution_shift", column=column, points=points)
    return Check(name, compare, f"shares of {column} within {points} points of production", definition)
