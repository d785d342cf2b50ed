"""Numeric checks: mean, sum and bounds of one column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from drydock.operators.check import ScalarCheck, defined, pass_if
from drydock.operators.sides import named


def exact_sum(column: str, scale: int | None) -> Column:
    """Sum of a column as a double.

    A sum of doubles depends on the order of addition, so it can differ between
    two runs over the same data. With ``scale`` the addends are rounded half up to that
    many places and added as decimals, which is exact and repeatable. What a
    decimal cannot hold (NaN, the infinities, magnitudes of ``10 ** (28 - scale)`` and more) is
    added as a double, so it shows in the result; so is all, should the decimal sum overflow.
    """
    value = named(column).cast("double")
    if scale is None:
        return F.sum(value)
    held = F.abs(value) < 10.0 ** (28 - scale)
    exact = F.try_sum(F.when(held, named(column).cast(f"decimal(28,{scale})"))).cast("double")
    whole = F.coalesce(exact, F.sum(F.when(held, value)))
    rest = F.sum(F.when(~held, value))
    return F.when(rest.isNull(), whole).otherwise(F.coalesce(whole, F.lit(0.0)) + rest)


def _drift(measure: str, pct: float, kind: str, abs_denominator: bool):
    prod, sbx = named(f"prod_{measure}"), named(f"sbx_{measure}")
    base = F.abs(prod) if abs_denominator else prod
    drift = F.abs(sbx - prod) / F.nullif(base, F.lit(0.0)) * 100
    return {
        f"prod_{kind}": prod,
        f"sbx_{kind}": sbx,
        "drift_pct": F.round(drift, 2),
        "status": pass_if(drift <= pct),
    }


def sum_comparison(
    column: str,
    pct: float = 10,
    scale: int | None = None,
    abs_denominator: bool = False,
    name: str = "sum_comparison",
) -> ScalarCheck:
    """The column's sum drifts by at most ``pct`` percent.

    The drift is divided by the signed production sum, so a negative baseline
    always passes; ``abs_denominator=True`` divides by its magnitude instead.
    """
    measure = f"sum_{column}_{scale}"
    return ScalarCheck(
        name,
        description=f"sum of {column} within {pct}% of production",
        definition=defined("sum_comparison", column=column, pct=pct, scale=scale, abs_denominator=abs_denominator),
        measures=lambda: {measure: exact_sum(column, scale)},
        outputs=lambda: _drift(measure, pct, "sum", abs_denominator),
    )


def mean_drift(
    column: str,
    pct: float = 10,
    scale: int | None = None,
    abs_denominator: bool = False,
    name: str = "mean_drift",
) -> ScalarCheck:
    """The column's mean drifts by at most ``pct`` percent (signed base, as for sums)."""
    measure = f"avg_{column}_{scale}"

    def measures():
        rows = F.nullif(F.count(named(column)), F.lit(0))
        return {measure: exact_sum(column, scale) / rows}

    return ScalarCheck(
        name,
        description=f"mean of {column} within {pct}% of production",
        definition=defined("mean_drift", column=column, pct=pct, scale=scale, abs_denominator=abs_denominator),
        measures=measures,
        outputs=lambda: _drift(measure, pct, "avg", abs_denominator),
    )


def min_max_bounds(
    column: str, headroom: float = 1.1, name: str = "min_max_bounds"
) -> ScalarCheck:
    """Minimum not below production's, maximum at most ``headroom`` times production's."""

    def outputs():
        prod_min, sbx_min = named(f"prod_min_{column}"), named(f"sbx_min_{column}")
        prod_max, sbx_max = named(f"prod_max_{column}"), named(f"sbx_max_{column}")
        return {
            "prod_min": prod_min,
            "prod_max": prod_max,
            "sbx_min": sbx_min,
            "sbx_max": sbx_max,
            "status": pass_if((sbx_min >= prod_min) & (sbx_max <= prod_max * F.lit(headroom))),
        }

    return ScalarCheck(
        name,
        description=f"{column} stays within production's range (maximum x {headroom})",
        definition=defined("min_max_bounds", column=column, headroom=headroom),
        measures=lambda: {
            f"min_{column}": F.min(named(column)), f"max_{column}": F.max(named(column))
        },
        outputs=outputs,
    )
