"""Volume checks: how many rows, and which are new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drydock.operators.check import KeyCheck, ScalarCheck, defined, pass_if
from drydock.operators.sides import LONG_LISTING, listed_shares, named, side_counts


def row_count_comparison(
    pct: float = 10, name: str = "row_count_comparison", description: str = ""
) -> ScalarCheck:
    """Row counts differ by at most ``pct`` percent of production."""

    def outputs():
        prod, sbx = F.col("prod_rows"), F.col("sbx_rows")
        diff = sbx - prod
        change = diff * F.lit(100.0) / F.nullif(prod, F.lit(0))
        return {
            "prod_row_count": prod,
            "sbx_row_count": sbx,
            "row_diff": diff,
            "pct_change": F.round(change, 2),
            "status": pass_if(F.abs(change) <= pct),
        }

    return ScalarCheck(
        name,
        description=description or f"row count within {pct}% of production",
        definition=defined("row_count_comparison", pct=pct),
        measures=lambda: {"rows": F.count(F.lit(1))},
        outputs=outputs,
    )


def row_count_match(name: str = "row_count_match") -> ScalarCheck:
    """Row counts are equal."""
    return row_count_comparison(0, name, "row counts match")


def new_rows_inspection(
    key: str, limit: int | None = 50, name: str = "new_rows_inspection"
) -> KeyCheck:
    """Sandbox rows whose key is not in production; informational, always PASS.

    New keys come from pre-aggregated counts; only for those that can be listed are whole rows
    looked up, in a second scan. Rows are in the order of the key (NULL, which is always new,
    first) and then of all other columns. A long listing takes its share of each key, so that its rows are
    sorted in many tasks and none is handed all of them.
    """

    def new_keys(prod: DataFrame, sbx: DataFrame) -> DataFrame:
        return side_counts(prod, sbx, [key]).where((F.col("prod_n") == 0) & (F.col("sbx_n") > 0))

    def listed(prod: DataFrame, sbx: DataFrame, limit: int | None) -> DataFrame:
        first = named(key).asc_nulls_first()
        wanted = new_keys(prod, sbx).select(named(key).alias("_new_key"), "sbx_n")
        ties = [named(f.name) for f in sbx.schema if f.name != key and _orderable(f.dataType)]
        if limit is not None and limit > LONG_LISTING:
            return long_list(sbx, wanted, limit, ties).orderBy(first, *ties).withColumn("status", F.lit("PASS"))
        if limit is not None:
            wanted = wanted.orderBy(F.col("_new_key").asc_nulls_first()).limit(limit)
        rows = sbx.join(wanted, named(key).eqNullSafe(F.col("_new_key")), "left_semi")
        rows = rows.orderBy(first, *ties)
        return (rows if limit is None else rows.limit(limit)).withColumn("status", F.lit("PASS"))

    def long_list(sbx: DataFrame, wanted: DataFrame, limit: int, ties: list[Column]) -> DataFrame:
        """Rows of all keys that are listed in whole, and of the one that is cut its first."""
        shares = listed_shares(wanted, "_new_key", "sbx_n", limit)
        own = [named(c) for c in sbx.columns]
        found = sbx.join(shares, named(key).eqNullSafe(F.col("_new_key")))
        place = F.row_number().over(Window.partitionBy("_new_key").orderBy(*ties or [F.lit(0)]))
        cut = found.where(F.col("_take") < F.col("sbx_n")).withColumn("_place", place)
        cut = cut.where((F.col("_place") <= limit) & (F.col("_place") <= F.col("_take")))
        return found.where(F.col("_take") == F.col("sbx_n")).select(own).unionByName(cut.select(own))

    def totals(prod: DataFrame, sbx: DataFrame) -> DataFrame:
        n = F.coalesce(F.sum("sbx_n"), F.lit(0)).cast("long")
        return new_keys(prod, sbx).agg(n.alias("n_rows")).withColumn("n_failed", F.lit(0).cast("long"))

    return KeyCheck(
        name,
        description="rows added by the change, for review",
        definition=defined("new_rows_inspection", key=key, limit=limit),
        keys=(key,),
        limit=limit,
        listed=listed,
        totals=totals,
    )


def _orderable(data_type: T.DataType) -> bool:
    return not isinstance(data_type, (T.MapType, T.VariantType))
