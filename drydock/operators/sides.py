"""Bringing two tables together without one task getting a hot key or a whole table.

``pair_row`` and ``side_counts`` reduce each side before anything is shuffled.
``distinct_keys`` is for the joins that do need whole rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def named(column: str) -> Column:
    """A top-level column by its literal name, whatever characters that holds."""
    return F.col(quoted(column))


def pair_row(
    prod: DataFrame, sbx: DataFrame, measures: Mapping[str, Column], known: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row with ``prod_<m>`` and ``sbx_<m>`` for every aggregate ``m``.

    Each side is one global aggregation (a single scan however many measures
    there are); the two one-row results are folded by a second tiny one. What is ``known`` of the sandbox's
    measures is not computed again; if all are, the sandbox is not read.
    """
    def measured(tag: str, side: DataFrame, known: Mapping[str, Column]) -> DataFrame:
        aggs = [agg.alias(f"{tag}_{name}") for name, agg in measures.items() if name not in known]
        row = side.agg(*aggs) if aggs else side.sparkSession.range(1).select()
        return row.select("*", *[known[name].alias(f"{tag}_{name}") for name in measures if name in known])

    one_row = [measured("prod", prod, {}), measured("sbx", sbx, known or {})]
    both = one_row[0].unionByName(one_row[1], allowMissingColumns=True)
    return both.agg(*[F.max(named(name)).alias(name) for name in both.columns])


def side_counts(prod: DataFrame, sbx: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, prod_n, sbx_n``: how often each key occurs on either side.

    One shuffle of pre-aggregated keys answers every "which keys are missing /
    new / shifted" question that would otherwise be an anti or full outer join.
    As under SQL ``=``, a key holding a NULL never matches: it is reported once
    per side.
    """
    def tagged(side: DataFrame, in_prod: int) -> DataFrame:
        return side.select(
            *map(named, keys), F.lit(in_prod).alias("_p"), F.lit(1 - in_prod).alias("_s")
        )

    rows = tagged(prod, 1).unionByName(tagged(sbx, 0))
    any_null = reduce(or_, [named(k).isNull() for k in keys])
    return (
        rows.groupBy(*map(named, keys), F.when(any_null, F.col("_p")).alias("_null_side"))
        .agg(F.sum("_p").alias("prod_n"), F.sum("_s").alias("sbx_n"))
        .drop("_null_side")
    )


#: Listings of more rows than this are put together from shares of keys, not cut from whole rows in one task.
LONG_LISTING = 10_000


def listed_shares(counts: DataFrame, key: str, n: str, limit: int) -> DataFrame:
    """The keys that a listing of ``limit`` rows reaches, and how many rows of each it takes, as ``_take``.

    ``n`` is how many rows a key has. Keys go in ascending order, NULL first. What meets in one task to be
    added up are a key and a number for each row listed at most, never a whole row.
    """
    first = named(key).asc_nulls_first()
    before = F.sum(n).over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1))
    reached = counts.orderBy(first).limit(limit).withColumn("_take", F.lit(limit) - F.coalesce(before, F.lit(0)))
    return reached.where(F.col("_take") > 0).withColumn("_take", F.least("_take", n))


def key_columns(keys: Sequence[str]) -> list[Column]:
    """The keys as ``_k_<key>``, and their hash ``_h``, for one side of a join.

    Adaptive execution splits a hot key of a join only if both inputs come straight
    from a shuffle made for that join. A side grouped by exactly its keys would be
    joined where it lies. Grouped by keys and hash it holds the same groups, but is
    shuffled again for a join on the keys, so the other side's hot keys can be split.
    The hash depends on the keys' types and must not be joined on.
    """
    return [
        *[named(k).alias(f"_k_{k}") for k in keys], F.hash(*map(named, keys)).alias("_h")
    ]


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct keys of one side of a join."""
    return df.select(key_columns(keys)).distinct()


def on_key(
    left: Sequence[str], right: Sequence[str] | None = None, alias: str | None = None
) -> list[Column]:
    """Join conditions of columns (of a table alias) with the key columns of the other side."""
    def mine(column: str) -> Column:
        name = "`" + column.replace("`", "``") + "`"
        return F.col(f"{alias}.{name}" if alias else name)

    return [mine(column) == named(f"_k_{key}") for column, key in zip(left, right or left)]
