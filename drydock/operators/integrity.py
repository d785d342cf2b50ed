"""Integrity checks: unique keys, foreign keys, lost rows, NULLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drydock.operators.check import Check, KeyCheck, RowsFn, defined
from drydock.operators.sides import LONG_LISTING, listed_shares, named, side_counts

#: Copies of a row that are made from one array.
BLOCK = 65536


def uniqueness_on_keys(*keys: str, name: str = "uniqueness_on_keys") -> KeyCheck:
    """Sandbox key values that occur more than once; NULL keys form one group.

    The key follows the count in the sort: counts are mostly 2, and a range
    partitioning on them alone would put nearly all rows in one partition. Alone, the check
    reads the sandbox only; in a suite with other checks over these keys, their counts.
    """
    labels = ["duplicate_value"] if len(keys) == 1 else list(keys)

    def columns() -> list[Column]:
        return [named(k).alias(label) for k, label in zip(keys, labels)]

    def own_counts(_prod: DataFrame, sbx: DataFrame) -> DataFrame:
        groups = sbx.groupBy(*columns()).agg(F.count(F.lit(1)).alias("occurrences"))
        return groups.where(F.col("occurrences") > 1)

    def shared_counts(prod: DataFrame, sbx: DataFrame) -> DataFrame:
        # Both counts are read, as by the other checks: else the shuffle would not be the same.
        repeated = (F.col("sbx_n") > 1) & F.col("prod_n").isNotNull()
        counts = side_counts(prod, sbx, keys).where(repeated)
        return counts.select(*columns(), F.col("sbx_n").alias("occurrences"))

    def check(counts: RowsFn, shared: Check | None = None) -> KeyCheck:
        def listed(prod: DataFrame, sbx: DataFrame, limit: int | None) -> DataFrame:
            rows = counts(prod, sbx).orderBy(F.desc("occurrences"), *map(named, labels))
            return rows if limit is None else rows.limit(limit)

        def totals(prod: DataFrame, sbx: DataFrame) -> DataFrame:
            n = F.count(F.lit(1))
            return counts(prod, sbx).agg(n.alias("n_rows"), n.alias("n_failed"))

        return KeyCheck(
            name,
            description=f"({', '.join(keys)}) is unique",
            definition=defined("uniqueness_on_keys", keys=keys),
            keys=keys,
            listed=listed,
            totals=totals,
            shared=shared,
        )

    return check(own_counts, shared=check(shared_counts))


def foreign_key_integrity(
    fk: str, referenced: DataFrame, pk: str, name: str = "foreign_key_integrity"
) -> Check:
    """Foreign key values without a parent row, and how many rows hold them.

    Children are counted per key before the join, so a hot key is one row by then.
    If the parent keys are small enough to broadcast, the optimizer moves the anti
    join below the count and only orphans are shuffled. NULL counts as an orphan.
    """

    def compare(_prod: DataFrame, sbx: DataFrame) -> DataFrame:
        parents = referenced.select(named(pk).alias("_parent")).distinct()
        children = sbx.groupBy(named(fk).alias("orphaned_fk_value")).agg(
            F.count(F.lit(1)).alias("orphaned_count")
        )
        orphans = children.join(
            parents, F.col("orphaned_fk_value") == F.col("_parent"), "left_anti"
        )
        return orphans.orderBy(F.desc("orphaned_count"), "orphaned_fk_value")

    definition = defined("foreign_key_integrity", fk=fk, pk=pk)
    return Check(name, compare, f"every {fk} exists as {pk}", definition)


def referential_completeness(
    key: str, limit: int | None = 50, name: str = "referential_completeness"
) -> KeyCheck:
    """Keys of production rows that the sandbox no longer has, one per lost row."""

    def lost_keys(prod: DataFrame, sbx: DataFrame) -> DataFrame:
        return side_counts(prod, sbx, [key]).where((F.col("prod_n") > 0) & (F.col("sbx_n") == 0))

    def listed(prod: DataFrame, sbx: DataFrame, limit: int | None) -> DataFrame:
        first = F.col("missing_from_sandbox").asc_nulls_first()
        lost = lost_keys(prod, sbx).select(named(key).alias("missing_from_sandbox"), "prod_n")
        if limit is not None and limit > LONG_LISTING:
            shares = listed_shares(lost, "missing_from_sandbox", "prod_n", limit)
            return _repeated(shares.select("missing_from_sandbox", "_take"), "_take").orderBy(first)
        if limit is not None:
            lost = lost.orderBy(first).limit(limit)
            lost = lost.withColumn("prod_n", F.least("prod_n", F.lit(limit).cast("long")))
        rows = _repeated(lost, "prod_n").orderBy(first)
        return rows if limit is None else rows.limit(limit)

    def totals(prod: DataFrame, sbx: DataFrame) -> DataFrame:
        n = F.coalesce(F.sum("prod_n"), F.lit(0)).cast("long")
        return lost_keys(prod, sbx).agg(n.alias("n_rows"), n.alias("n_failed"))

    return KeyCheck(
        name,
        description=f"no {key} lost",
        definition=defined("referential_completeness", key=key, limit=limit),
        keys=(key,),
        limit=limit,
        listed=listed,
        totals=totals,
    )


def _repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as ``times`` says, in two steps, so that no array is long."""
    block = F.lit(BLOCK).cast("long")
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / block))
    size = F.least(F.col(times) - F.col("_block") * block, block)
    others = [named(c) for c in df.columns if c != times]
    return (
        df.select("*", F.explode(blocks).alias("_block"))
        .select(*others, F.explode(F.sequence(F.lit(1).cast("long"), size)).alias("_copy"))
        .drop("_copy")
    )


def null_check(column: str, name: str = "null_check") -> Check:
    """Sandbox rows where the column is NULL."""
    return Check(
        name,
        lambda _prod, sbx: sbx.where(named(column).isNull()),
        f"no NULL in {column}",
        defined("null_check", column=column),
    )


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, null_count`` for every column, in one pass over the table."""
    names = list(columns or df.columns)
    counts = df.agg(*[F.count_if(named(c).isNull()).alias(c) for c in names])
    pairs = [F.struct(F.lit(c).alias("column_name"), named(c).alias("null_count")) for c in names]
    return counts.select(F.inline(F.array(*pairs)))
