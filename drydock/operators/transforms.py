"""Table changes as DataFrame rewrites: the next version of a sandbox from its current one.

Nothing here runs a job or writes; the snapshot store commits the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drydock.operators.key_filter import split_by_keys
from drydock.operators.sides import distinct_keys, key_columns, named, on_key

Value = Column | int | float | str | bool | None


def _as_column(value: Value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _condition(condition: Column | str) -> Column:
    """A predicate, also as the text of an SQL expression."""
    return F.expr(condition) if isinstance(condition, str) else condition


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def update(df: DataFrame, set: Mapping[str, Value], where: Column | str | None = None) -> DataFrame:
    """Assign columns on the rows where the predicate is true.

    All right-hand sides see the old row, and columns keep their types.
    """
    _require(df, set)
    hit = F.lit(True) if where is None else _condition(where)

    def new_value(field: T.StructField) -> Column:
        old = named(field.name)
        if field.name not in set:
            return old
        new = _as_column(set[field.name]).cast(field.dataType)
        return F.when(hit, new).otherwise(old).alias(field.name)

    return df.select([new_value(f) for f in df.schema])


def round_money(value: Column, scale: int = 2) -> Column:
    """Round half up in decimal arithmetic, free of binary rounding noise."""
    return F.round(value, scale).cast("double")


def money(column: str | Column, scale: int = 2) -> Column:
    """A double column as an exact decimal."""
    col = F.col(column) if isinstance(column, str) else column
    return col.cast(f"decimal(18,{scale})")


def delete(df: DataFrame, where: Column | str) -> DataFrame:
    """Drop the rows where the predicate is true; NULL keeps the row."""
    return df.where(~_true(_condition(where)))


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows, cast to the table's types; columns they lack become NULL."""
    unknown = [c for c in rows.columns if c not in df.columns]
    if unknown:
        raise ValueError(f"columns not in the table: {unknown}")
    casts = [
        (F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None))
        .cast(f.dataType).alias(f.name)
        for f in df.schema
    ]
    return df.unionByName(rows.select(casts))


def merge(
    df: DataFrame,
    source: DataFrame,
    on: Sequence[str],
    update: Mapping[str, Value] | None = None,
    update_where: Column | None = None,
    delete_where: Column | None = None,
    insert: Mapping[str, Value] | bool = False,
    leave_out: Sequence[str] = (),
    sparse: bool = False,
) -> DataFrame:
    """MERGE the source into the table on equal, non-NULL keys.

    Expressions name target columns ``t.<column>`` and source columns
    ``s.<column>``. A matched row is deleted if ``delete_where`` holds, else updated
    if ``update_where`` (default: always) holds. ``insert=True`` adds unmatched source
    rows by column name; source columns that the table lacks must be named in ``leave_out``.
    A target row matching several source rows fails the query, whatever is read of it.

    The table is the streamed side of a left join: it is not shuffled when the source is
    small, and a hot key in the table can be split when it is not. Of the source only
    columns in use are read, once for the matches and once for what is inserted.

    ``sparse`` is for two large tables of which few rows match: a filter of the source's keys, a fixed
    2 MB, tells which rows of the table may match, and only these are joined. The others are neither
    shuffled nor sorted. The price is a second scan of both.
    """
    _require(df, update or {})
    keys = list(on)
    if insert is True:
        surplus = [c for c in source.columns if c not in df.columns and c not in leave_out]
        if surplus:
            raise ValueError(f"columns not in the table: {surplus}; name them in leave_out")
    elif insert:
        _require(df, insert)
    near, kept = df, df
    if sparse:
        near, far = split_by_keys(df, keys, source, keys)
    if update or delete_where is not None:
        kept = _merge_matched(near, source, keys, update or {}, update_where, delete_where)
        kept = kept.unionByName(far) if sparse else kept
    if insert is False:
        return kept

    fresh = source.join(distinct_keys(near, keys), on_key(keys), "left_anti").alias("s")
    values = insert
    if insert is True:
        values = {c: F.col(f"s.`{c}`") for c in source.columns if c not in leave_out}
    rows = fresh.select(
        [_as_column(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema]
    )
    return kept.unionByName(rows)


def _merge_matched(
    df: DataFrame,
    source: DataFrame,
    keys: list[str],
    update: Mapping[str, Value],
    update_where: Column | None,
    delete_where: Column | None,
) -> DataFrame:
    """The table's rows after the matched part of a merge.

    How often a key stands in the source is counted beside its rows, so only the columns that
    expressions use are carried. The check for several matches is part of the filter: it
    cannot be pruned with the columns.
    """
    keyed = source.select("*", *key_columns(keys))
    each = Window.partitionBy(*[named(f"_k_{k}") for k in keys], "_h")
    counted = keyed.withColumn("_copies", F.count(F.lit(1)).over(each)).alias("s")
    joined = df.alias("t").join(counted, on_key(keys, alias="t"), "left")
    matched = F.col("_copies").isNotNull()
    deleted = matched & _true(delete_where) if delete_where is not None else F.lit(False)
    updated = matched & _true(update_where) if update_where is not None else matched
    unique = F.when(
        F.col("_copies") > 1,
        F.raise_error("MERGE: a target row matches more than one source row").cast("boolean"),
    ).otherwise(~deleted)

    def new_value(field: T.StructField) -> Column:
        old = F.col(f"t.`{field.name}`")
        if field.name not in update:
            return old.alias(field.name)
        new = _as_column(update[field.name]).cast(field.dataType)
        return F.when(updated, new).otherwise(old).alias(field.name)

    return joined.where(unique).select([new_value(f) for f in df.schema])


def add_column(df: DataFrame, name: str, data_type: str, default: Value = None) -> DataFrame:
    """Append a column holding one default value; the name must be new."""
    if name.lower() in [c.lower() for c in df.columns]:
        raise ValueError(f"column {name!r} already exists")
    return df.withColumn(name, _as_column(default).cast(data_type))


def deduplicate(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Keep the first row per key in the given order.

    The rank-1 filter lets Spark trim every group to one row per task before the
    shuffle, so a key holding a large share of the table stays cheap.
    """
    ranked = df.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def latest_per_key(
    df: DataFrame, keys: Sequence[str], when: str, *ties: str | Column
) -> DataFrame:
    """The most recent row per key."""
    return deduplicate(df, keys, [F.col(when).desc_nulls_last(), *ties])


def update_from_join(
    df: DataFrame,
    lookup: DataFrame,
    on: Mapping[str, str],
    set: Mapping[str, Value],
    order: Sequence[str | Column] = (),
    sparse: bool = False,
) -> DataFrame:
    """Assign columns from the lookup row with an equal key; other rows stay as they are.

    ``on`` maps table columns to lookup columns. Expressions (``order`` included) name
    ``t.<column>`` and ``s.<column>``. If the lookup repeats a key, its first row in ``order`` is
    used, so rows never fan out. Without an order all columns of the lookup decide, which
    must then all be read; a repeated key is an error instead if ``order`` is None. ``sparse``
    is as for ``merge``: rows that cannot match stay out of the join.
    """
    _require(df, set)
    theirs = list(on.values())
    if sparse:
        near, far = split_by_keys(df, list(on), lookup, theirs)
        return update_from_join(near, lookup, on, set, order).unionByName(far)
    keyed = lookup.select("*", *key_columns(theirs)).alias("s")
    group = Window.partitionBy(*[named(f"_k_{c}") for c in theirs], "_h")
    if order is None:
        side = keyed.withColumn("_copies", F.count(F.lit(1)).over(group)).alias("s")
        unique = F.when(
            F.col("_copies") > 1,
            F.raise_error("UPDATE: a row matches more than one lookup row").cast("boolean"),
        ).otherwise(True)
    else:
        first = [F.col(f"s.`{c}`") if isinstance(c, str) else c for c in order or lookup.columns]
        side = keyed.withColumn("_rank", F.row_number().over(group.orderBy(*first)))
        side, unique = side.where(F.col("_rank") == 1).alias("s"), F.lit(True)
    joined = df.alias("t").join(side, on_key(list(on), theirs, alias="t"), "left").where(unique)
    found = F.col("s._h").isNotNull()

    def new_value(field: T.StructField) -> Column:
        old = F.col(f"t.`{field.name}`")
        if field.name not in set:
            return old.alias(field.name)
        new = _as_column(set[field.name]).cast(field.dataType)
        return F.when(found, new).otherwise(old).alias(field.name)

    return joined.select([new_value(f) for f in df.schema])


def flag_members(df: DataFrame, members: DataFrame, on: Mapping[str, str], flag: str) -> DataFrame:
    """Add a boolean column: whether the row's key occurs among ``members``."""
    side = distinct_keys(members, list(on.values()))
    joined = df.join(side, on_key(list(on), list(on.values())), "left")
    return joined.select(*map(named, df.columns), F.col("_h").isNotNull().alias(flag))


def _require(df: DataFrame, assignments: Mapping[str, object]) -> None:
    missing = [name for name in assignments if name not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")
