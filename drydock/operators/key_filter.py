"""Telling apart, before a join of whole rows, those whose key the other side surely lacks.

The keys of the small side become a blocked Bloom filter: a key's hash names one of ``WORDS``
64-bit words and three bits in it, and an aggregation ors the bits of a word. Whatever the number of keys, the
filter has at most ``WORDS`` rows, so it is broadcast: 2 MB of data at the default. With a key for every eight
bits about one row in thirty that matches nothing is taken for a match; more keys let more rows through and never lose one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drydock.operators.sides import named

#: Words of a filter, a power of two.
WORDS = 1 << 17
_SHIFTS = (40, 46, 52)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_SAME_HASH = (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.BinaryType, T.DecimalType)


def _hashable(left: T.DataType, right: T.DataType) -> bool:
    """Whether keys of these types that are equal have equal hashes."""
    if isinstance(left, _INTEGRAL) and isinstance(right, _INTEGRAL):
        return True
    if isinstance(left, T.StringType) and isinstance(right, T.StringType):
        return left.simpleString() == right.simpleString() == "string"
    return isinstance(left, _SAME_HASH) and left == right


def _hashed(df: DataFrame, keys: Sequence[str]) -> Column:
    """The keys' hash, NULL if one is NULL: such a key matches nothing."""
    whole = [
        named(k).cast("long") if isinstance(df.schema[k].dataType, _INTEGRAL) else named(k) for k in keys
    ]
    return F.when(reduce(and_, [k.isNotNull() for k in whole]), F.xxhash64(*whole))


def _word(hashed: Column, words: int) -> Column:
    return hashed.bitwiseAND(F.lit(words - 1))


def _bits(hashed: Column) -> Column:
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftright(hashed, n).bitwiseAND(F.lit(63)).cast("int")) for n in _SHIFTS]
    return reduce(Column.bitwiseOR, bits)


def _free(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column has."""
    while name.lower() in [c.lower() for c in df.columns]:
        name = "_" + name
    return name


def split_by_keys(
    df: DataFrame, keys: Sequence[str], other: DataFrame, other_keys: Sequence[str], words: int = WORDS
) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among the other side's, and those whose key surely is not.

    Both read the table, and neither shuffles it. Keys of types whose equal values need not have
    equal hashes (fractions, text beside numbers, collated text) are not told apart: all their rows may match.
    """
    pairs = zip(keys, other_keys, strict=True)
    if not all(_hashable(df.schema[a].dataType, other.schema[b].dataType) for a, b in pairs):
        return df, df.where(F.lit(False))
    members = other.select(_hashed(other, other_keys).alias("_hash")).where(F.col("_hash").isNotNull())
    word, bits = _free(df, "_word"), _free(df, "_bits")
    held = members.groupBy(_word(F.col("_hash"), words).alias(word)).agg(F.bit_or(_bits(F.col("_hash"))).alias(bits))
    mine = _hashed(df, keys)
    flagged = df.join(F.broadcast(held), _word(mine, words) == F.col(word), "left")
    all_held = F.col(bits).bitwiseAND(_bits(mine)) == _bits(mine)
    maybe, columns = F.coalesce(all_held, F.lit(False)), [named(c) for c in df.columns]
    return flagged.where(maybe).select(columns), flagged.where(~maybe).select(columns)
