"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keys_of(rows: DataFrame, *columns: str) -> DataFrame:
    """Distinct non-null keys. Duplicates collapse before the shuffle, so a hot key
    costs one row per map task."""
    keys = rows.select(*columns)
    for column in columns:
        keys = keys.filter(F.col(column).isNotNull())
    return keys.distinct()


def spread_keys_of(rows: DataFrame, column: str) -> DataFrame:
    """Distinct non-null keys, for a join whose other side may hold a hot key.

    Adaptive execution splits a skewed join only where both inputs come straight from a
    shuffle by the join key, not where one is the result of a grouping by it. Grouping by
    the key and its hash gives the same keys under another partitioning, so the join
    shuffles them (one column) itself and can be split.
    """
    present = rows.select(column, F.hash(column).alias("_hash"))
    return present.filter(F.col(column).isNotNull()).distinct().drop("_hash")


def matching(rows: DataFrame, column: str, wanted) -> DataFrame:
    """Rows whose column equals a value, is in a list, or is among the keys of a
    one-column DataFrame."""
    if isinstance(wanted, DataFrame):
        keys = wanted.toDF(column)
        return rows.join(spread_keys_of(keys, column), column, "left_semi")
    if isinstance(wanted, (list, tuple, set, frozenset)):
        return rows.filter(F.col(column).isin(list(wanted)))
    return rows.filter(F.col(column) == wanted)


def presence(left: DataFrame, key: str, *rights: DataFrame) -> DataFrame:
    """The distinct non-null keys of the left side with `_in`, a number whose bit k tells whether
    the k-th right side has the key (from 1; bit 0 is the left side).

    One scan of each key column and one grouping, combined before its shuffle. As all is in one
    column, what is asked of several sides reads the same shuffle. See `lacking`.
    """
    sides = [rows.select(key, F.lit(1 << k).alias("_in")) for k, rows in enumerate((left, *rights))]
    tagged = reduce(DataFrame.unionByName, sides).filter(F.col(key).isNotNull())
    return tagged.groupBy(key).agg(F.bit_or("_in").alias("_in")).filter(F.col("_in") % 2 == 1)


def lacking(present: DataFrame, side: int) -> DataFrame:
    """The keys of a `presence` that a right side does not have."""
    return present.filter(F.col("_in").bitwiseAND(F.lit(1 << side)) == 0).drop("_in")


def padded_join(left: DataFrame, right: DataFrame, key: str, absent: DataFrame) -> DataFrame:
    """A left outer join as an inner one: the right side gets an all-null row for each key in
    `absent`, the left keys that it does not have. Keys that the left side lacks do no harm."""
    return left.join(right.unionByName(absent.select(key), allowMissingColumns=True), key)


def left_join_hot_right(
    left: DataFrame, right: DataFrame, key: str, left_keys: DataFrame | None = None
) -> DataFrame:
    """Left outer join where the right side may hold a hot key.

    Adaptive execution cannot split the right side of a left outer join, but it can split
    either side of an inner one. So the right side gets an all-null row for each left key
    it lacks, found on the key column alone, and an inner join does the rest. The left
    key must not be null. `left_keys` is a cheaper source of all left keys, if there is
    one; keys in it that the left side lacks do no harm. Several such joins by one key share
    one `presence`.
    """
    present = presence(left if left_keys is None else left_keys, key, right)
    return padded_join(left, right, key, lacking(present, 1))
