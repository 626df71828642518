"""Serial keys for a batch of new rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permitlake.session import shared_dir

# monotonically_increasing_id puts the partition number above this many bits of row number.
ROW_BITS = 33


def highest_id(rows: DataFrame, key: str) -> int:
    """The largest key, or 0 without rows. Runs a job that returns one row."""
    return rows.agg(F.max(key)).first()[0] or 0


def assign_ids(
    rows: DataFrame,
    key: str,
    order_by: list[str | Column],
    start_after: int = 0,
    keep: list[str] | None = None,
) -> DataFrame:
    """Number the rows start_after+1, start_after+2, ... in the given order, without gaps.

    Two passes. The first reads the order columns alone: it gives each of their values the
    number of its first row and keeps these in a checkpoint (see `_first_numbers`). The second
    joins the numbers back to the rows, so the rows themselves are shuffled once and stored
    nowhere. An executor lost later cannot change a number: those are in the checkpoint, which
    Spark removes when no result refers to it any more (with
    spark.cleaner.referenceTracking.cleanCheckpoints).

    `order_by` should be unique; its columns need not be among those that are kept. Rows that
    tie on it are numbered in the order of all their columns: only then are the rows sorted
    within their key. `rows` is computed twice and must have the same order columns both times;
    a row whose number is not there raises an error.
    """
    others = [c for c in rows.columns if c != key] if keep is None else list(keep)
    order = {f"_order_{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order_by)}
    keyed = rows.select(*(F.col(c).alias(f"_kept_{i}") for i, c in enumerate(others)),
                        *(c.alias(name) for name, c in order.items()))
    numbers, tied = _first_numbers(keyed.select(*order), list(order))
    same = reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in order])
    found = keyed.alias("l").join(numbers.alias("r"), same, "left")
    first = F.coalesce("r._first", F.raise_error("the rows changed while they were numbered").cast("long"))
    number = F.lit(start_after).cast("long") + first
    if tied:
        by = [F.col(f"l.{c}") for c in order]
        content = [F.col(f"l._kept_{i}") for i in range(len(others))]
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*content))
        number = number + place - 1
    return found.select(
        number.alias(key), *(F.col(f"l._kept_{i}").alias(c) for i, c in enumerate(others))
    )


def _first_numbers(keys: DataFrame, names: list[str]) -> tuple[DataFrame, bool]:
    """Each value of the key columns once, with `_first`, the number of its first row from 1,
    and whether any value has several rows.

    Sorting puts equal values next to each other into one range; the checkpoint holds the
    place of every value in its range, and how many rows it has. Only the row counts of the
    ranges, one number per partition, are added up outside.
    """
    shared_dir(keys.sparkSession)
    placed = keys.orderBy(*names).select(*names, F.monotonically_increasing_id().alias("_at"))
    values = placed.groupBy(*names).agg(
        F.min("_at").alias("_at"), F.count(F.lit(1)).alias("_rows")
    ).checkpoint(eager=True)
    ranges = values.groupBy(F.shiftright("_at", ROW_BITS).alias("_part")).agg(
        F.sum("_rows").alias("_in_part"), F.max("_rows").alias("_most")
    ).orderBy("_part").collect()  # one row per partition
    before, offsets = 0, []
    for row in ranges:
        offsets.append((row["_part"], before))
        before += row["_in_part"]
    known = keys.sparkSession.createDataFrame(offsets, "_part bigint, _before bigint")
    place = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    numbers = values.withColumn("_part", F.shiftright("_at", ROW_BITS)).join(
        F.broadcast(known), "_part"
    ).select(*names, (F.col("_before") + place + 1).alias("_first"))
    return numbers, any(row["_most"] > 1 for row in ranges)
