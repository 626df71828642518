"""Result order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def up(column: str) -> Column:
    return F.col(column).asc_nulls_last()


def down(column: str) -> Column:
    return F.col(column).desc_nulls_first()


def in_order(rows: DataFrame, ordered: bool, *by: Column) -> DataFrame:
    """Globally sorted rows.

    `by` should end in a unique key: ties are then deterministic, and the range bounds of
    the sort can split a value that many rows share. With `ordered=False` the sort is
    left out, for callers that go on to write or join the rows.
    """
    return rows.orderBy(*by) if ordered else rows
