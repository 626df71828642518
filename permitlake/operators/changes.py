"""Change capture between two states of a table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitlake.functions.literals import moment
from permitlake.operators.joins import matching
from permitlake.schemas import TABLES

# Nulls stay in the JSON, and times keep their microseconds.
JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _entries(
    rows: DataFrame, table: str, key: Column, action: Column, metadata: Column, now, user_id
) -> DataFrame:
    user = user_id if isinstance(user_id, Column) else F.lit(user_id)
    return rows.select(
        user.cast("long").alias("user_id"),
        action.alias("action"),
        F.lit(table).alias("target_table"),
        key.alias("target_id"),
        moment(now).alias("timestamp"),
        metadata.alias("metadata"),
    )


def _whole_rows(rows: DataFrame, table: str, action: str, now, user_id) -> DataFrame:
    whole = F.to_json(F.struct(*rows.columns), JSON_OPTIONS)
    key = F.col(TABLES[table].key)
    return _entries(rows, table, key, F.lit(action), whole, now, user_id)


def audit_inserts(
    rows: DataFrame, table: str, *, now: dt.datetime, user_id: int | Column = 0
) -> DataFrame:
    """Audit rows of an append: one per new row, without a join."""
    return _whole_rows(rows, table, "INSERT", now, user_id)


def audit_deletes(
    rows: DataFrame, table: str, *, now: dt.datetime, user_id: int | Column = 0
) -> DataFrame:
    """Audit rows of a delete: one per row that goes, without a join."""
    return _whole_rows(rows, table, "DELETE", now, user_id)


def audit_changes(
    old: DataFrame,
    new: DataFrame,
    table: str,
    *,
    now: dt.datetime,
    user_id: int | Column = 0,
    among: DataFrame | None = None,
) -> DataFrame:
    """One audit row per inserted, updated or deleted row, without log ids.

    Rows pair by the table's own key, which is unique in either state, so the full outer
    join has at most one pair per key. JSON is written for changed rows only. Where the
    keys that may have changed are known, `among` holds them: both states are then cut to
    those before they are shuffled.
    """
    key = TABLES[table].key
    columns = old.columns
    if among is not None:
        old, new = (matching(state, key, among.select(key)) for state in (old, new))
    before = old.select(F.col(key).alias("_key"), F.struct(*columns).alias("old"))
    after = new.select(F.col(key).alias("_key"), F.struct(*columns).alias("new"))
    changed = before.join(after, "_key", "full").filter(
        ~F.col("old").eqNullSafe(F.col("new"))
    )
    action = (
        F.when(F.col("old").isNull(), "INSERT")
        .when(F.col("new").isNull(), "DELETE")
        .otherwise("UPDATE")
    )
    both = F.struct("old", "new")
    metadata = (
        F.when(F.col("old").isNull(), F.to_json("new", JSON_OPTIONS))
        .when(F.col("new").isNull(), F.to_json("old", JSON_OPTIONS))
        .otherwise(F.to_json(both, JSON_OPTIONS))
    )
    return _entries(changed, table, F.col("_key"), action, metadata, now, user_id)


def update_entries(
    pairs: DataFrame,
    table: str,
    *,
    now: dt.datetime,
    user_id: int | Column = 0,
) -> DataFrame:
    """Audit rows of an update from its own join: `pairs` are those of `keyed.updated_pairs`,
    the rows that the changes name before and after. Nothing is joined again."""
    key = TABLES[table].key
    changed = pairs.filter(~F.col("old").eqNullSafe(F.col("new")))
    metadata = F.to_json(F.struct("old", "new"), JSON_OPTIONS)
    return _entries(changed, table, F.col("old")[key], F.lit("UPDATE"), metadata, now, user_id)
