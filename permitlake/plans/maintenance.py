"""Status updates and activity stamps, as jobs that return the new table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitlake.functions.literals import moment
from permitlake.operators.joins import keys_of
from permitlake.operators.keyed import update_by_key, updated_pairs
from permitlake.registry import Registry


def permit_changes(changes: DataFrame) -> DataFrame:
    """Status and penalty by permit_id; a penalty that is not given is 0."""
    penalty = F.col("penalty_amount") if "penalty_amount" in changes.columns else F.lit(None)
    return changes.select(
        "permit_id", "status", F.coalesce(penalty, F.lit(0)).alias("penalty_amount")
    )


def payment_changes(changes: DataFrame) -> DataFrame:
    """Status by payment_id, and the receipt where there is such a column."""
    return changes.select(
        "payment_id", "status", *(c for c in ("receipt_url",) if c in changes.columns)
    )


def update_permit_status(registry: Registry, changes: DataFrame) -> DataFrame:
    return update_by_key(
        registry.table("permits"), permit_changes(changes), "permit_id", unique=True
    )


def update_payment_status(registry: Registry, changes: DataFrame) -> DataFrame:
    """A receipt that is not given stays as it is."""
    return update_by_key(
        registry.table("payments"), payment_changes(changes), "payment_id",
        keep_if_null=("receipt_url",), unique=True,
    )


def permit_pairs(registry: Registry, changes: DataFrame) -> DataFrame:
    """The permits that the changes name, before and after."""
    return updated_pairs(registry.table("permits"), permit_changes(changes), "permit_id")


def payment_pairs(registry: Registry, changes: DataFrame) -> DataFrame:
    """The payments that the changes name, before and after."""
    return updated_pairs(
        registry.table("payments"), payment_changes(changes), "payment_id",
        keep_if_null=("receipt_url",),
    )


def touch_user_activity(
    registry: Registry, user_ids: DataFrame, *, now: dt.datetime, column: str = "created_at"
) -> DataFrame:
    """Stamp the time on the listed users."""
    stamped = keys_of(user_ids.toDF("user_id"), "user_id").withColumn(column, moment(now))
    return update_by_key(registry.table("users"), stamped, "user_id", unique=True)
