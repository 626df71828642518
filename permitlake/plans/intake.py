"""Intake jobs: new rows for each table, with application defaults and serial keys.

Each job returns the rows to append, in the columns of the table. Where a value may be
left out, a null or a missing column means it was not given. `order_by` sets the order
in which keys are assigned and should be unique.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitlake.functions.literals import day
from permitlake.functions.rules import backfill_fee, permit_fee
from permitlake.operators.ids import assign_ids
from permitlake.operators.joins import keys_of
from permitlake.operators.keyed import conform
from permitlake.plans.businesses import businesses_by_pins, businesses_without_permit
from permitlake.registry import Registry
from permitlake.schemas import SCORE, TABLES


def _given(rows: DataFrame, column: str, default: Column) -> Column:
    if column not in rows.columns:
        return default.alias(column)
    return F.coalesce(F.col(column), default).alias(column)


def _intake(
    rows: DataFrame,
    table: str,
    given: tuple[str, ...],
    derived: tuple[Column, ...],
    *,
    now: dt.datetime,
    order_by: list[str],
    start_after: int,
) -> DataFrame:
    """Rows with the given and derived columns only; the rest gets the table's defaults."""
    key = TABLES[table].key
    present = [c for c in given if c in rows.columns]
    order = {f"_order_{i}": F.col(c).alias(f"_order_{i}") for i, c in enumerate(order_by)}
    shaped = rows.select(*present, *derived, *order.values())
    kept = [c for c in shaped.columns if c not in order]
    numbered = assign_ids(shaped, key, list(order), start_after, keep=kept)
    return conform(numbered, table, now)


def ingest_users(
    rows: DataFrame, *, now: dt.datetime, order_by: list[str], start_after: int = 0
) -> DataFrame:
    return _intake(
        rows,
        "users",
        ("name", "email", "phone", "password_hash"),
        (_given(rows, "role", F.lit("officer")),),
        now=now, order_by=order_by, start_after=start_after,
    )


def ingest_businesses(
    rows: DataFrame, *, now: dt.datetime, order_by: list[str], start_after: int = 0
) -> DataFrame:
    given = (
        "owner_id", "kra_pin", "name", "category", "size", "location", "latitude",
        "longitude", "ward",
    )
    return _intake(
        rows, "businesses", given, (),
        now=now, order_by=order_by, start_after=start_after,
    )


def ingest_permits(
    rows: DataFrame, *, now: dt.datetime, order_by: list[str], start_after: int = 0
) -> DataFrame:
    """New permits are issued, by default on the day of `now` and to the end of the year."""
    year_end = F.make_date(F.col("permit_year"), F.lit(12), F.lit(31))
    derived = (
        F.lit("issued").alias("status"),
        _given(rows, "issue_date", day(now.date())),
        _given(rows, "expiry_date", year_end),
    )
    return _intake(
        rows, "permits", ("business_id", "permit_year", "fee_amount"), derived,
        now=now, order_by=order_by, start_after=start_after,
    )


def ingest_payments(
    rows: DataFrame, *, now: dt.datetime, order_by: list[str], start_after: int = 0
) -> DataFrame:
    given = ("permit_id", "amount", "payment_method", "mpesa_code")
    return _intake(
        rows, "payments", given, (_given(rows, "status", F.lit("pending")),),
        now=now, order_by=order_by, start_after=start_after,
    )


def ingest_inspections(
    rows: DataFrame, *, now: dt.datetime, order_by: list[str], start_after: int = 0
) -> DataFrame:
    given = (
        "business_id", "inspector_id", "notes", "status", "photo_url", "latitude", "longitude",
    )
    return _intake(
        rows, "inspections", given, (),
        now=now, order_by=order_by, start_after=start_after,
    )


def backfill_permits(
    registry: Registry, *, year: int, now: dt.datetime, start_after: int = 0
) -> DataFrame:
    """A permit at the flat fee of its size for every business without one in the year, in
    the columns of the table and with its key."""
    lacking = businesses_without_permit(registry, year=year)
    rows = lacking.select(
        "business_id",
        F.lit(year).cast("int").alias("permit_year"),
        backfill_fee(F.col("size")).alias("fee_amount"),
        day(dt.date(year, 1, 15)).alias("issue_date"),
        day(dt.date(year, 12, 31)).alias("expiry_date"),
    )
    return ingest_permits(rows, now=now, order_by=["business_id"], start_after=start_after)


# What the backfill writes for a business without a score.
BACKFILL_FEATURES = (
    '{"location_score": 0.8, "payment_history": 0.9, "inspection_score": 0.7}'
)
BACKFILL_VERSION = "v1.0"
BACKFILL_CLUSTER = "medium_risk"
# The score starts at 0.75; a draw adds up to, not including, 0.25 in this many steps.
DRAWS = 10**15


def backfill_scores(
    registry: Registry, *, seed: int, now: dt.datetime, start_after: int = 0
) -> DataFrame:
    """A score from 0.75 up to 1 for every business without one, in the columns of the table
    and with its key.

    The score is drawn from a hash of seed and business, not from a generator per task,
    so a task that runs again after a loss draws the same scores.
    """
    scored = keys_of(registry.table("compliance_scores"), "business_id")
    lacking = registry.table("businesses").select("business_id").join(
        scored, "business_id", "left_anti"
    )
    digest = F.md5(F.concat_ws(":", F.lit(seed), "business_id"))
    draw = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % DRAWS
    step = F.lit("0.00000000000000025").cast("decimal(17,17)")
    score = F.lit("0.75").cast(SCORE) + draw.cast("decimal(15,0)") * step
    return _intake(
        lacking,
        "compliance_scores",
        ("business_id",),
        (
            score.cast(SCORE).alias("score"),
            F.lit(BACKFILL_VERSION).alias("model_version"),
            F.lit(BACKFILL_FEATURES).alias("features_json"),
            F.lit(BACKFILL_CLUSTER).alias("cluster_label"),
        ),
        now=now, order_by=["business_id"], start_after=start_after,
    )


def issue_permits(
    registry: Registry, pins, *, year: int, now: dt.datetime, start_after: int = 0
) -> DataFrame:
    """New permits of the year, at the fee of size and category, for the listed PINs."""
    holders = businesses_by_pins(registry, pins)
    rows = holders.select(
        "business_id",
        F.lit(year).cast("int").alias("permit_year"),
        permit_fee(F.col("size"), F.col("category")).alias("fee_amount"),
    )
    return ingest_permits(rows, now=now, order_by=["business_id"], start_after=start_after)
