"""Statistics from partial results per month, which add up to those of the whole tables.

A month's part is computed once, kept, and computed again only when rows of the month change.
Counts and sums add up; distinct inspectors are kept as bitmaps of their ids, which are or-ed,
so their number is exact over any months. Rows without a time have a part of their own.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitlake.functions.literals import day
from permitlake.plans.payments import collected
from permitlake.registry import Registry

MONTH = "month"
# Figures of the statistics, by the status or method that they count.
PAYMENT_STATUSES = {"successful_payments": "success", "pending_payments": "pending", "failed_payments": "failed"}
PAYMENT_METHODS = {"mpesa_payments": "mpesa", "cash_payments": "cash", "bank_payments": "bank"}
INSPECTION_STATUSES = {"visited": "visited", "not_found": "not_found", "noncompliant": "noncompliant"}


def _count(column: str, value: str):
    return F.count(F.when(F.col(column) == value, 1))


def payment_parts(payments: DataFrame) -> DataFrame:
    """One row per month of payments: counts, and the sum of successful amounts."""
    return payments.groupBy(F.trunc("paid_at", "month").alias(MONTH)).agg(
        F.count(F.lit(1)).alias("total_payments"),
        *(_count("status", v).alias(name) for name, v in PAYMENT_STATUSES.items()),
        F.coalesce(F.sum(collected(F.col("amount"), F.col("status"))), F.lit(0)).alias("total_amount_collected"),
        *(_count("payment_method", v).alias(name) for name, v in PAYMENT_METHODS.items()),
    )


def payment_statistics(parts: DataFrame) -> DataFrame:
    """The row of `payments.payment_statistics` from parts of any months."""
    return parts.agg(*(
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts.columns if c != MONTH
    ))


def inspection_parts(inspections: DataFrame) -> DataFrame:
    """One row per month and block of inspector ids: counts, and the bitmap of the ids."""
    block = F.bitmap_bucket_number("inspector_id").alias("block")
    return inspections.groupBy(F.trunc("inspected_at", "month").alias(MONTH), block).agg(
        F.count(F.lit(1)).alias("total_inspections"),
        *(_count("status", v).alias(name) for name, v in INSPECTION_STATUSES.items()),
        F.bitmap_construct_agg(F.bitmap_bit_position("inspector_id")).alias("inspectors"),
    )


def inspection_statistics(parts: DataFrame) -> DataFrame:
    """The row of `inspections.inspection_statistics` from parts of any months."""
    counts = [c for c in parts.columns if c not in (MONTH, "block", "inspectors")]
    blocks = parts.groupBy("block").agg(
        *(F.sum(c).alias(c) for c in counts), F.bitmap_or_agg("inspectors").alias("inspectors")
    )
    known = F.when(F.col("block").isNotNull(), F.bitmap_count("inspectors"))
    return blocks.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts),
        F.coalesce(F.sum(known), F.lit(0)).alias("active_inspectors"),
    )


def refreshed(
    parts: DataFrame, registry: Registry, table: str, months: Iterable[dt.date | None]
) -> DataFrame:
    """Parts after rows of some months have changed: those months are computed again, from
    their folders only where the table is stored by month; all other parts stay."""
    make = {"payments": payment_parts, "inspections": inspection_parts}[table]
    wanted = list(months)
    dated = [day(m) for m in wanted if m is not None]
    again = F.lit(None in wanted) & F.col(MONTH).isNull()
    if dated:
        again = again | F.coalesce(F.col(MONTH).isin(dated), F.lit(False))
    rows = [registry.of_month(table, m) for m in wanted]
    kept = parts.filter(~again)
    for part in rows:
        kept = kept.unionByName(make(part))
    return kept
