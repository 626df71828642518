"""Permit lookups, expiry lists and fees."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitlake.functions.literals import day
from permitlake.functions.rules import is_expired, permit_fee
from permitlake.operators.joins import matching
from permitlake.operators.ordering import down, in_order, up
from permitlake.registry import Registry


def permits_by_business(registry: Registry, business_id, *, ordered: bool = True) -> DataFrame:
    found = matching(registry.table("permits"), "business_id", business_id)
    return in_order(found, ordered, down("permit_year"), up("permit_id"))


def expiring_permits(
    registry: Registry, *, as_of: dt.date, days_ahead: int = 30, ordered: bool = True
) -> DataFrame:
    """Issued permits that expire from `as_of` to `days_ahead` days later, both included."""
    last = as_of + dt.timedelta(days=days_ahead)
    permits = registry.table("permits").filter(
        (F.col("status") == "issued") & F.col("expiry_date").between(day(as_of), day(last))
    )
    holders = registry.table("businesses").select(
        "business_id", F.col("name").alias("business_name"), "kra_pin"
    )
    rows = permits.join(holders, "business_id").select(
        *permits.columns, "business_name", "kra_pin"
    )
    return in_order(rows, ordered, up("expiry_date"), up("permit_id"))


def permits_expired(registry: Registry, permit_ids: DataFrame, *, as_of: dt.date) -> DataFrame:
    """Each listed permit id with whether it is expired; an unknown one is."""
    ids = permit_ids.toDF("permit_id")
    expiry = registry.table("permits").select("permit_id", "expiry_date")
    return ids.join(expiry, "permit_id", "left").select(
        "permit_id", is_expired(F.col("expiry_date"), as_of).alias("is_expired")
    )


def with_permit_fee(businesses: DataFrame) -> DataFrame:
    fee = permit_fee(F.col("size"), F.col("category"))
    return businesses.withColumn("permit_fee", fee)
