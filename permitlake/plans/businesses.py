"""Business lookups, the permit summary and the business statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitlake.functions.literals import day, like_escape, slug
from permitlake.functions.rules import expires_soon, status_description
from permitlake.operators.joins import (
    keys_of, lacking, left_join_hot_right, matching, padded_join, presence,
)
from permitlake.operators.ordering import down, in_order, up
from permitlake.plans.search_index import holders_of, term_grams
from permitlake.registry import Registry

# Columns of the summary.
SUMMARY_COLUMNS = (
    "business_id", "business_name", "kra_pin", "category", "size", "location", "ward",
    "business_status", "permit_id", "permit_year", "permit_status", "fee_amount",
    "issue_date", "expiry_date",
)

# Headings of the dashboard table.
DISPLAY_HEADINGS = {
    "business_name": "Business Name",
    "kra_pin": "KRA PIN",
    "category": "Category",
    "size": "Size",
    "location": "Location",
    "ward": "Ward",
    "permit_status_desc": "Permit Status",
}


def _active(registry: Registry) -> DataFrame:
    return registry.table("businesses").filter(F.col("status") == "active")


def businesses_by_owner(registry: Registry, owner_id, *, ordered: bool = True) -> DataFrame:
    """Active businesses of one owner, or of a list or DataFrame of owners, newest first."""
    found = matching(_active(registry), "owner_id", owner_id)
    return in_order(found, ordered, down("created_at"), up("business_id"))


def businesses_by_pins(registry: Registry, pins) -> DataFrame:
    return matching(registry.table("businesses"), "kra_pin", pins)


def business_summary(
    registry: Registry, *, as_of: dt.date, business_id=None, ordered: bool = True
) -> DataFrame:
    """Active businesses with each permit of the year of `as_of`, or none, by name."""
    rows = _summary(registry, as_of, business_id, None)
    return in_order(rows, ordered, up("business_name"), up("business_id"), up("permit_id"))


def _summary(registry: Registry, as_of: dt.date, business_id, present: DataFrame | None) -> DataFrame:
    """The summary's rows; `present` tells of each business whether it has a permit."""
    businesses = _active(registry).select(
        "business_id", F.col("name").alias("business_name"), "kra_pin", "category", "size",
        "location", "ward", F.col("status").alias("business_status"),
    )
    if business_id is not None:
        businesses = matching(businesses, "business_id", business_id)
    permits = registry.permits_of_year(as_of.year).select(
        "business_id", "permit_id", "permit_year", F.col("status").alias("permit_status"),
        "fee_amount", "issue_date", "expiry_date",
    )
    if present is None:
        present = presence(businesses, "business_id", permits)
    rows = padded_join(businesses, permits, "business_id", lacking(present, 1))
    return rows.select(
        *SUMMARY_COLUMNS,
        status_description(F.col("expiry_date"), as_of).alias("permit_status_desc"),
    )


def business_permit_summary(
    registry: Registry, *, as_of: dt.date, ordered: bool = False
) -> DataFrame:
    """The summary with each compliance score of the business, or none. Scores are meant
    to be one per business; several repeat its permits, as in any such join.

    Which businesses lack a permit and which lack a score is found by one grouping of the three
    key columns, whose shuffle both joins read."""
    scores = registry.table("compliance_scores").select(
        "business_id", F.col("score").alias("compliance_score"), "cluster_label"
    )
    permits = registry.permits_of_year(as_of.year)
    present = presence(_active(registry), "business_id", permits, scores)
    summary = _summary(registry, as_of, None, present)
    rows = padded_join(summary, scores, "business_id", lacking(present, 2))
    return in_order(rows, ordered, up("business_name"), up("business_id"), up("permit_id"))


def permit_status_counts(registry: Registry, *, as_of: dt.date) -> DataFrame:
    summary = business_summary(registry, as_of=as_of, ordered=False)
    return summary.groupBy("permit_status_desc").agg(F.count(F.lit(1)).alias("permits"))


def display_summary(registry: Registry, *, as_of: dt.date, ordered: bool = True) -> DataFrame:
    """The summary under its dashboard headings, with a slug of the status."""
    summary = business_summary(registry, as_of=as_of, ordered=ordered)
    return summary.select(
        *(F.col(c).alias(heading) for c, heading in DISPLAY_HEADINGS.items()),
        slug(F.col("permit_status_desc")).alias("status_slug"),
    )


def search_businesses(
    registry: Registry,
    *,
    as_of: dt.date,
    term: str | None = None,
    ward: str | None = None,
    category: str | None = None,
    size: str | None = None,
    raw: bool = False,
    ordered: bool = True,
    postings: DataFrame | None = None,
) -> DataFrame:
    """Active businesses that pass the given filters, with their permits of the year.

    The term is sought in name and PIN, in any case; `raw` leaves % and _ as wildcards. With
    `postings` of the businesses (`plans.search_index`), only those that hold all trigrams of
    the term are looked at; a term without one is sought in all of them.
    """
    found = _active(registry)
    if term is not None:
        grams = term_grams(registry.spark, term, raw) if postings is not None else []
        if grams:
            found = matching(found, "business_id", holders_of(postings, grams))
        pattern = f"%{term if raw else like_escape(term)}%"
        found = found.filter(F.col("name").ilike(pattern) | F.col("kra_pin").ilike(pattern))
    for column, wanted in (("ward", ward), ("category", category), ("size", size)):
        if wanted is not None:
            found = found.filter(F.col(column) == wanted)
    permits = registry.permits_of_year(as_of.year).select(
        "business_id", "permit_year", F.col("status").alias("permit_status")
    )
    rows = left_join_hot_right(found, permits, "business_id").select(
        *found.columns, "permit_year", "permit_status"
    )
    return in_order(rows, ordered, up("name"), up("business_id"))


def businesses_without_permit(registry: Registry, *, year: int) -> DataFrame:
    """Businesses of any status that have no permit in the year."""
    businesses = registry.table("businesses")
    held = keys_of(registry.permits_of_year(year), "business_id")
    return businesses.join(held, "business_id", "left_anti").select(*businesses.columns)


def business_statistics(registry: Registry, *, as_of: dt.date) -> DataFrame:
    """One row of counts over active businesses left-joined to the permits of the year.

    A business with several permits counts once per permit, as a row of that join does;
    `distinct_businesses` counts it once. Permits are counted per business before the
    join, so the join has unique keys on either side.
    """
    expiry = F.col("expiry_date")

    def count_if(condition):
        return F.count(F.when(condition, 1))

    per_business = registry.permits_of_year(as_of.year).groupBy("business_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        count_if(F.col("status") == "issued").alias("_issued"),
        count_if(expiry < day(as_of)).alias("_expired"),
        count_if(expires_soon(expiry, as_of)).alias("_soon"),
    )
    joined = _active(registry).select("business_id", "size").join(
        per_business, "business_id", "left"
    )
    rows = F.coalesce("_rows", F.lit(1))

    def total(value):
        return F.coalesce(F.sum(value), F.lit(0))

    def rows_of_size(size):
        return total(F.when(F.col("size") == size, rows))

    return joined.agg(
        total(rows).alias("total_businesses"),
        total("_issued").alias("active_permits"),
        total("_expired").alias("expired_permits"),
        total("_soon").alias("expiring_soon"),
        rows_of_size("Small").alias("small_businesses"),
        rows_of_size("Medium").alias("medium_businesses"),
        rows_of_size("Large").alias("large_businesses"),
        F.count(F.lit(1)).alias("distinct_businesses"),
    )
