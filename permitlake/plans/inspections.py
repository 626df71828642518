"""Inspection lists and statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitlake.functions.literals import moment
from permitlake.operators.joins import matching
from permitlake.operators.ordering import down, in_order, up
from permitlake.registry import Registry


def _inspectors(registry: Registry) -> DataFrame:
    return registry.table("users").select(
        F.col("user_id").alias("inspector_id"), F.col("name").alias("inspector_name")
    )


def _holders(registry: Registry) -> DataFrame:
    return registry.table("businesses").select(
        "business_id", F.col("name").alias("business_name")
    )


def inspections_by_business(
    registry: Registry, business_id, *, ordered: bool = True
) -> DataFrame:
    inspections = matching(registry.table("inspections"), "business_id", business_id)
    rows = inspections.join(_inspectors(registry), "inspector_id").select(
        *inspections.columns, "inspector_name"
    )
    return in_order(rows, ordered, down("inspected_at"), up("inspection_id"))


def inspections_by_inspector(
    registry: Registry,
    inspector_id,
    *,
    start: dt.date | dt.datetime | None = None,
    end: dt.date | dt.datetime | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Inspections of one or several inspectors between two bounds, both included; a
    missing bound is open."""
    inspections = matching(
        registry.between("inspections", start, end), "inspector_id", inspector_id
    )
    rows = (
        inspections.join(_holders(registry), "business_id")
        .join(_inspectors(registry), "inspector_id")
        .select(*inspections.columns, "business_name", "inspector_name")
    )
    return in_order(rows, ordered, down("inspected_at"), up("inspection_id"))


def inspection_summary(
    registry: Registry, *, now: dt.datetime, ordered: bool = True
) -> DataFrame:
    """All inspections with business, inspector and the whole 24-hour days since."""
    inspections = registry.table("inspections").select(
        "inspection_id", "business_id", "inspector_id",
        F.col("status").alias("inspection_status"), "notes", "inspected_at",
    )
    since = F.extract(F.lit("DAY"), moment(now) - F.col("inspected_at"))
    rows = (
        inspections.join(_holders(registry), "business_id")
        .join(_inspectors(registry), "inspector_id")
        .select(
            "inspection_id", "business_id", "business_name", "inspector_name",
            "inspection_status", "notes", "inspected_at",
            since.alias("days_since_inspection"),
        )
    )
    return in_order(rows, ordered, down("inspected_at"), up("inspection_id"))


def inspection_statistics(registry: Registry) -> DataFrame:
    status = F.col("status")

    def count_if(condition):
        return F.count(F.when(condition, 1))

    return registry.table("inspections").agg(
        F.count(F.lit(1)).alias("total_inspections"),
        count_if(status == "visited").alias("visited"),
        count_if(status == "not_found").alias("not_found"),
        count_if(status == "noncompliant").alias("noncompliant"),
        F.countDistinct("inspector_id").alias("active_inspectors"),
    )
