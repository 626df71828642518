"""Figures of the dashboard and the administration page."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitlake.operators.ordering import down
from permitlake.plans.businesses import business_statistics
from permitlake.plans.inspections import inspection_statistics
from permitlake.plans.payments import payment_statistics
from permitlake.registry import Registry
from permitlake.schemas import TABLES

# Tables open to preview, and the number of rows shown.
PREVIEW_TABLES = (
    "users", "businesses", "permits", "payments", "inspections", "compliance_scores",
)
PREVIEW_ROWS = 100

# Tables whose rows the health check counts.
HEALTH_TABLES = ("users", "businesses", "permits")


def _percent(part, whole):
    """Share in percent to one decimal; null where there is nothing to share."""
    return F.round(100.0 * F.col(part) / F.nullif(F.col(whole), F.lit(0)), 1)


def _metrics(one_row: DataFrame, metrics: dict) -> DataFrame:
    """One (metric, value) row per entry from a one-row DataFrame."""
    pairs = [
        F.struct(F.lit(name).alias("metric"), value.cast("string").alias("value"))
        for name, value in metrics.items()
    ]
    return one_row.select(F.inline(F.array(*pairs)))


def quick_stats(registry: Registry, *, as_of: dt.date) -> DataFrame:
    """Six headline figures as (metric, value) text rows."""
    rate = F.regexp_replace(
        _percent("successful_payments", "total_payments").cast("string"), r"\.0$", ""
    )
    businesses = _metrics(
        business_statistics(registry, as_of=as_of),
        {
            "Total Businesses": F.col("total_businesses"),
            "Active Permits": F.col("active_permits"),
            "Expired Permits": F.col("expired_permits"),
        },
    )
    payments = _metrics(
        payment_statistics(registry),
        {
            "Total Payments": F.col("total_payments"),
            "Payment Success Rate": F.concat(F.coalesce(rate, F.lit("0")), F.lit("%")),
        },
    )
    inspections = _metrics(
        inspection_statistics(registry), {"Total Inspections": F.col("total_inspections")}
    )
    return businesses.unionByName(payments).unionByName(inspections)


def compliance_rate(registry: Registry, *, as_of: dt.date) -> DataFrame:
    """Active permits in percent of the total, with its colour band; gray without rows."""
    stats = business_statistics(registry, as_of=as_of)
    rate = F.col("compliance_rate")
    band = (
        F.when(rate >= 80, "green")
        .when(rate >= 60, "yellow")
        .when(rate.isNotNull(), "red")
        .otherwise("gray")
    )
    rated = stats.select(_percent("active_permits", "total_businesses").alias("compliance_rate"))
    return rated.select("compliance_rate", band.alias("band"))


def recent_activity(registry: Registry, *, count: int = 5) -> DataFrame:
    """The newest audit entries with the name of their user, newest first.

    The entries are cut to `count` before users are read. Spark sees how few they are. Of a log
    that is stored by month, only as many months are read, from the newest on, as have `count`
    entries; these few rows are fetched at once.
    """
    newest = _newest_entries(registry, count)
    people = registry.table("users").select("user_id", F.col("name").alias("user"))
    named = people.join(newest.select("user_id").distinct(), "user_id", "left_semi")
    return (
        newest.join(named, "user_id", "left")
        .orderBy(down("timestamp"), down("log_id"))
        .select(
            F.substring(F.col("timestamp").cast("string"), 12, 5).alias("time"),
            F.concat_ws(" ", "action", "target_table").alias("activity"),
            F.coalesce("user", F.lit("System")).alias("user"),
            F.lit("Success").alias("status"),
            "log_id",
        )
    )


def _newest_entries(registry: Registry, count: int) -> DataFrame:
    def first(rows: DataFrame, wanted: int) -> DataFrame:
        entries = rows.select("log_id", "timestamp", "action", "target_table", "user_id")
        return entries.orderBy(down("timestamp"), down("log_id")).limit(wanted)

    months = registry.months("audit_logs")
    if months is None:
        return first(registry.table("audit_logs"), count)
    found, schema = [], first(registry.table("audit_logs"), 0).schema
    for month in months:
        found += first(registry.of_month("audit_logs", month), count - len(found)).collect()
        if len(found) == count:  # all later months are older than these
            break
    return registry.spark.createDataFrame(found, schema)


def table_preview(registry: Registry, table: str) -> DataFrame:
    """The first rows of an allowed table, by key."""
    if table not in PREVIEW_TABLES:
        raise ValueError(f"table {table!r} is not open to preview")
    return registry.table(table).orderBy(TABLES[table].key).limit(PREVIEW_ROWS)


def sql_select(registry: Registry, text: str) -> DataFrame:
    """The result of a user's query; it must be a SELECT over the registry tables."""
    query = text.strip()
    if not query:
        raise ValueError("the query is empty")
    if not query.upper().startswith("SELECT"):
        raise ValueError("only SELECT queries are allowed")
    tables = {name: registry.table(name) for name in registry.names()}
    names = {name: f"registry_{uuid.uuid4().hex}_{name}" for name in tables}
    # The caller may have views of these names, so ours have others. A query names its
    # tables, then, by a common table expression in front of it.
    for name, rows in tables.items():
        rows.createOrReplaceTempView(names[name])
    own = ", ".join(f"{name} AS (SELECT * FROM {view})" for name, view in names.items())
    try:
        return registry.spark.sql(f"WITH {own} {query}")
    finally:
        for view in names.values():
            registry.spark.catalog.dropTempView(view)


def table_counts(registry: Registry, tables: tuple[str, ...] = HEALTH_TABLES) -> DataFrame:
    counts = [
        registry.table(name).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name in tables
    ]
    result = counts[0]
    for one in counts[1:]:
        result = result.unionByName(one)
    return result
