"""Payment lookups, summaries, balances and revenue."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permitlake.functions.literals import day, moment
from permitlake.operators.joins import matching
from permitlake.operators.ordering import down, in_order, up
from permitlake.registry import Registry
from permitlake.schemas import MONEY

Bound = dt.date | dt.datetime | None


def collected(amount: Column, status: Column) -> Column:
    """The amount if the payment succeeded, else 0."""
    return F.when(status == "success", amount).otherwise(F.lit(0).cast(MONEY))


def payments_by_permit(registry: Registry, permit_id, *, ordered: bool = True) -> DataFrame:
    found = matching(registry.table("payments"), "permit_id", permit_id)
    return in_order(found, ordered, down("paid_at"), up("payment_id"))


def payment_summary(registry: Registry, *, ordered: bool = True) -> DataFrame:
    """Payments with their permit and business, newest first.

    Permits meet their business first: payments, the largest table, are then shuffled
    once, by permit.
    """
    holders = registry.table("businesses").select(
        "business_id", F.col("name").alias("business_name")
    )
    permits = registry.table("permits").select(
        "permit_id", "business_id", "permit_year", "fee_amount"
    )
    payments = registry.table("payments").select(
        "payment_id", "permit_id", "amount", "payment_method",
        F.col("status").alias("payment_status"), "paid_at",
    )
    rows = payments.join(permits.join(holders, "business_id"), "permit_id").select(
        "payment_id", "business_id", "business_name", "permit_year", "amount",
        "payment_method", "payment_status", "paid_at", "fee_amount",
    )
    return in_order(rows, ordered, down("paid_at"), up("payment_id"))


def outstanding_by_payment(registry: Registry, *, ordered: bool = False) -> DataFrame:
    """The payment summary with the permit fee less this one payment if it succeeded.

    The balance is defined per payment id. That is the key of payments, so every group
    has one row, and no grouping (and no second shuffle of all payments) is needed.
    """
    rows = payment_summary(registry, ordered=ordered)
    paid = collected(F.col("amount"), F.col("payment_status"))
    return rows.withColumn("outstanding_amount", F.col("fee_amount") - paid)


def outstanding_by_permit(registry: Registry) -> DataFrame:
    """Permit fee less all successful payments of the permit."""
    paid = (
        registry.table("payments")
        .filter(F.col("status") == "success")
        .groupBy("permit_id")
        .agg(F.sum("amount").alias("_paid"))
    )
    permits = registry.table("permits").select(
        "permit_id", "business_id", "permit_year", "fee_amount"
    )
    none = F.lit(0).cast(MONEY)
    rows = permits.join(paid, "permit_id", "left")
    paid_amount = F.coalesce("_paid", none)
    return rows.select(
        *permits.columns,
        paid_amount.alias("paid_amount"),
        (F.col("fee_amount") - paid_amount).alias("outstanding_amount"),
    )


def payment_statistics(
    registry: Registry, *, start: Bound = None, end: Bound = None
) -> DataFrame:
    """One row of counts, and the sum of successful amounts, 0 if there is none. Both bounds
    count; a date means its midnight, so later payments of an end date are left out."""
    status, method = F.col("status"), F.col("payment_method")

    def count_if(condition):
        return F.count(F.when(condition, 1))

    total = F.sum(collected(F.col("amount"), status))
    return registry.between("payments", start, end).agg(
        F.count(F.lit(1)).alias("total_payments"),
        count_if(status == "success").alias("successful_payments"),
        count_if(status == "pending").alias("pending_payments"),
        count_if(status == "failed").alias("failed_payments"),
        F.coalesce(total, F.lit(0)).alias("total_amount_collected"),
        count_if(method == "mpesa").alias("mpesa_payments"),
        count_if(method == "cash").alias("cash_payments"),
        count_if(method == "bank").alias("bank_payments"),
    )


def monthly_revenue(registry: Registry, *, as_of: dt.date) -> DataFrame:
    """Successful amount from the first of the month to the midnight that starts `as_of`."""
    first = as_of.replace(day=1)
    stats = payment_statistics(registry, start=first, end=as_of)
    revenue = F.col("total_amount_collected")
    return stats.select(
        day(first).alias("month_start"),
        day(as_of).alias("as_of"),
        revenue.alias("revenue"),
        F.concat(F.lit("KES "), F.format_number(revenue, 2)).alias("display"),
    )


def revenue_trend(registry: Registry, *, as_of: dt.date, days: int = 30) -> DataFrame:
    """Daily and cumulative successful amounts of the `days` days up to and with `as_of`.

    Payments are summed per day first, so the window runs over days + 1 rows.
    """
    first = as_of - dt.timedelta(days=days)
    after = as_of + dt.timedelta(days=1)
    paid = registry.between("payments", first, after).filter(
        (F.col("status") == "success") & (F.col("paid_at") < moment(after))
    )
    daily = paid.groupBy(F.to_date("paid_at").alias("day")).agg(F.sum("amount").alias("_sum"))
    calendar = registry.spark.range(1).select(
        F.explode(F.sequence(day(first), day(as_of))).alias("day")
    )
    revenue = F.coalesce("_sum", F.lit(0).cast(MONEY))
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return calendar.join(daily, "day", "left").select(
        "day",
        revenue.alias("daily_revenue"),
        F.sum(revenue).over(so_far).alias("cumulative_revenue"),
    )
