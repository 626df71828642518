
from __future__ import annotations

import datetime as dt
import os
import sys
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import permit_oracle  # noqa: E402
from permitlake.functions.rules import is_expired  # noqa: E402
from permitlake.operators import changes, keyed, quality  # noqa: E402
from permitlake.operators.ids import assign_ids, highest_id  # noqa: E402
from permitlake.plans import (  # noqa: E402
    businesses,
    compliance,
    dashboard,
    inspections,
    intake,
    maintenance,
    monthly,
    payments,
    permits,
    search_index,
    users,
    write_path,
)
from permitlake.registry import Registry  # noqa: E402
from permitlake.schemas import SCORE, TABLES  # noqa: E402
from permitlake.session import remove_dir, scratch_dir, tune  # noqa: E402
from permitlake.sources import parquet  # noqa: E402
from permitlake.sources.sample_tables import SampleRegistry  # noqa: E402

# Dates that stand for the wall clock, so that both engines agree.
AS_OF = dt.date(1998, 9, 1)
REVENUE_AS_OF = dt.date(1998, 9, 15)
NOW = dt.datetime(2024, 2, 1, 12, 0, 0)
YEAR = AS_OF.year

ENTRY_DIR = "/root/testdata/sf0.001"

# Queries that count every key of the largest table.
KEY_COUNTS = ("check_unique",)


def _doubles(rows: DataFrame, *columns: str) -> DataFrame:
    """Exact sums as doubles: the two engines give a sum different precisions."""
    return rows.withColumns({c: F.col(c).cast("double") for c in columns})


# --- inputs of the write jobs ---------------------------------------------------------


def _new_users(reg: Registry) -> DataFrame:
    role = F.when(F.col("role") != "finance", F.col("role"))
    return reg.table("users_incoming").withColumns(
        {"role": role, "password_hash": F.md5("email")}
    )


def _new_businesses(reg: Registry) -> DataFrame:
    located = F.col("status") == "active"
    return reg.table("businesses").withColumns(
        {
            "kra_pin": F.concat(F.lit("N"), F.substr("kra_pin", F.lit(2))),
            "latitude": F.when(located, F.col("latitude")),
            "longitude": F.when(located, F.col("longitude")),
        }
    )


def _renewals(reg: Registry) -> DataFrame:
    return reg.table("permits").select(
        "permit_id",
        "business_id",
        (F.col("permit_year") + 1).alias("permit_year"),
        "fee_amount",
        F.date_add("expiry_date", 1).alias("issue_date"),
    )


def _new_payments(reg: Registry) -> DataFrame:
    return reg.table("payments").withColumns(
        {
            "mpesa_code": F.when(F.col("payment_method") == "mpesa", F.col("payment_id")),
            "status": F.when(F.col("status") != "failed", F.col("status")),
        }
    )


def _permit_changes(reg: Registry) -> DataFrame:
    """Issued permits past their expiry become expired, large ones with a penalty."""
    penalty = F.when(F.col("fee_amount") > 200000, F.lit(250))
    lapsed = F.coalesce(is_expired(F.col("expiry_date"), AS_OF), F.lit(False))
    due = (F.col("status") == "issued") & F.col("expiry_date").isNotNull() & lapsed
    return reg.table("permits").filter(due).select(
        "permit_id", F.lit("expired").alias("status"), penalty.alias("penalty_amount")
    )


def _receipts(reg: Registry) -> Registry:
    paid_in = F.when(
        F.col("payment_method") == "bank", F.concat(F.lit("old/"), "payment_id")
    )
    return reg.replace(payments=reg.table("payments").withColumn("receipt_url", paid_in))


def _payment_changes(reg: Registry) -> DataFrame:
    receipt = F.when(
        F.col("payment_method") != "cash", F.concat(F.lit("receipt/"), "payment_id")
    )
    return reg.table("payments").filter(F.col("status") == "pending").select(
        "payment_id", F.lit("success").alias("status"), receipt.alias("receipt_url")
    )


def _scores_with_time(reg: Registry) -> Registry:
    never = F.lit(None).cast("timestamp_ntz")
    scores = reg.table("compliance_scores").withColumn("scored_at", never)
    return reg.replace(compliance_scores=scores)


def _users_with_time(reg: Registry) -> Registry:
    never = F.lit(None).cast("timestamp_ntz")
    return reg.replace(users=reg.table("users").withColumn("created_at", never))


def _questioned_permits(reg: Registry) -> DataFrame:
    """The permit of every payment; those of failed payments under an unknown, negative id."""
    known, unknown = F.col("permit_id"), -F.col("permit_id") - 1
    asked = F.when(F.col("status") == "failed", unknown).otherwise(known)
    return reg.table("payments").select(asked.alias("permit_id"))


# --- queries that combine several calls -------------------------------------------------


def _snapshot_export(reg: Registry) -> DataFrame:
    """The manifest of a snapshot; the snapshot itself goes again."""
    scratch = scratch_dir(reg.spark, "snapshot")
    path = parquet.export_snapshot(reg, scratch, NOW)
    rows = parquet.read_manifest(reg.spark, path).select("table_name", "row_count").collect()
    remove_dir(reg.spark, scratch)
    return reg.spark.createDataFrame(rows, "table_name string, row_count bigint")


def _snapshot_restore(reg: Registry) -> DataFrame:
    """Every table of a stored snapshot against the sums taken when it was written: rows, and
    whether all agree."""
    scratch = scratch_dir(reg.spark, "snapshot")
    path = parquet.export_snapshot(reg, scratch, NOW)
    found = parquet.compare_snapshot(reg.spark, path).drop("written").collect()
    remove_dir(reg.spark, scratch)
    return reg.spark.createDataFrame(found, "table_name string, row_count bigint, equal boolean")


def _upsert_scores(reg: Registry) -> DataFrame:
    return compliance.upsert_scores(
        _scores_with_time(reg), reg.table("score_updates"), now=NOW
    )


def _audit_businesses(reg: Registry, user_id: int = 0) -> DataFrame:
    old, new = reg.table("businesses_old"), reg.table("businesses_new")
    return changes.audit_changes(old, new, "businesses", now=NOW, user_id=user_id)


def _audit_permits(reg: Registry, user_id: int = 0) -> DataFrame:
    pairs = maintenance.permit_pairs(reg, _permit_changes(reg))
    return changes.update_entries(pairs, "permits", now=NOW, user_id=user_id)


def _audit_payments(reg: Registry) -> DataFrame:
    before = _receipts(reg)
    pairs = maintenance.payment_pairs(before, _payment_changes(before))
    return changes.update_entries(pairs, "payments", now=NOW)


def _recent_activity(reg: Registry) -> DataFrame:
    entries = _audit_businesses(reg, user_id=-1).unionByName(_audit_permits(reg, user_id=2))
    logs = assign_ids(entries, "log_id", ["target_table", "target_id"])
    return dashboard.recent_activity(reg.replace(audit_logs=logs))


def _rule_tables(reg: Registry) -> dict[str, DataFrame]:
    """Rows of the six sample tables with all columns of the schema and some that break
    rules: what the views lack is derived, or a typed null where the rules allow it."""
    key = {t: F.col(TABLES[t].key) for t in reg.names()}
    everyone = reg.table("users").unionByName(reg.table("users_incoming"))
    added = {
        "users": {
            "password_hash": F.when(key["users"] % 31 != 0, F.md5("email")),
            "role": F.when(key["users"] % 37 == 0, "guest").otherwise(F.col("role")),
        },
        "businesses": {},
        "permits": {
            "permit_year": F.when(key["permits"] % 1009 != 0, F.col("permit_year")),
            "status": F.when(key["permits"] % 1013 == 0, "lost").otherwise(F.col("status")),
            "business_id": F.when(key["permits"] % 1031 == 0, -F.col("business_id"))
            .otherwise(F.col("business_id")),
        },
        "payments": {
            "mpesa_code": F.when(
                F.col("payment_method") == "mpesa",
                F.concat(F.lit("M"), F.col("permit_id").cast("string")),
            ),
            "status": F.when(F.col("permit_id") % 499 != 0, F.col("status")),
            "payment_method": F.when(F.col("permit_id") % 997 == 0, "cheque").otherwise(
                F.col("payment_method")
            ),
            "permit_id": F.when(F.col("permit_id") % 991 == 0, -F.col("permit_id"))
            .otherwise(F.col("permit_id")),
        },
        "inspections": {
            "latitude": (key["inspections"] % 199 - 99).cast("double"),
            "longitude": (key["inspections"] % 367 - 183).cast("double"),
            "status": F.when(key["inspections"] % 1019 == 0, "late").otherwise(F.col("status")),
            "business_id": F.when(key["inspections"] % 1033 == 0, -key["inspections"])
            .otherwise(F.col("business_id")),
            "inspector_id": F.when(key["inspections"] % 1039 == 0, -key["inspections"])
            .otherwise(F.col("inspector_id")),
            "inspection_id": F.when(key["inspections"] % 211 == 0, key["inspections"] - 1).when(
                key["inspections"] % 503 != 0, key["inspections"]
            ),
        },
        "compliance_scores": {
            "score": F.when(key["compliance_scores"] % 101 == 0, F.lit("1.00004").cast(SCORE)).when(
                key["compliance_scores"] % 103 != 0, F.col("score")
            ),
            "business_id": F.when(key["compliance_scores"] % 107 == 0, -F.col("business_id"))
            .otherwise(F.col("business_id")),
            "features_json": F.when(key["compliance_scores"] % 109 == 0, "not json")
            .when(key["compliance_scores"] % 113 == 0, '{"a": 1} {"b": 2}')
            .otherwise(F.col("features_json")),
        },
    }
    views = {**{t: reg.table(t) for t in reg.names()}, "users": everyone}
    views["businesses"] = reg.table("businesses_dirty")
    twice = views["businesses"].filter(F.col("business_id") % 97 == 0)
    views["businesses"] = views["businesses"].unionByName(twice)
    score_twice = views["compliance_scores"].filter(F.col("score_id") % 89 == 0)
    views["compliance_scores"] = views["compliance_scores"].unionByName(score_twice)
    permit_twice = views["permits"].filter(F.col("permit_id") % 1021 == 0)
    views["permits"] = views["permits"].unionByName(permit_twice)
    return {
        t: _with_schema(rows.withColumns(added[t]) if added[t] else rows, t)
        for t, rows in views.items()
    }


def _with_schema(rows: DataFrame, table: str) -> DataFrame:
    lacking = {c: F.lit(None).cast(k) for c, k in TABLES[table].columns.items() if c not in rows.columns}
    return rows.withColumns(lacking) if lacking else rows


def _check_rows(reg: Registry, kind: str) -> DataFrame:
    found = [quality.check_rows(rows, t, (kind,)) for t, rows in _rule_tables(reg).items()]
    return reduce(DataFrame.unionByName, found)


def _check_unique(reg: Registry) -> DataFrame:
    found = [quality.check_unique(rows, t) for t, rows in _rule_tables(reg).items()]
    keys = reg.table("users").select(
        F.col("user_id").alias("key_id"),
        F.concat(F.lit("h"), (F.col("user_id") % 60).cast("string")).alias("api_key_hash"),
    )
    return reduce(DataFrame.unionByName, [*found, quality.check_unique(keys, "api_keys")])


def _check_foreign_key(reg: Registry) -> DataFrame:
    rows = _rule_tables(reg)
    found = [
        quality.check_foreign_key(rows[t], t, column, reg.table(parent))
        for t in reg.names() for column, parent in TABLES[t].parents.items()
    ]
    return reduce(DataFrame.unionByName, found)


def _refused_deletes(reg: Registry) -> DataFrame:
    """Why closed businesses, and the users that own or inspect, cannot be deleted."""
    closed = _keys(reg, "businesses", "business_id", F.col("status") == "closed")
    idle = _keys(reg, "users", "user_id", ~F.col("is_active"))
    return write_path.refused_deletes(reg, "businesses", closed).unionByName(
        write_path.refused_deletes(reg, "users", idle)
    )


def _keys(reg: Registry, table: str, column: str, condition=None) -> DataFrame:
    rows = reg.table(table)
    return (rows if condition is None else rows.filter(condition)).select(column)


def _queries() -> dict[str, Callable[[Registry], DataFrame]]:
    return {
        # scans, sources, sinks
        "scan_table": lambda r: r.table("payments"),
        "table_preview": lambda r: dashboard.table_preview(r, "payments"),
        "sql_select": lambda r: dashboard.sql_select(
            r,
            "SELECT ward, status, COUNT(*) AS businesses_in_ward "
            "FROM businesses GROUP BY ward, status",
        ),
        "append_records": lambda r: keyed.append_records(
            r.table("users"), r.table("users_incoming")
        ),
        "snapshot_export": _snapshot_export,
        "snapshot_restore": _snapshot_restore,
        "table_counts": dashboard.table_counts,
        # writes
        "ingest_users": lambda r: intake.ingest_users(
            _new_users(r), now=NOW, order_by=["user_id"],
            start_after=highest_id(r.table("users"), "user_id"),
        ),
        "ingest_businesses": lambda r: intake.ingest_businesses(
            _new_businesses(r), now=NOW, order_by=["kra_pin"],
            start_after=highest_id(r.table("businesses"), "business_id"),
        ),
        "ingest_permits": lambda r: intake.ingest_permits(
            _renewals(r), now=NOW, order_by=["permit_id"],
            start_after=highest_id(r.table("permits"), "permit_id"),
        ),
        "ingest_payments": lambda r: intake.ingest_payments(
            _new_payments(r), now=NOW, order_by=["payment_id"]
        ),
        "ingest_inspections": lambda r: intake.ingest_inspections(
            r.table("inspections"), now=NOW, order_by=["inspection_id"],
            start_after=highest_id(r.table("inspections"), "inspection_id"),
        ),
        "assign_ids": lambda r: assign_ids(
            r.table("payments").select("payment_id", "paid_at"), "receipt_number",
            ["paid_at", "payment_id"], start_after=1000,
        ),
        "insert_ignore": lambda r: keyed.insert_ignore(
            r.table("users"), r.table("users_incoming"), "email", ["user_id"]
        ),
        "backfill_permits": lambda r: intake.backfill_permits(
            r, year=YEAR, now=NOW, start_after=highest_id(r.table("permits"), "permit_id"),
        ),
        "backfill_scores": lambda r: intake.backfill_scores(
            r, seed=7, now=NOW,
            start_after=highest_id(r.table("compliance_scores"), "score_id"),
        ),
        "update_by_key": lambda r: keyed.update_by_key(
            r.table("businesses"), r.table("businesses_new").select("business_id", "size"),
            "business_id", unique=True,
        ),
        "delete_by_key": lambda r: keyed.delete_by_key(
            r.table("permits"),
            _keys(r, "payments", "permit_id", F.col("status") == "failed"),
            "permit_id",
        ),
        "update_permit_status": lambda r: maintenance.update_permit_status(
            r, _permit_changes(r)
        ),
        "update_payment_status": lambda r: maintenance.update_payment_status(
            _receipts(r), _payment_changes(r)
        ),
        "upsert_scores": _upsert_scores,
        "touch_user_activity": lambda r: maintenance.touch_user_activity(
            _users_with_time(r), _keys(r, "businesses", "owner_id"), now=NOW
        ),
        # filters and projections
        "users_by_email": lambda r: users.users_by_email(
            r, _keys(r, "users_incoming", "email")
        ),
        "users_by_id": lambda r: users.users_by_id(r, _keys(r, "businesses", "owner_id")),
        "businesses_by_owner": lambda r: businesses.businesses_by_owner(
            r, _keys(r, "users", "user_id", F.col("is_active"))
        ),
        "permits_by_business": lambda r: permits.permits_by_business(
            r, _keys(r, "businesses", "business_id", F.col("status") == "active")
        ),
        "payments_by_permit": lambda r: payments.payments_by_permit(
            r, _keys(r, "permits", "permit_id", F.col("status") == "issued")
        ),
        "search_businesses": lambda r: businesses.search_businesses(
            r, as_of=AS_OF, term="R#0000001", size="Medium"
        ),
        "search_by_postings": lambda r: businesses.search_businesses(
            r, as_of=AS_OF, term="R#0000001", size="Medium",
            postings=search_index.build_postings(r.table("businesses")),
        ),
        "search_all_businesses": lambda r: businesses.search_businesses(r, as_of=AS_OF),
        "businesses_by_pins": lambda r: businesses.businesses_by_pins(
            r, _keys(r, "businesses_dirty", "kra_pin")
        ),
        "display_summary": lambda r: businesses.display_summary(r, as_of=AS_OF),
        # joins
        "business_summary": lambda r: businesses.business_summary(r, as_of=AS_OF),
        "business_permit_summary": lambda r: businesses.business_permit_summary(r, as_of=AS_OF),
        "expiring_permits": lambda r: permits.expiring_permits(r, as_of=AS_OF),
        "payment_summary": payments.payment_summary,
        "inspections_by_business": lambda r: inspections.inspections_by_business(
            r, _keys(r, "businesses", "business_id", F.col("status") == "active")
        ),
        "inspections_by_inspector": lambda r: inspections.inspections_by_inspector(
            r,
            _keys(r, "users", "user_id", F.col("role") == "inspector"),
            start=dt.date(2024, 1, 5),
            end=dt.date(2024, 1, 20),
        ),
        "inspection_summary": lambda r: inspections.inspection_summary(r, now=NOW),
        "compliance_scores_filtered": lambda r: compliance.compliance_scores(
            r,
            min_score=Decimal("0.2"),
            max_score=Decimal("0.65"),
            cluster_label="medium_risk",
        ),
        "high_risk_businesses": compliance.high_risk_businesses,
        "businesses_without_permit": lambda r: businesses.businesses_without_permit(
            r, year=YEAR
        ),
        # aggregates
        "business_statistics": lambda r: businesses.business_statistics(r, as_of=AS_OF),
        "payment_statistics": lambda r: _doubles(
            payments.payment_statistics(r), "total_amount_collected"
        ),
        "payment_statistics_range": lambda r: _doubles(
            payments.payment_statistics(
                r, start=dt.date(1996, 1, 1), end=dt.date(1997, 6, 30)
            ),
            "total_amount_collected",
        ),
        "inspection_statistics": inspections.inspection_statistics,
        "payment_statistics_by_month": lambda r: _doubles(
            monthly.payment_statistics(monthly.payment_parts(r.table("payments"))),
            "total_amount_collected",
        ),
        "inspection_statistics_by_month": lambda r: monthly.inspection_statistics(
            monthly.inspection_parts(r.table("inspections"))
        ),
        "outstanding_by_payment": lambda r: _doubles(
            payments.outstanding_by_payment(r), "outstanding_amount"
        ),
        "outstanding_by_permit": lambda r: _doubles(
            payments.outstanding_by_permit(r), "paid_amount", "outstanding_amount"
        ),
        "quick_stats": lambda r: dashboard.quick_stats(r, as_of=AS_OF),
        "compliance_rate": lambda r: dashboard.compliance_rate(r, as_of=AS_OF),
        "monthly_revenue": lambda r: _doubles(
            payments.monthly_revenue(r, as_of=REVENUE_AS_OF), "revenue"
        ),
        "revenue_trend": lambda r: _doubles(
            payments.revenue_trend(r, as_of=REVENUE_AS_OF),
            "daily_revenue", "cumulative_revenue",
        ),
        "recent_activity": _recent_activity,
        # rules
        "permit_fee": lambda r: permits.with_permit_fee(
            r.table("businesses").select("business_id", "size", "category")
        ),
        "permit_expired": lambda r: permits.permits_expired(
            r, _questioned_permits(r), as_of=AS_OF
        ),
        "permit_status_desc": lambda r: businesses.permit_status_counts(r, as_of=AS_OF),
        "issue_permits": lambda r: intake.issue_permits(
            r, _keys(r, "businesses_dirty", "kra_pin"), year=2024, now=NOW,
            start_after=highest_id(r.table("permits"), "permit_id"),
        ),
        # change capture
        "audit_changes": _audit_businesses,
        "audit_permits": _audit_permits,
        "audit_payments": _audit_payments,
        # data rules
        "check_not_null": lambda r: _check_rows(r, quality.NOT_NULL),
        "check_domain": lambda r: _check_rows(r, quality.DOMAIN),
        "check_range": lambda r: _check_rows(r, quality.RANGE),
        "check_json": lambda r: _check_rows(r, quality.JSON),
        "check_unique": _check_unique,
        "check_foreign_key": _check_foreign_key,
        "refused_deletes": _refused_deletes,
    }


def _bind(query: Callable[[Registry], DataFrame], keys: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Sized by the largest table; the files are listed, not read.
        moved = parquet.stored_bytes(spark, f"{sf_dir}/lineitem.parquet")
        return query(SampleRegistry(tune(spark, moved, keys=keys), sf_dir))

    return run


def _training_data() -> tuple[dict[str, Callable], dict[str, str]]:
    """Queries and SQL of the llm subpackage and its pipeline, where they are installed."""
    try:
        import corpus_pipeline
        from permitlake.llm import queries as llm
    except ImportError:  # absent, or without a package that they need
        return {}, {}
    added = llm.queries() | {"pipeline": corpus_pipeline.run}
    known = llm.oracle_sql()
    if corpus_pipeline.ORACLE_SQL:
        known["pipeline"] = corpus_pipeline.ORACLE_SQL
    return added, known


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    bound = {name: _bind(query, keys=name in KEY_COUNTS) for name, query in _queries().items()}
    return bound | _training_data()[0]


def oracle_sql() -> dict[str, str]:
    return permit_oracle.oracle_sql() | _training_data()[1]


def entry(spark: SparkSession) -> DataFrame:
    """The business permit summary with compliance scores."""
    return queries()["business_permit_summary"](spark, ENTRY_DIR)
