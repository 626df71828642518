"""The thirteen registry tables: columns, keys, defaults and data rules.

Keys are 64-bit throughout: a 32-bit serial runs out at the data sizes this package is
meant for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

LONG, TEXT, BOOL = T.LongType(), T.StringType(), T.BooleanType()
INT, DOUBLE, DATE = T.IntegerType(), T.DoubleType(), T.DateType()
STAMP = T.TimestampNTZType()
# Wide, as the registry's numbers have no fixed number of digits; a value that would still
# lose some is refused (operators.keyed.exact).
MONEY, SCORE = T.DecimalType(28, 6), T.DecimalType(20, 18)

# Name of the storage folder that holds the month of a time column.
MONTH = "stored_month"

# A default with this value stands for the time of the write.
WRITE_TIME = "write time"


@dataclass(frozen=True)
class Table:
    """One table: its columns in order, and the rules its rows must keep."""

    name: str
    key: str
    columns: dict[str, T.DataType]
    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    parents: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    partition_by: tuple[str, ...] = ()
    # The column whose month is a storage folder of its own, below MONTH.
    month_of: str | None = None
    json: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, t in self.columns.items()])


# Table definitions (columns, keys, allowed values, ranges, defaults).
LATITUDE, LONGITUDE = (-90, 90), (-180, 180)

_DEFINITIONS = (
    Table(
        "users",
        "user_id",
        {
            "user_id": LONG, "name": TEXT, "email": TEXT, "phone": TEXT,
            "password_hash": TEXT, "role": TEXT, "is_active": BOOL, "created_at": STAMP,
        },
        required=("name", "email", "password_hash", "role"),
        unique=("email", "phone"),
        domains={"role": ("admin", "officer", "inspector", "finance")},
        defaults={"is_active": True, "created_at": WRITE_TIME},
    ),
    Table(
        "businesses",
        "business_id",
        {
            "business_id": LONG, "owner_id": LONG, "kra_pin": TEXT, "name": TEXT,
            "category": TEXT, "size": TEXT, "location": TEXT, "latitude": DOUBLE,
            "longitude": DOUBLE, "ward": TEXT, "status": TEXT, "created_at": STAMP,
        },
        required=("kra_pin", "name", "category", "size", "location", "ward"),
        domains={"size": ("Small", "Medium", "Large")},
        ranges={"latitude": LATITUDE, "longitude": LONGITUDE},
        parents={"owner_id": "users"},
        defaults={"status": "active", "created_at": WRITE_TIME},
    ),
    Table(
        "permits",
        "permit_id",
        {
            "permit_id": LONG, "business_id": LONG, "permit_year": INT, "fee_amount": MONEY,
            "status": TEXT, "pdf_url": TEXT, "qr_code_data": TEXT, "issue_date": DATE,
            "expiry_date": DATE, "penalty_amount": MONEY,
        },
        required=("permit_year", "fee_amount", "status"),
        domains={"status": ("issued", "expired", "cancelled")},
        parents={"business_id": "businesses"},
        defaults={"penalty_amount": 0},
        partition_by=("permit_year",),
    ),
    Table(
        "payments",
        "payment_id",
        {
            "payment_id": LONG, "permit_id": LONG, "amount": MONEY, "payment_method": TEXT,
            "mpesa_code": TEXT, "receipt_url": TEXT, "status": TEXT, "paid_at": STAMP,
        },
        required=("amount", "payment_method", "status"),
        unique=("mpesa_code",),
        domains={
            "payment_method": ("mpesa", "cash", "bank"),
            "status": ("pending", "success", "failed"),
        },
        parents={"permit_id": "permits"},
        defaults={"paid_at": WRITE_TIME},
        month_of="paid_at",
    ),
    Table(
        "compliance_scores",
        "score_id",
        {
            "score_id": LONG, "business_id": LONG, "score": SCORE, "model_version": TEXT,
            "features_json": TEXT, "cluster_label": TEXT, "scored_at": STAMP,
        },
        required=("score", "model_version"),
        ranges={"score": (0, 1)},
        parents={"business_id": "businesses"},
        defaults={"scored_at": WRITE_TIME},
        json=("features_json",),
    ),
    Table(
        "inspections",
        "inspection_id",
        {
            "inspection_id": LONG, "business_id": LONG, "inspector_id": LONG, "notes": TEXT,
            "status": TEXT, "photo_url": TEXT, "latitude": DOUBLE, "longitude": DOUBLE,
            "inspected_at": STAMP,
        },
        domains={"status": ("visited", "not_found", "noncompliant")},
        ranges={"latitude": LATITUDE, "longitude": LONGITUDE},
        parents={"business_id": "businesses", "inspector_id": "users"},
        defaults={"inspected_at": WRITE_TIME},
        month_of="inspected_at",
    ),
    Table(
        "audit_logs",
        "log_id",
        {
            "log_id": LONG, "user_id": LONG, "action": TEXT, "target_table": TEXT,
            "target_id": LONG, "timestamp": STAMP, "metadata": TEXT,
        },
        required=("action", "target_table"),
        parents={"user_id": "users"},
        defaults={"timestamp": WRITE_TIME},
        month_of="timestamp",
        json=("metadata",),
    ),
    Table(
        "chatbot_interactions",
        "chat_id",
        {
            "chat_id": LONG, "user_id": LONG, "question": TEXT, "response": TEXT,
            "language": TEXT, "rag_context_used": TEXT, "responded_at": STAMP,
        },
        required=("question", "response"),
        parents={"user_id": "users"},
        defaults={"language": "en", "responded_at": WRITE_TIME},
    ),
    Table(
        "reports",
        "report_id",
        {
            "report_id": LONG, "type": TEXT, "report_url": TEXT, "generated_by": LONG,
            "parameters": TEXT, "generated_at": STAMP,
        },
        required=("type", "report_url"),
        domains={"type": ("daily", "weekly", "monthly")},
        parents={"generated_by": "users"},
        defaults={"generated_at": WRITE_TIME},
        json=("parameters",),
    ),
    Table(
        "api_keys",
        "key_id",
        {
            "key_id": LONG, "label": TEXT, "api_key_hash": TEXT, "access_scope": TEXT,
            "created_at": STAMP, "expires_at": STAMP,
        },
        required=("label", "api_key_hash", "access_scope"),
        unique=("api_key_hash",),
        domains={"access_scope": ("read", "write", "admin")},
        defaults={"created_at": WRITE_TIME},
    ),
    Table(
        "notifications_log",
        "notification_id",
        {
            "notification_id": LONG, "user_id": LONG, "channel": TEXT, "message": TEXT,
            "status": TEXT, "sent_at": STAMP,
        },
        required=("channel", "message", "status"),
        domains={"channel": ("sms", "email"), "status": ("sent", "failed")},
        parents={"user_id": "users"},
        defaults={"sent_at": WRITE_TIME},
    ),
    Table(
        "tickets",
        "ticket_id",
        {
            "ticket_id": LONG, "business_id": LONG, "created_by": LONG, "assigned_to": LONG,
            "status": TEXT, "category": TEXT, "notes": TEXT, "created_at": STAMP,
        },
        required=("status", "category"),
        domains={"status": ("open", "resolved", "escalated")},
        parents={"business_id": "businesses", "created_by": "users", "assigned_to": "users"},
        defaults={"created_at": WRITE_TIME},
    ),
    Table(
        "report_schedule",
        "schedule_id",
        {
            "schedule_id": LONG, "user_id": LONG, "frequency": TEXT, "report_type": TEXT,
            "parameters": TEXT, "next_run": STAMP,
        },
        required=("frequency", "report_type"),
        domains={"frequency": ("daily", "weekly", "monthly")},
        parents={"user_id": "users"},
        json=("parameters",),
    ),
)

TABLES = {table.name: table for table in _DEFINITIONS}
