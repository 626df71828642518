"""Small hand-made tables under the registry's schemas."""

from __future__ import annotations

import datetime as dt

from permitlake.registry import Registry
from permitlake.schemas import TABLES

NOW = dt.datetime(2024, 6, 15, 10, 30)


def frame(spark, table: str, rows: list[dict]):
    """Rows of a table; columns that a row leaves out are null."""
    spec = TABLES[table]
    unknown = {c for row in rows for c in row} - spec.columns.keys()
    assert not unknown, unknown
    values = [tuple(row.get(c) for c in spec.columns) for row in rows]
    return spark.createDataFrame(values, spec.schema)


def registry(spark, **tables) -> Registry:
    return Registry(spark, {n: frame(spark, n, tables.get(n, [])) for n in TABLES})


def business(i, **over):
    row = dict(
        business_id=i, owner_id=1, kra_pin=f"A{i:09d}Z", name=f"Shop {i}", category="Retail",
        size="Small", location="Town", ward="North", status="active",
        created_at=dt.datetime(2024, 1, 1) + dt.timedelta(days=i),
    )
    return {**row, **over}


def user(i, **over):
    row = dict(
        user_id=i, name=f"User {i}", email=f"u{i}@x.example", phone=f"+{i}",
        password_hash="h", role="officer", is_active=True, created_at=NOW,
    )
    return {**row, **over}
