"""Compare a Spark result with a DuckDB oracle on the same Parquet files."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb


def open_oracle(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, Decimal):
        return str(value.normalize() + 0)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(frame, connection, sql: str) -> list[str]:
    """What differs; empty when names, types and all rows agree."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} against {sorted(names)}"]
    wanted = _rows(names, result.fetchall())
    found = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    problems = []
    if wanted != found:
        problems.append(
            f"{sum(found.values())} rows against {sum(wanted.values())}; "
            f"only here {list((found - wanted).items())[:2]}; "
            f"only there {list((wanted - found).items())[:2]}"
        )
    described = connection.execute(f"DESCRIBE {sql}").fetchall()
    kinds = {row[0]: row[1] for row in described}
    for name, kind in kinds.items():
        spark_kind = frame.schema[name].dataType.simpleString()
        if _kind(kind) != spark_kind:
            problems.append(f"type of {name}: {spark_kind} against {kind}")
    return problems


def _kind(duck: str) -> str:
    names = {
        "VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double",
        "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz",
    }
    return names.get(duck, duck.lower())
