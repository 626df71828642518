"""Registry tables stored as Parquet directories, and their snapshots."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from permitlake.operators.keyed import conform
from permitlake.registry import Registry
from permitlake.schemas import DATE, MONTH, TABLES

MANIFEST = "manifest"
MANIFEST_SCHEMA = (
    "table_name string, row_count bigint, one decimal(30,0), other decimal(30,0), table_schema string"
)
SUMS = ("row_count", "one", "other")


def scan_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table under its fixed schema; no file is opened to infer one."""
    return _read(spark, f"{folder}/{name}", TABLES[name].schema)


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    # Columns that are partition folders would otherwise come last.
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def open_registry(spark: SparkSession, folder: str, names=tuple(TABLES)) -> Registry:
    by_month = {
        name: spark.read.schema(TABLES[name].schema.add(MONTH, DATE)).parquet(f"{folder}/{name}")
        for name in names if TABLES[name].month_of
    }
    return Registry(spark, {name: scan_table(spark, folder, name) for name in names}, by_month)


def with_folders(rows: DataFrame, name: str) -> tuple[DataFrame, tuple[str, ...]]:
    """The rows with the columns that name their storage folders, and these columns."""
    spec = TABLES[name]
    by = tuple(c for c in spec.partition_by if c in rows.columns)
    if spec.month_of in rows.columns:
        rows, by = rows.withColumn(MONTH, F.trunc(spec.month_of, "month")), (*by, MONTH)
    return rows, by


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files below a path, without reading them; for `session.tune`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.sum("length")).first()[0] or 0


def write_table(
    rows: DataFrame, path: str, name: str, mode: str = "errorifexists",
    sums: Observation | None = None,
) -> None:
    """Write rows of a table to a path: permits in one folder per year; payments, inspections
    and audit entries in one per month. `sums` gets the content sums of what is written.

    A table with folders is rebalanced first: the rows of a folder go to a few files, and
    a folder with very many rows is split among tasks.
    """
    columns = rows.columns
    rows, by = with_folders(rows, name)
    if by:
        rows = rows.hint("rebalance", *by)
    if sums is not None:
        # Right below the write, where every row passes once, also when a task is repeated.
        rows = rows.observe(sums, *_sums(columns))
    rows.write.mode(mode).partitionBy(*by).parquet(path)


def append_rows(rows: DataFrame, folder: str, name: str, now: dt.datetime) -> DataFrame:
    """Append rows to a stored table, with defaults for the columns they lack; returns
    the table after it."""
    write_table(conform(rows, name, now), f"{folder}/{name}", name, mode="append")
    return scan_table(rows.sparkSession, folder, name)


def export_snapshot(registry: Registry, folder: str, now: dt.datetime) -> str:
    """Write every table below `<folder>/<timestamp>`; the manifest comes last, so that a
    snapshot without one is known to be incomplete. It holds the content sums of each table,
    taken while the table is written: each is read once. Returns the path."""
    path = f"{folder}/{now:%Y%m%d_%H%M%S}"
    entries = []
    for name in registry.names():
        rows, sums = registry.table(name), Observation()
        write_table(rows, f"{path}/{name}", name, sums=sums)
        found = sums.get
        # Without rows there is nothing to add up.
        hashes = [Decimal(found[c] or 0) for c in SUMS[1:]]
        entries.append((name, found[SUMS[0]], *hashes, rows.schema.json()))
    manifest = registry.spark.createDataFrame(entries, MANIFEST_SCHEMA)
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/{MANIFEST}")
    return path


def _sums(columns: list[str]) -> list[Column]:
    """The number of rows, and two sums of row hashes: equal for tables with equal rows,
    whatever their order and files."""
    one = F.xxhash64(*columns).cast("decimal(20,0)")
    other = F.xxhash64(F.lit(1), *reversed(columns)).cast("decimal(20,0)")
    return [F.count(F.lit(1)).alias("row_count"), F.sum(one).alias("one"), F.sum(other).alias("other")]


def content_sums(rows: DataFrame) -> DataFrame:
    """One row that equal tables share: see `_sums`."""
    return rows.agg(*_sums(rows.columns)).na.fill(0)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/{MANIFEST}")


def _stored_tables(spark: SparkSession, path: str, manifest: list) -> dict[str, DataFrame]:
    return {
        e["table_name"]: _read(
            spark, f"{path}/{e['table_name']}", StructType.fromJson(json.loads(e["table_schema"]))
        )
        for e in manifest
    }


def compare_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Every table of a snapshot against its manifest: table_name, row_count (as stored now),
    written (rows, by the manifest) and equal, whether all content sums agree. Each table is
    scanned once, all in one job."""
    written = read_manifest(spark, path)
    tables = _stored_tables(spark, path, written.collect())  # one row per table
    found = reduce(DataFrame.unionByName, [
        content_sums(rows).withColumn("table_name", F.lit(name)) for name, rows in tables.items()
    ])
    pairs = found.alias("f").join(F.broadcast(written.alias("w")), "table_name")
    equal = reduce(Column.__and__, [F.col(f"f.{c}") == F.col(f"w.{c}") for c in SUMS])
    return pairs.select(
        "table_name", F.col("f.row_count").alias("row_count"),
        F.col("w.row_count").alias("written"), equal.alias("equal"),
    )


def restore_snapshot(spark: SparkSession, path: str) -> Registry:
    """The tables of a snapshot, after their content was compared with the manifest."""
    wrong = compare_snapshot(spark, path).filter(~F.col("equal")).collect()
    if wrong:
        raise ValueError("; ".join(
            f"{r.table_name}: {r.row_count} rows, manifest says {r.written}"
            if r.row_count != r.written else f"{r.table_name}: other rows than the manifest's"
            for r in wrong
        ))
    return Registry(spark, _stored_tables(spark, path, read_manifest(spark, path).collect()))
