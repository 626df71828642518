"""Registry tables in the session catalog."""

from __future__ import annotations

from pyspark.sql import SparkSession

from permitlake.registry import Registry
from permitlake.schemas import MONTH, TABLES
from permitlake.sources.parquet import with_folders


def open_tables(spark: SparkSession, database: str, names=tuple(TABLES)) -> Registry:
    stored = {name: spark.table(f"{database}.{name}") for name in names}
    by_month = {name: rows for name, rows in stored.items() if MONTH in rows.columns}
    return Registry(spark, {name: rows.drop(MONTH) for name, rows in stored.items()}, by_month)


def save_tables(registry: Registry, database: str) -> Registry:
    """Save the tables, those with folders by year or month; a folder with very many rows is
    split among tasks. Tables are not bucketed: a hot key would make its bucket a single task."""
    for name in registry.names():
        rows, by = with_folders(registry.table(name), name)
        if by:
            rows = rows.hint("rebalance", *by)
        writer = rows.write.format("parquet").mode("errorifexists")
        writer.partitionBy(*by).saveAsTable(f"{database}.{name}")
    return open_tables(registry.spark, database, registry.names())
