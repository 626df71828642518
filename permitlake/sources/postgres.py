"""Registry tables in PostgreSQL: read in parallel key ranges, appended to in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitlake.operators.keyed import exact
from permitlake.registry import Registry
from permitlake.schemas import TABLES

FETCH_ROWS = 10_000
BATCH_ROWS = 5_000


def range_options(table: str, low: int, high: int, partitions: int) -> dict[str, str]:
    """Reader options that split the table into key ranges; rows outside the bounds fall
    into the first and last range, so none is lost."""
    return {
        "dbtable": table,
        "partitionColumn": TABLES[table].key,
        "lowerBound": str(low),
        "upperBound": str(max(high, low + 1)),
        "numPartitions": str(partitions),
        "fetchsize": str(FETCH_ROWS),
        "preferTimestampNTZ": "true",
    }


def read_table(spark: SparkSession, table: str, partitions: int, **connection: str) -> DataFrame:
    """One table in the types of its schema; `connection` holds the reader's url, user,
    password and driver."""
    spec = TABLES[table]
    limits = f"SELECT min({spec.key}) AS low, max({spec.key}) AS high FROM {table}"
    bounds = spark.read.format("jdbc").options(**connection).option("query", limits)
    low, high = bounds.load().first()  # one row
    reader = spark.read.format("jdbc").options(**connection)
    rows = reader.options(**range_options(table, low or 0, high or 0, partitions)).load()
    return rows.select(*(
        exact(F.col(c), rows.schema[c].dataType, kind, f"{table}.{c}").alias(c)
        for c, kind in spec.columns.items()
    ))


def write_options(table: str, partitions: int) -> dict[str, str]:
    """Writer options: a bounded number of connections, rows sent in batches. Text is sent
    as of unspecified type, so that the database reads it into its JSON columns."""
    return {
        "dbtable": table,
        "numPartitions": str(partitions),
        "batchsize": str(BATCH_ROWS),
        "isolationLevel": "READ_COMMITTED",
        "stringtype": "unspecified",
    }


def append_table(rows: DataFrame, table: str, partitions: int, **connection: str) -> None:
    """Append rows to a table of the database. Columns the rows lack get the database's own
    defaults, also the serial key. A task that is run again may send its rows twice, so
    rows should have a key that is unique in the database."""
    unknown = [c for c in rows.columns if c not in TABLES[table].columns]
    if unknown:
        raise ValueError(f"{table} has no column {unknown}")
    writer = rows.write.format("jdbc").options(**connection)
    writer.options(**write_options(table, partitions)).mode("append").save()


def open_database(
    spark: SparkSession, partitions: int, names=tuple(TABLES), **connection: str
) -> Registry:
    tables = {name: read_table(spark, name, partitions, **connection) for name in names}
    return Registry(spark, tables)
