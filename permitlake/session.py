"""Session settings the plans rely on, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


# Aim for the input of one shuffle task; it fits an executor's memory, with some spill.
TASK_BYTES = 512 * 2**20
# Bytes that one task reads from files, whose keys a task that counts them holds all at once: a
# share of the largest table, some two million keys at least and (as Spark has it) fifteen at most.
SHARES = 1024
LEAST_BYTES, MOST_BYTES = 16 * 2**20, 128 * 2**20


def tune(
    spark: SparkSession, shuffle_bytes: int | None = None, *, keys: bool = False
) -> SparkSession:
    """Turn on the adaptive rules the join plans are shaped for.

    With `forceOptimizeSkewedJoin`, a skewed sort-merge join is split even where a second
    join on the same key follows; Spark then adds one shuffle, only when skew is found.

    `shuffle_bytes`, the size of the largest table moved, raises the number of shuffle
    partitions so that each stays near TASK_BYTES; adaptive execution merges small ones. It
    also lowers what one task reads from files, and what partitions are merged to: Spark's own
    sizes hold ten million short keys. With `keys`, for plans that count every key of that
    table, there are as many partitions as tasks that read it.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    if shuffle_bytes:
        share = min(max(shuffle_bytes // SHARES, LEAST_BYTES), MOST_BYTES)
        wanted = -(-shuffle_bytes // (share if keys else TASK_BYTES))
        current = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.shuffle.partitions", str(max(wanted, current)))
        _lower(spark, "spark.sql.files.maxPartitionBytes", share)
        # Shuffled bytes are packed more tightly than stored ones.
        _lower(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", share // 2)
    return spark


def _lower(spark: SparkSession, setting: str, size: int) -> None:
    """Lower a setting in bytes; one that is lower already stays."""
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if as_bytes(spark.conf.get(setting)) > size:
        spark.conf.set(setting, f"{size}b")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share. On one machine, one below the warehouse
    if none is set; on a cluster that is an error, as the warehouse may be a local folder."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own, wherever it is stored."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
