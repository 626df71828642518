"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from permitlake.session import shared_dir

# Word bytes are everything but these: space, tab, line feed, vertical tab, form feed,
# carriage return. bytes.split() and bytes.lower() follow the same ASCII-only rules.
WORD = r"[^\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Their Python workers import the functions that operators run there. Where the package is
    installed on all machines, theirs and this are the same.
    """
    context = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    if context.applicationId in _SHIPPED or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="permitlake-")) / "permitlake.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for file in sorted(package.rglob("*.py")):
            target.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(frame: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """The named columns alone, found by exact spelling.

    Other columns may have any name, also one that differs by case only or that an
    operator uses for its results. `renamed` maps new names to columns of the frame.
    """
    wanted = dict.fromkeys(names) | renamed
    places = {new: frame.columns.index(old or new) for new, old in wanted.items()}
    plain = frame.toDF(*[f"_{i}" for i in range(len(frame.columns))])
    return plain.select(*[F.col(f"_{i}").alias(new) for new, i in places.items()])


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; -1 for a missing id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % modulus, F.lit(-1)).cast("int")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; see `session.shared_dir`."""
    return shared_dir(spark)


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Computed once and kept in the shared folder, where any executor can read it again."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def text_list(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column of a batch; a null is the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def encoded(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The same texts as UTF-8 bytes."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [t or b"" for t in column.to_pylist()]


def small_batches(
    batches: Iterator[pa.RecordBatch], name: str, size: int = 8 << 20
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `size` bytes of text, or one row.

    The bound is on what a task holds in memory at a time; every row is in one of them.
    """
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.fill_null(
            pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0
        ).to_pylist()
        start = held = 0
        for row, length in enumerate(lengths):
            if held and held + length > size:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += length
        if start < batch.num_rows:
            yield batch.slice(start)


# What one broadcast may have: rows, and bytes of their values.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def _value_bytes(field: StructField) -> Column:
    """About the bytes of a column's value, lists and texts by their content."""
    value, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (StringType, BinaryType)):
        own = F.octet_length(value)
    elif isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
        own = F.aggregate(value, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
    elif isinstance(kind, (ArrayType, StructType)):
        own = F.octet_length(F.to_json(F.array(value) if isinstance(kind, StructType) else value))
    else:
        own = F.lit(8)
    return F.coalesce(own, F.lit(0)).cast("bigint") + 8


def sized(frame: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if rows and bytes are counted to be few; as it is, to be shuffled,
    if not.

    The frame is read twice, so it should be cheap to read: a written or cut one.
    """
    per_row = functools.reduce(Column.__add__, [_value_bytes(f) for f in frame.schema])
    rows, held = frame.agg(F.count(F.lit(1)), F.coalesce(F.sum(per_row), F.lit(0))).first()
    return F.broadcast(frame) if rows <= limit and held <= size else frame


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """Kept as a compressed table in the shared folder, for rows too many to checkpoint.

    The table stays there until the folder is cleaned, as it may be read again at any time.
    """
    import uuid

    path = f"{shared_folder(frame.sparkSession)}/{purpose}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


# Documents of neighbouring ids make a chunk: what a task gathers about their words or
# passages is sent back to the same chunk, instead of to every row.
CHUNK_IDS = 4096


def chunk(doc_id: str = "doc_id") -> Column:
    """The chunk of an integer id; -1 for a missing one."""
    return F.coalesce(F.floor(F.col(doc_id) / CHUNK_IDS), F.lit(-1)).cast("bigint")
