"""Operator 4: SimHash fingerprints of documents, and search within a Hamming radius.

Each distinct word votes with its weight on every bit, for or against as its hash says; a
bit is set where the votes for it win. The weight of a word is damped by its repeats and
grows with its length: short words are the common ones of a language and tell least.

Search uses permuted block tables: the BITS bits are cut into radius + 1 blocks, and table i
holds the fingerprints with block i in front as its key. Fingerprints within the radius agree
in at least one block, so a lookup in every table finds them all; the distance is checked.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitlake.llm.common import pick, small_batches, text_list

BITS = 256
RADIUS = 7
UNIT = 16  # votes of a weight of one; whole votes add up exactly in any order


def fingerprint(text: str) -> bytes:
    """The fingerprint as BITS / 8 bytes; all zero for a text without words."""
    import xxhash

    counts: dict[bytes, int] = {}
    for word in text.encode().lower().split():
        counts[word] = counts.get(word, 0) + 1
    if not counts:
        return bytes(BITS // 8)
    digest = xxhash.xxh3_128_digest
    hashes = b"".join([digest(w, 1) + digest(w, 2) for w in counts])
    votes = np.array([round(UNIT * (1 + math.log(n)) * len(w)) for w, n in counts.items()], float)
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, BITS // 8), axis=1)
    return np.packbits(2 * (votes @ bits) > votes.sum()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of bits on which two fingerprints agree."""
    differing = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return 1 - differing.bit_count() / BITS


def half_replaced(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _buckets(docs: DataFrame, n: int) -> tuple[list[float], list, dict[int, int]]:
    """Bounds of n id ranges, the first id of each that has rows, and the range before it.

    At most n numbers each, n being the number of shuffle partitions.
    """
    cuts = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = [-math.inf, *sorted({float(c) for c in cuts}), math.inf]
    placed = _bucketed(docs.select("doc_id"), bounds)
    firsts = placed.groupBy("bucket").agg(F.min(F.struct("doc_id")).alias("first")).collect()
    firsts = sorted((int(r["bucket"]), r["first"]["doc_id"]) for r in firsts)
    before = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
    return bounds, [first for _, first in firsts], before


def _bucketed(docs: DataFrame, bounds: list[float]) -> DataFrame:
    if len(bounds) < 3:
        return docs.withColumn("bucket", F.lit(0))
    place = Bucketizer(splits=bounds, inputCol="place", outputCol="bucket")
    lowest = F.lit(-1.7e308)  # a missing id comes before all others
    return place.transform(
        docs.withColumn("place", F.coalesce(F.col("doc_id").cast("double"), lowest))
    ).drop("place").withColumn("bucket", F.col("bucket").cast("int"))


def with_following(documents: DataFrame) -> DataFrame:
    """Documents in partitions where each one is followed by the next by ascending id.

    Ids are cut into ranges; the first document of a range is also sent to the range before
    it as `extra` (for the very first: to the last range). Texts are shuffled once.
    """
    docs = pick(documents, "doc_id", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds, firsts, before = _buckets(docs, n)
    previous = F.array(*[F.lit(before.get(b, -1)) for b in range(len(bounds) - 1)])
    is_first = F.lit(False)
    if any(f is None for f in firsts):
        is_first = F.col("doc_id").isNull()
    known = [f for f in firsts if f is not None]
    if known:
        is_first = is_first | F.coalesce(F.col("doc_id").isin(known), F.lit(False))
    own = F.struct(F.lit(False).alias("extra"), F.col("bucket").alias("range"))
    copy = F.struct(
        F.lit(True).alias("extra"), F.element_at(previous, F.col("bucket") + 1).alias("range")
    )
    spread = F.when(is_first, F.array(own, copy)).otherwise(F.array(own))
    return (
        _bucketed(docs, bounds)
        .select("doc_id", "text", F.inline(spread).alias("extra", "range"))
        .repartitionById(n, F.col("range"))
        .sortWithinPartitions("range", "extra", "doc_id", "text")
        .select("doc_id", "text", "extra", "range")
    )


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has its last half replaced by the head of the next document by ascending
    doc_id; after the last document comes the first. Null texts are empty; an empty text has
    the fingerprint zero. A null id sorts first; rows of one id are in order of their text,
    and only one of equal rows that begin a range follows the range before it. A single
    document follows itself.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in small_batches(batches, "text"):
            rows = []
            ids, extras = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            ranges = batch.column(3).to_pylist()
            for doc_id, text, extra, place in zip(ids, text_list(batch), extras, ranges, strict=True):
                if held and held[4]:
                    held = None  # the range is done; this begins another, or is one more copy
                    if extra:
                        continue
                elif extra and held is None:
                    continue
                own = fingerprint(text)
                if held:
                    before_id, before, before_print, before_place, _ = held
                    edited = half_replaced(before, text)
                    edited_print = fingerprint(edited)
                    rows.append((
                        before_id, len(before), hashlib.sha256(edited.encode()).hexdigest(),
                        before_print.hex(), edited_print.hex(),
                        likeness(before_print, edited_print), likeness(before_print, own),
                    ))
                held = (doc_id, text, own, place, extra)
            if rows:
                columns = zip(*rows, strict=True)
                kinds = [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint",
                           "edited_fingerprint", "near_edited", "near_next"],
                )

    ordered = with_following(documents)
    kind = ordered.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(
        run,
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )


def _tables(prints: DataFrame, column: str, radius: int) -> DataFrame:
    """The distinct fingerprints once per table, under the table's block of hex digits."""
    digits, blocks = BITS // 4, radius + 1
    cuts = [i * digits // blocks for i in range(blocks + 1)]
    entries = F.array(*[
        F.struct(F.lit(i).alias("table"), F.substring(column, cuts[i] + 1, cuts[i + 1] - cuts[i]).alias("key"))
        for i in range(blocks)
    ])
    return prints.select(column).distinct().select(column, F.inline(entries).alias("table", "key"))


def _distance(a: str, b: str):
    """Hamming distance of two hex fingerprints, 15 digits at a time."""
    total = F.lit(0)
    for start in range(0, BITS // 4, 15):
        parts = [F.conv(F.substring(c, start + 1, 15), 16, 10).cast("bigint") for c in (a, b)]
        total = total + F.bit_count(parts[0].bitwiseXOR(parts[1]))
    return total


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs (query, found, distance) of distinct fingerprints within the radius.

    Both tables have the hex column `fingerprint`; null ones are in no pair. Equal
    fingerprints are one, so copies are never paired with each other; join the documents
    back by their fingerprint.
    """
    asked = _tables(queries.select(F.col("fingerprint").alias("query")).dropna(), "query", radius)
    held = _tables(prints.select(F.col("fingerprint").alias("found")).dropna(), "found", radius)
    distance = _distance("query", "found")
    return (
        asked.join(held, ["table", "key"])
        .select("query", "found", distance.cast("int").alias("distance"))
        .filter(F.col("distance") <= radius)
        .distinct()
    )
