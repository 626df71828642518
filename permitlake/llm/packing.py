"""Operator 1: vector bin packing of token pieces by the dot-product heuristic.

An item has a size in several dimensions: tokens, segments, loss-bearing tokens. A sequence
(bin) has a limit in each. Bins are filled one after the other: of all items that still fit,
the one whose weighted size has the largest dot product with the room left comes next, so
that a bin with much room in a scarce dimension draws the items that need it.

Items are dealt by a hash over blocks of about BLOCK items; a block is packed by one task in
memory that does not depend on the input, and leaves at most a few open bins.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitlake.llm.common import pick, small_batches, text_list

BLOCK = 8192
CAPACITY = 2048
MAX_SEGMENTS = 256
END_ID = 1


def place(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The bin of every row of `sizes`; an item above a limit has a bin of its own.

    Equal sizes are one row with a count, so a step costs the number of distinct sizes.
    Ties go to the first size in ascending order: the result depends on the sizes alone.
    """
    bins = np.full(len(sizes), -1, dtype=np.int64)
    if not len(sizes):
        return bins
    unique, inverse, counts = np.unique(
        sizes, axis=0, return_inverse=True, return_counts=True
    )
    members = np.split(np.argsort(inverse.ravel(), kind="stable"), np.cumsum(counts)[:-1])
    left = counts.copy()
    share = unique / limits
    weight = share.T @ counts
    weighted = share * (weight / max(weight.sum(), 1e-9))
    current = 0
    alive = np.arange(len(unique))
    while len(alive):
        room = limits.astype(np.int64).copy()
        taken = False
        while True:
            fits = alive[(unique[alive] <= room).all(axis=1)]
            if len(fits) == 0:
                if taken:
                    break
                fits = alive[:1]
            best = fits[np.argmax(weighted[fits] @ (np.maximum(room, 0) / limits))]
            left[best] -= 1
            bins[members[best][left[best]]] = current
            room -= unique[best]
            taken = True
            if left[best] == 0:
                alive = alive[alive != best]
            if (room <= 0).any() or not len(alive):
                break
        current += 1
    return bins


def pack(items: DataFrame, limits: Mapping[str, int], n_items: int) -> DataFrame:
    """Give each item a sequence and its place there.

    `limits` maps size columns to the limit of a sequence; the first one is the length that
    offsets count. All columns of `items` are kept and `sequence_id`, `offset` are added; the
    caller keeps these two names free. A null size counts as 0. An empty table gives an
    empty one; repeated items are packed one by one. `n_items` only sets the number of
    blocks. The column `salt`, if there is one, deals equal rows to different blocks.
    """
    n_blocks = max(1, -(-n_items // BLOCK))
    names, caps = list(limits), np.array(list(limits.values()), dtype=np.int64)
    keep = [c for c in items.columns if c != "salt"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema if f.name != "salt")

    def pack_block(rows: pa.Table) -> pa.Table:
        # Any order will do, if it is the same when a lost task runs again.
        rows = rows.sort_by([(c, "ascending") for c in rows.column_names if c not in ("block", "ids")])
        block = rows["block"][0].as_py()
        columns = [rows[name].fill_null(0).to_numpy() for name in names]
        sizes = np.stack(columns, axis=1).astype(np.int64)
        bins = place(sizes, caps)
        order = np.argsort(bins, kind="stable")
        bins, lengths = bins[order], sizes[order, 0]
        before = np.cumsum(lengths) - lengths
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        offset = before - np.repeat(before[first], np.diff(first, append=len(bins)))
        packed = rows.take(pa.array(order)).select(keep)
        packed = packed.append_column("sequence_id", pa.array((block << 32) + bins))
        return packed.append_column("offset", pa.array(offset))

    block = F.pmod(F.xxhash64(*[c for c in items.columns if c != "ids"]), F.lit(n_blocks))
    return (
        items.withColumn("block", block)
        .groupBy("block")
        .applyInArrow(pack_block, f"{schema}, sequence_id bigint, offset bigint")
    )


def added_tokens(tokenizer: str) -> tuple[tuple[str, int], ...]:
    """The texts that a tokenizer file gives an id of their own, wherever they stand in a text."""
    with open(tokenizer, encoding="utf-8") as file:
        return tuple((t["content"], t["id"]) for t in json.load(file)["added_tokens"])


@functools.lru_cache(maxsize=2)
def _encoding(path: str, added: tuple[tuple[str, int], ...]):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=dict(added)
    )


def token_pieces(
    documents: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    added: tuple[tuple[str, int], ...] = (),
) -> DataFrame:
    """Token ids of every document, cut into pieces of at most `capacity` ids.

    A document is its ids and then `end_id`; a null or empty text is `end_id` alone. All
    pieces but the last are full. `vocabulary` is a rank file, readable on every executor;
    `added` are texts with ids of their own (`added_tokens`), taken before all others.
    Returns doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, salt.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary, added).encode_to_numpy
        seen = 0
        for batch in small_batches(batches, "text", 4 << 20):
            rows: list[tuple] = []
            doc_ids = batch.column(0).to_pylist()
            for doc_id, text in zip(doc_ids, text_list(batch), strict=True):
                ids = encode(text, allowed_special="all", disallowed_special=())
                ids = np.append(ids, end_id).astype("<u4")
                seen += 1
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    rows.append((doc_id, start, len(piece), piece.tobytes(), len(ids), seen % 64))
            columns = list(zip(*rows, strict=True))
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "salt"],
            )

    docs = pick(documents, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        cut,
        f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, salt int",
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, input_ids, segment lengths.

    A sequence has at most the limits of `pack` in pieces and ids, so a group is small.
    """
    pieces = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(pieces.alias("pieces"))
        .select(
            "sequence_id",
            F.array_join(F.transform("pieces", lambda p: F.hex(p["ids"])), "").alias("ids_hex"),
            F.transform("pieces", lambda p: p["length"]).alias("segments"),
        )
    )


def pack_documents(
    documents: DataFrame,
    vocabulary: str,
    with_ids: bool = False,
    added: tuple[tuple[str, int], ...] = (),
) -> DataFrame:
    """Pack whole documents: pieces with their digest, sequence and offset.

    Only digests are shuffled unless `with_ids` asks for the ids themselves.
    """
    pieces = token_pieces(documents, vocabulary, added=added).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        F.lit(1).cast("bigint").alias("segments"),
        (F.col("length") - 1).alias("loss_tokens"),
        *(["ids"] if with_ids else []), "salt",
    )
    limits = {"length": CAPACITY, "segments": MAX_SEGMENTS, "loss_tokens": CAPACITY - 1}
    # Pieces, at three bytes a token: only the number of blocks follows from it.
    tokens = F.coalesce(F.octet_length("text"), F.lit(0)) / 3 + 1
    count = pick(documents, "text").agg(F.sum(F.ceil(tokens / CAPACITY))).first()[0] or 0
    return pack(pieces, limits, int(count))
