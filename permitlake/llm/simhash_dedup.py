"""Operator 9: SimHash near-duplicates found with BK-trees.

A text's fingerprint has a bit set where over half of its shingle hashes have it. Two
fingerprints link at RADIUS or fewer differing bits, and the classes are the connected
components of these links.

The tree of all fingerprints would grow with the corpus, so it is split into shards. The 64
bits are cut into BLOCKS blocks. Two fingerprints within the radius agree in at least
BLOCKS - RADIUS of them, so they meet in the shard of one such choice of blocks and its
bits. Each shard has a BK-tree of its own: a child hangs at its integer Hamming distance
from the parent, and a search follows only edges within the radius of its own distance. A
shard above LARGE is split again by the same rule on the bits not fixed yet; after that 48
bits are fixed, so a tree never has more than 2**16 nodes, whatever the input.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitlake.llm.common import cut_lineage, encoded, pick, sized, small_batches

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCKS = 4
LARGE = 2048
BUCKET = 20_000  # shard rows that a task takes at a time, about

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text; 0 without words.

    Words are the runs of non-space bytes of the ASCII-lower-cased text. Shingles repeat as
    often as they occur; fewer words than a shingle are one shingle.
    """
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        joined = [b" ".join(words)]
    else:
        joined = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    hashes = b"".join([digest(s, SEED) for s in joined])  # big-endian
    planes = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    value = 0
    for plane in range(8):
        votes = np.bincount(planes[:, plane], minlength=256) @ _BITS
        byte = int(((votes * 2 > len(planes)) << np.arange(8)).sum())
        value = value << 8 | byte
    return value


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fingerprint (as a signed long) of every whole text; a null text is
    empty, but has a hash of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            values = np.array([fingerprint(t, shingle) for t in encoded(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values.view(np.int64))],
                names=["doc_id", "text_hash", "print"],
            )

    docs = pick(documents, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_hash bigint, print bigint")


class BKTree:
    """Fingerprints by distance: a node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, value: int, radius: int) -> list[int]:
        """All values within the radius, over edges that can lead to one."""
        found: list[int] = []
        stack = [0] if self.values else []
        while stack:
            node = stack.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(self.values[node])
            children = self.children[node]
            if children:
                for edge in range(distance - radius, distance + radius + 1):
                    child = children.get(edge)
                    if child is not None:
                        stack.append(child)
        return found

    def add(self, value: int) -> None:
        node = 0
        while node < len(self.values):
            distance = (self.values[node] ^ value).bit_count()
            if distance == 0:
                return
            following = self.children[node].get(distance)
            if following is None:
                self.children[node][distance] = len(self.values)
                break
            node = following
        self.values.append(value)
        self.children.append({})


def _choices(radius: int, blocks: int) -> list[tuple[int, ...]]:
    """The choices of blocks of which two fingerprints within the radius agree in one."""
    return list(itertools.combinations(range(blocks), blocks - radius))


def _mask(choice: tuple[int, ...], places: list[int], blocks: int) -> int:
    """The bits of the chosen blocks, of a fingerprint's given bit places."""
    cut = [places[i * len(places) // blocks : (i + 1) * len(places) // blocks] for i in range(blocks)]
    return sum(1 << place for block in choice for place in cut[block])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _masks(radius: int, blocks: int) -> tuple[list[int], list[list[int]]]:
    """The masks of the first cut, and for each of them those of the second cut."""
    first, second = [], []
    for choice in _choices(radius, blocks):
        mask = _mask(choice, list(range(64)), blocks)
        free = [i for i in range(64) if not mask >> i & 1]
        first.append(mask)
        second.append([mask | _mask(c, free, blocks) for c in _choices(radius, blocks)])
    return first, second


def _link_shards(rows: pd.DataFrame, radius: int, masks: list[int], deep: list[list[int]]) -> pd.DataFrame:
    """The links of the shards in these rows; each link from the first shard that has it."""
    rows = rows.sort_values(["cut", "deep", "key", "print"], ignore_index=True)
    shard = [rows[name].to_numpy() for name in ("cut", "deep", "key")]
    new = np.ones(len(rows), bool)
    new[1:] = np.any([s[1:] != s[:-1] for s in shard], axis=0)
    starts = np.flatnonzero(new)
    values = rows["print"].to_numpy().view(np.uint64).tolist()
    cuts, deeps = rows["cut"].tolist(), rows["deep"].tolist()
    left, right = [], []
    for start, end in zip(starts, [*starts[1:], len(rows)], strict=True):
        cut, inner = cuts[start], deeps[start]
        earlier = masks[:cut]
        earlier_deep = deep[cut][:inner] if inner >= 0 else []
        tree = BKTree()
        for value in values[start:end]:
            for other in tree.search(value, radius):
                differing = value ^ other
                # Shards that both are in, whether split or not: this is not the first one.
                if any(not differing & m for m in earlier) or any(
                    not differing & m for m in earlier_deep
                ):
                    continue
                left.append(_signed(other))
                right.append(_signed(value))
            tree.add(value)
    return pd.DataFrame({"a": np.array(left, np.int64), "b": np.array(right, np.int64)})


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs (a, b) of the distinct fingerprints `print` within the radius, each once."""
    masks, deep = _masks(radius, blocks)
    shards = F.array(*[
        F.struct(F.lit(i).alias("cut"), F.col("print").bitwiseAND(_signed(m)).alias("key"))
        for i, m in enumerate(masks)
    ])
    rows = distinct.select("print", F.inline(shards).alias("cut", "key"))
    sizes = rows.groupBy("cut", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = cut_lineage(rows.join(sizes, ["cut", "key"]))
    inner = F.array(*[
        F.array(*[
            F.struct(F.lit(j).alias("deep"), F.col("print").bitwiseAND(_signed(m)).alias("key"))
            for j, m in enumerate(deep[i])
        ])
        for i in range(len(masks))
    ])
    small = met.filter(F.col("n") <= LARGE).select("print", "cut", F.lit(-1).alias("deep"), "key")
    large = met.filter(F.col("n") > LARGE).select(
        "print", "cut", F.inline(F.element_at(inner, F.col("cut") + 1)).alias("deep", "key")
    )
    n_buckets = max(1, -(-met.count() // BUCKET))
    bucket = F.pmod(F.xxhash64("cut", "deep", "key"), F.lit(n_buckets))
    return (
        small.union(large)
        .withColumn("bucket", bucket)
        .groupBy("bucket")
        .applyInPandas(lambda r: _link_shards(r, radius, masks, deep), "a bigint, b bigint")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): node and its smallest reachable node.

    Alternating large-star and small-star steps: every node hands its smallest neighbour to
    the others, until nothing changes; the number of rounds grows with the logarithm of the
    longest path. The lineage is cut after every round.
    """
    edges = edges.filter(F.col("a") != F.col("b"))
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
        )
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(least, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("a"), F.col("e.m").alias("b"))
            .filter(F.col("a") != F.col("b"))
            .distinct()
        )
        edges = cut_lineage(small)
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before:
            return edges.groupBy("a").agg(F.min("b").alias("b")).select(
                F.col("a").alias("node"), F.col("b").alias("component")
            )
        before = state


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """print, component (any one print of the class) and first, the smallest doc_id that has the
    print: a row for each distinct fingerprint."""
    distinct = cut_lineage(prints.groupBy("print").agg(F.min("doc_id").alias("first")))
    linked = components(links(distinct.select("print"), radius))
    return distinct.join(
        linked.select(F.col("node").alias("print"), "component"), "print", "left"
    ).select("print", "first", F.coalesce("component", "print").alias("component"))


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links lead to. Null and empty texts have the
    fingerprint zero and link like any other. Equal fingerprints are one node, so copies are
    never paired. A repeated doc_id gives a row each time; a null doc_id keeps its row, with
    the component of its fingerprint, null if no document there has an id.
    """
    prints = cut_lineage(fingerprints(documents, shingle))
    member = _classes(prints, radius)
    least = member.groupBy("component").agg(F.min("first").alias("component_id"))
    of_print = member.join(least, "component").select("print", "component_id")
    return prints.join(of_print, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of `documents`, all columns, with one document of each class of duplicates.

    The document of the smallest id stays; a missing id comes after all others. A document is an
    id with its text: texts of one id that are no duplicates are judged apart, and of several
    texts of the smallest id in a class, one stays. Of rows equal in id and text, the one whose
    other columns are smallest stays.
    """
    prints = cut_lineage(fingerprints(documents, shingle))
    classes = _classes(prints, radius).select("print", "component")
    texts = prints.distinct().join(classes, "print").select("component", "doc_id", "text_hash")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")
    first = texts.groupBy("component").agg(F.min(order).alias("kept"))
    is_kept = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash"))
    # A document is in one class, so what goes from one is not kept by another.
    gone = cut_lineage(
        texts.join(first, "component").filter(~is_kept)
        .select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    )
    repeated = cut_lineage(
        prints.groupBy("doc_id", "text_hash").count().filter("count > 1")
        .select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"))
    )
    names = documents.columns
    key, text = f"_{names.index('doc_id')}", f"_{names.index('text')}"
    plain = [f"_{i}" for i in range(len(names))]
    held = documents.toDF(*plain).withColumn("text_hash", F.xxhash64(text))
    is_gone = F.col(key).eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash"))
    kept = held.join(sized(gone), is_gone, "left_anti")
    is_repeated = F.col(key).eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))
    several = sized(repeated)
    single = kept.join(several, is_repeated, "left_anti").select(*plain)
    # Combined before the shuffle: one row per task and document.
    least = kept.join(several, is_repeated, "left_semi").groupBy(key, "text_hash").agg(
        F.min(F.struct(*plain)).alias("row")
    )
    return single.union(least.select("row.*").select(*plain)).toDF(*names)
