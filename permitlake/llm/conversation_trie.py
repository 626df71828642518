"""Operator 12: the prefix trie of conversations, by a skeleton of splitter paths.

A conversation is a path: 16 bytes of the SHA-256 of each turn's role and text, one after the
other, so that a shared beginning of two conversations is a common prefix of their paths, and
the members of a node stand together when paths are sorted. Sampled conversations split that
order into shards. A node whose members lie in more than one shard is a prefix of a splitter
between them; these nodes are the skeleton, a trie that is broadcast. Each shard is sorted and
scanned once: it finishes all nodes that are not in the skeleton, and for skeleton nodes it
returns what its own rows add. Those parts are summed up per node, and then from the leaves of
the skeleton to the root.

Splitters are pairs of path and id, so a path that very many conversations share is cut between
their ids. Splitters decide only where shards end; any others give the same result.

What is held: a shard's scan keeps the open path and the finished children of open nodes, which
are rows of that shard; the skeleton has at most SKELETON_BYTES of path. A conversation is one
row, at 28 bytes a turn while its turns are ordered.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permitlake.llm.common import cut_lineage, pick

KEY = 16  # bytes of a turn in a path
GROUP = 100  # conversations that share the first turns of the one whose id GROUP divides
HEADS = 6  # 0 to HEADS - 1 turns are taken from it
SHARD_BYTES = 32 << 20
SKELETON_BYTES = 64 << 20
SAMPLES = 16  # conversations looked at for each splitter
CHUNK_BYTES = 1 << 16
TURNS_PER_TASK = 2_000_000

_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
COLUMNS = f"{_NODE}, ends_sha256 string"
_FINISHED, _PART, _ENDS = 0, 1, 2
# node: the skeleton node that a part or a chunk belongs to, or a finished node's parent;
# -1 where that is no skeleton node. data: a digest, or a chunk of the list of ids.
_SCANNED = f"kind int, node bigint, shard int, chunk bigint, {_NODE}, chars bigint, data binary"


def rebuild(conversations: DataFrame) -> DataFrame:
    """conv_id, path, chars (code points of the texts along the path), one row per conv_id: the
    first h turns of conversation c - c % 100, then c's own after its first h, h = crc32(c) % 6.

    Turns go by number, a missing number first; equal numbers by the digest of role and text, so
    repeated rows are repeated turns. Null role or text is empty. Rows without an id belong to no
    conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = pick(conversations, "conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull())
    conv = F.col("conv_id").cast("bigint")
    turns = rows.select(
        conv.alias("conv_id"), (conv - conv % GROUP).alias("head_id"),
        F.struct(
            "turn", F.unhex(F.substr(digest, F.lit(1), F.lit(2 * KEY))).alias("key"),
            F.length(text).cast("bigint").alias("chars"),
        ).alias("turn"),
    )
    spark = conversations.sparkSession
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        -(-conversations.count() // TURNS_PER_TASK),
    )
    # One shuffle, by the group, serves both steps.
    own = turns.repartition(parts, "head_id").groupBy("head_id", "conv_id").agg(
        F.sort_array(F.collect_list("turn")).alias("own")
    )
    is_head = F.col("conv_id") == F.col("head_id")
    first = F.first(F.when(is_head, F.slice("own", 1, HEADS - 1)), ignorenulls=True)
    headed = own.withColumn("head", first.over(Window.partitionBy("head_id"))).withColumn(
        "h", F.expr(f"cast(crc32(cast(conv_id as string)) % {HEADS} as int)")
    )
    none = F.slice("own", F.lit(1), F.lit(0))
    taken = F.concat(
        F.coalesce(F.slice("head", F.lit(1), F.col("h")), none),
        F.slice("own", F.col("h") + 1, F.size("own")),
    )
    return headed.select("conv_id", taken.alias("turns")).select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")).alias("path"),
        F.transform("turns", lambda t: t["chars"]).alias("chars"),
    )


class Skeleton:
    """The trie of splitter paths. Children have larger numbers than their parents; 0 is the root."""

    def __init__(self, paths: list[bytes]):
        self.children: dict[tuple[int, bytes], int] = {}
        self.parents, self.depths = [-1], [0]
        for path in paths:
            node = 0
            for at in range(0, len(path), KEY):
                step = (node, path[at : at + KEY])
                if step not in self.children:
                    self.children[step] = len(self.parents)
                    self.parents.append(node)
                    self.depths.append(self.depths[node] + 1)
                node = self.children[step]


def split(paths: DataFrame, least: int) -> list[tuple[bytes, int]]:
    """Splitters, ascending: as many as the paths' size asks for, `least` shards if they are few,
    and no more than SKELETON_BYTES hold."""
    total, longest, count = paths.agg(
        F.sum(F.length("path") + 64), F.max(F.length("path")), F.count(F.lit(1))
    ).first()
    if not count:
        return []
    held = SKELETON_BYTES // (SAMPLES * max(longest, KEY))
    shards = max(1, min(max(least, -(-total // SHARD_BYTES)), held))
    share = min(1.0, SAMPLES * shards / count)
    looked_at = F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = paths.filter(looked_at).select("path", "conv_id").limit(2 * SAMPLES * shards)
    found = sorted((bytes(r["path"]), r["conv_id"]) for r in sample.collect())
    at = [len(found) * k // shards for k in range(1, shards)]
    return sorted({found[k] for k in at if found})


class _Open:
    """A node on the open path, with what has been seen of it in this shard."""

    __slots__ = ("chars", "children", "depth", "digest", "ends", "ends_bytes", "chunks",
                 "leaves", "least", "n", "node", "pending", "saved")

    def __init__(self, depth: int, chars: int, node: int):
        self.depth, self.chars, self.node = depth, chars, node
        self.n = self.children = self.leaves = self.saved = self.ends_bytes = self.chunks = 0
        self.least = self.digest = None
        self.ends: list[bytes] = []
        self.pending: list[tuple] = []


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share."""
    low, high = 0, min(len(a), len(b)) // KEY
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * KEY] == b[: middle * KEY]:
            low = middle
        else:
            high = middle - 1
    return low


class _Scan:
    """One shard's rows in order; `out` gets its finished nodes, parts and chunks."""

    def __init__(self, shard: int, skeleton: Skeleton):
        self.shard, self.skeleton, self.out = shard, skeleton, []
        self.open, self.path = [_Open(0, 0, 0)], b""

    def add(self, path: bytes, conv_id: int, chars: list[int]) -> None:
        kept = _common(path, self.path)
        self.close(kept + 1)
        for depth in range(kept + 1, len(path) // KEY + 1):
            above = self.open[-1].node
            step = path[(depth - 1) * KEY : depth * KEY]
            node = self.skeleton.children.get((above, step), -1) if above >= 0 else -1
            self.open.append(_Open(depth, chars[depth - 1], node))
        self.path, last, text = path, self.open[-1], str(conv_id).encode()
        last.n += 1
        last.least = conv_id if last.least is None else min(conv_id, last.least)
        if last.node >= 0:
            last.ends.append(text)
            last.ends_bytes += len(text) + 1
            if last.ends_bytes >= CHUNK_BYTES:
                self.chunk(last)
        elif last.digest is None:
            last.digest = hashlib.sha256(text)
        else:
            last.digest.update(b"," + text)

    def chunk(self, node: _Open) -> None:
        if node.ends:
            self.out.append((_ENDS, node.node, self.shard, node.chunks, *[None] * 8, b",".join(node.ends)))
            node.ends, node.ends_bytes, node.chunks = [], 0, node.chunks + 1

    def close(self, count: int) -> None:
        """Close all but the first `count` open nodes."""
        while len(self.open) > count:
            node = self.open.pop()
            above = self.open[-1] if self.open else None
            if above:
                above.n += node.n
                above.least = node.least if above.least is None else min(above.least, node.least)
            if node.node >= 0:
                self.chunk(node)
                self.out.append((
                    _PART, node.node, self.shard, None, node.least, node.depth, None, node.n,
                    node.children, node.leaves, node.saved, node.chars, None,
                ))
                continue
            for row in node.pending:
                self.out.append((_FINISHED, -1, self.shard, None, *row[:2], node.least, *row[2:]))
            node.leaves += not node.children
            node.saved += (node.n - 1) * node.chars
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
            digest = (node.digest or hashlib.sha256()).digest()
            row = (node.least, node.depth, node.n, node.children, node.leaves, node.saved, None, digest)
            if above.node < 0:
                above.pending.append(row)
            else:
                self.out.append(
                    (_FINISHED, above.node, self.shard, None, *row[:2], None, *row[2:])
                )


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


_SCANNED_ARROW = pa.schema(
    [("kind", pa.int32()), ("node", pa.int64()), ("shard", pa.int32())]
    + [(c, pa.int64()) for c in (
        "chunk", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", "chars",
    )]
    + [("data", pa.binary())]
)


def _scan_shards(spark: SparkSession, paths: DataFrame, splitters: list[tuple[bytes, int]]) -> DataFrame:
    known = spark.sparkContext.broadcast((splitters, Skeleton([path for path, _ in splitters])))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = known.value[0]
        for batch in batches:
            pairs = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
            shards = pa.array([bisect.bisect_right(ends, pair) for pair in pairs], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [shards, *batch.columns], names=["shard", *batch.schema.names]
            )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton, open_shard = known.value[1], None
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("shard", "path", "conv_id", "chars")], strict=True)
            for shard, path, conv_id, chars in rows:
                if open_shard is None or open_shard.shard != shard:
                    if open_shard:
                        open_shard.close(0)
                        yield from flush(open_shard)
                    open_shard = _Scan(shard, skeleton)
                open_shard.add(path, conv_id, chars)
                if len(open_shard.out) >= 10_000:
                    yield from flush(open_shard)
        if open_shard:
            open_shard.close(0)
            yield from flush(open_shard)

    def flush(shard: _Scan) -> Iterator[pa.RecordBatch]:
        if shard.out:
            yield _batches(shard.out, _SCANNED_ARROW)
            shard.out = []

    dealt = paths.select("conv_id", "path", "chars").mapInArrow(
        deal, "shard int, conv_id bigint, path binary, chars array<bigint>"
    )
    return (
        dealt.repartitionById(len(splitters) + 1, "shard")
        .sortWithinPartitions("shard", "path", "conv_id")
        .mapInArrow(scan, _SCANNED)
    )


def _ends(chunks: DataFrame) -> DataFrame:
    """The digest of each skeleton node's list of ids, whose chunks are streamed in order."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            for own, data in zip(batch.column("node").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if own == node:
                    digest.update(b"," + data)
                    continue
                if node is not None:
                    yield pa.RecordBatch.from_pydict({"node": [node], "data": [digest.digest()]})
                node, digest = own, hashlib.sha256(data)
        if node is not None:
            yield pa.RecordBatch.from_pydict({"node": [node], "data": [digest.digest()]})

    ordered = chunks.select("node", "shard", "chunk", "data").repartition("node").sortWithinPartitions(
        "node", "shard", "chunk"
    )
    return ordered.select("node", "data").mapInArrow(digests, "node bigint, data binary")


def _reduce(spark: SparkSession, scanned: DataFrame, skeleton: Skeleton) -> DataFrame:
    """The skeleton's nodes: the shards' parts added up, then subtrees from the leaves upwards.

    The second step is one task: it has one row per skeleton node, however many conversations
    there are, and SKELETON_BYTES bounds those.
    """
    parts = scanned.filter(F.col("kind") == _PART).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("chars").alias("chars"),
    )
    ends = _ends(scanned.filter(F.col("kind") == _ENDS))
    rows = parts.join(ends, "node", "left")
    parents = spark.sparkContext.broadcast(skeleton.parents)
    nodes = pa.schema(
        [(c, pa.int64()) for c in ("node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")]
        + [("data", pa.binary())]
    )

    def upwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below: dict[int, list[int]] = {}  # children, leaves, saved of skeleton children
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                children, leaves, saved = below.pop(r["node"], (0, 0, 0))
                children += r["n_children"]
                leaves += r["n_leaves"] if children else 1
                saved += r["saved_tokens"] + (r["n_convs"] - 1) * r["chars"]
                parent = parents.value[r["node"]]
                above = below.setdefault(parent, [0, 0, 0])
                for k, more in enumerate((1, leaves, saved)):
                    above[k] += more
                out.append((
                    r["node"], parent, r["conv_id"], r["depth"], r["n_convs"], children, leaves,
                    saved, r["data"] or hashlib.sha256().digest(),
                ))
            if out:
                yield _batches(out, nodes)

    return (
        rows.repartition(1).sortWithinPartitions(F.desc("node"))
        .mapInArrow(upwards, "node bigint, parent bigint, conv_id bigint, depth bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, data binary")
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie, in the columns of COLUMNS: conv_id (the smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (over the
    subtree, code points that the members share with a smaller one), ends_sha256.

    An empty table has no conversation and no node, not even a root. See `rebuild` for nulls,
    ties and repeated rows.
    """
    spark = conversations.sparkSession
    paths = cut_lineage(rebuild(conversations))
    splitters = split(paths, int(spark.conf.get("spark.sql.shuffle.partitions")))
    scanned = cut_lineage(_scan_shards(spark, paths, splitters))
    skeleton = cut_lineage(_reduce(spark, scanned, Skeleton([path for path, _ in splitters])))
    plain = [c.split()[0] for c in _NODE.split(", ")]
    # Bounded by SKELETON_BYTES.
    above = F.broadcast(skeleton.select(F.col("node").alias("above"), F.col("conv_id").alias("above_conv_id")))
    finished = scanned.filter(F.col("kind") == _FINISHED).join(
        above, F.col("node") == F.col("above"), "left"
    ).withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_conv_id"))
    inner = skeleton.join(above, F.col("parent") == F.col("above"), "left").withColumn(
        "parent_conv_id", F.col("above_conv_id")
    )
    columns = [*plain, F.lower(F.hex("data")).alias("ends_sha256")]
    return finished.select(*columns).unionByName(inner.select(*columns))
