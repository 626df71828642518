"""Operator 8: removal of repeated byte strings, by deep-shallow suffix sorting.

A byte goes if a string of WINDOW bytes that covers it also starts anywhere else. Equal
windows have equal minimisers: of the hashes of all GRAM-byte strings in a window, the
smallest (the first of several) stands at the same place in both. So the windows of a text
fall into runs with one anchor each, one for every 60 bytes or so, and only windows with the
same gram at the same distance from their anchor need be compared:

1. Count anchors by the hash of their gram and of their context, the bytes of all windows of
   the run. A gram that is nowhere else has no repeated window; a context that is also
   elsewhere has only repeated ones.
2. What is left are anchors that share a gram but not the context, mostly at the ends of
   repeated passages. Their suffixes, and their reversed prefixes, are sorted: multikey
   quicksort to a shallow depth, then blind tries for the groups that have that much in
   common. Two windows at one distance are equal if the common prefix of the suffixes and
   that of the reversed prefixes are long enough, so the common-prefix lengths of neighbours
   in the two orders tell the classes of equal windows at each distance.
3. The marks go back to the chunks of documents, where the texts are.

A gram with many contexts in one batch of documents is counted as one row there, before the
shuffle. Grams of more than CROWD contexts are not sorted in one task. Each chunk counts their
windows, by distance and digest, so that a window gives one row a chunk however many documents
have it; the counts are added up by grouping, and those above one go back to the chunks. The
result is the same.

Chunks are ranges of ids; a range of more than CHUNK_BYTES of text is split by a hash of its
rows, missing ids like any other range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permitlake.llm.common import (
    chunk, cut_lineage, encoded, pick, sized, small_batches, written,
)

WINDOW = 200
GRAM = 64
BEFORE = WINDOW - GRAM  # bytes of a window that can stand before its anchor
SHALLOW = 6  # words of 8 bytes that the quicksort looks at; tries order what is equal there
CROWD = 50_000
LOCAL = 8  # contexts of a gram in a batch, above which they are one row
BUCKET_BYTES = 16 << 20  # text whose contexts a task sorts, about
CHUNK_BYTES = 64 << 20  # text of a chunk, about, unless rows are equal
PIECE = 1 << 20  # bytes of a long text that are looked at together

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP = _powers(_BASE, PIECE + WINDOW + 1)
_DOWN = _powers(_INVERSE, PIECE + WINDOW + 1)


def _sliding(values: np.ndarray, width: int, pick_one: np.ufunc) -> np.ndarray:
    """The least or greatest of each `width` neighbours, by doubling."""
    out, held = values, 1
    while held * 2 <= width:
        out = pick_one(out[:-held], out[held:])
        held *= 2
    rest = width - held
    return pick_one(out[: len(out) - rest], out[rest:]) if rest else out


def _piece_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of a piece: the places of their anchors, one for each run, the gram
    hashes there, and the first window of every run."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    value = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[: n - GRAM + 1]
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    # The place in the low half makes the first of equal grams the smallest.
    low = np.uint64(0xFFFFFFFF)
    ranked = (value & ~low) | np.arange(len(value), dtype=np.uint64)
    place = (_sliding(ranked, WINDOW - GRAM + 1, np.minimum) & low).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return place[first], value[place[first]], first


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and gram hashes of a text's anchors, and the first and last window of each."""
    data = np.frombuffer(text, np.uint8)
    last = len(data) - WINDOW
    if last < 0:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
    found = []
    for start in range(0, last + 1, PIECE):
        place, value, first = _piece_anchors(data[start : start + PIECE + WINDOW - 1])
        found.append((place + start, value, first + start))
    place, value, first = (np.concatenate(x) for x in zip(*found, strict=True))
    # A run that two pieces share is one.
    new = np.diff(place, prepend=-1) > 0
    place, value, first = place[new], value[new], first[new]
    return place, value, first, np.append(first[1:] - 1, last)


def context_hash(text: bytes, place: int, first: int, last: int) -> int:
    """The hash of all bytes of a run's windows, and of the anchor's place in them."""
    import xxhash

    return xxhash.xxh3_64_intdigest(text[first : last + WINDOW], place - first) - (1 << 63)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, gram, context, n, kinds: equal contexts of a chunk, or, for grams of more than
    LOCAL contexts, all its contexts in one row of their number, with 0 for the context."""
    for batch in small_batches(batches, "text"):
        rows = []
        for number, text in zip(batch.column(1).to_pylist(), encoded(batch), strict=True):
            place, value, first, last = anchors(text)
            hashes = [
                context_hash(text, *run)
                for run in zip(place.tolist(), first.tolist(), last.tolist(), strict=True)
            ]
            rows.append((np.full(len(place), number), value.view(np.int64), np.array(hashes, np.int64)))
        numbers, grams, contexts = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((contexts, grams, numbers))
        keys = [numbers[order], grams[order], contexts[order]]
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        starts = np.flatnonzero(new)
        n, starts = np.diff(starts), starts[:-1]
        numbers, grams, contexts = (k[starts] for k in keys)
        # The same again for the grams of a chunk.
        new = np.ones(len(starts) + 1, bool)
        new[1:-1] = (numbers[1:] != numbers[:-1]) | (grams[1:] != grams[:-1])
        runs = np.flatnonzero(new)
        kinds = np.diff(runs)
        runs = runs[:-1]
        many = kinds > LOCAL
        single = ~np.repeat(many, kinds)
        total = np.add.reduceat(n, runs) if len(runs) else n
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([numbers[single], numbers[runs[many]]])),
                pa.array(np.concatenate([grams[single], grams[runs[many]]])),
                pa.array(np.concatenate([contexts[single], np.zeros(many.sum(), np.int64)])),
                pa.array(np.concatenate([n[single], total[many]]), pa.int64()),
                pa.array(np.concatenate([np.ones(single.sum(), np.int64), kinds[many]])),
            ],
            names=["chunk", "gram", "context", "n", "kinds"],
        )


# --- sorting ----------------------------------------------------------------------------


class BlindTrie:
    """Strings that agree in their beginning, in order.

    An inner node has only the place of the first byte in which its strings differ, and its
    branches; a search skips what lies between and one comparison at the leaf makes good.
    """

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: list | None = None  # [place, {byte: node}] or [-1, [numbers]]

    def _byte(self, number: int, place: int) -> int:
        text = self.strings[number]
        return text[place] if place < len(text) else -1

    def add(self, number: int) -> None:
        if self.root is None:
            self.root = [-1, [number]]
            return
        text, node = self.strings[number], self.root
        while node[0] >= 0:
            following = node[1].get(self._byte(number, node[0]))
            node = following if following is not None else next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        if other == text:
            node[1].append(number)
            return
        place = _common(text, other)
        above, node = None, self.root
        while 0 <= node[0] < place:
            above, node = node, node[1][self._byte(number, node[0])]
        if node[0] == place:
            node[1][self._byte(number, place)] = [-1, [number]]
            return
        inner = [place, {self._byte(number, place): [-1, [number]]}]
        below = node
        while below[0] >= 0:
            below = next(iter(below[1].values()))
        inner[1][self._byte(below[1][0], place)] = node
        if above is None:
            self.root = inner
        else:
            above[1][self._byte(number, above[0])] = inner

    def order(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out += node[1]
            else:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        return out


def _common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of the strings, and the common prefix of each with the one before.

    Multikey quicksort on words of 8 bytes: strings below, equal to and above a pivot word
    are parted, the equal ones go on with the next word. Groups still equal after SHALLOW
    words are put in order by a blind trie. No recursion, so depth is no limit.
    """
    n, width = len(strings), 8 * SHALLOW
    head = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), ">u8")
    words = head.reshape(n, SHALLOW).astype(np.uint64)
    order: list[int] = []
    stack = [(np.arange(n), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) <= 1:
            order += group.tolist()
        elif depth == SHALLOW:
            trie = BlindTrie(strings)
            for number in group.tolist():
                trie.add(number)
            order += trie.order()
        else:
            keys = words[group, depth]
            some = keys[:: max(1, len(keys) // 64)]
            pivot = np.partition(some, len(some) // 2)[len(some) // 2]
            stack.append((group[keys > pivot], depth))
            stack.append((group[keys == pivot], depth + 1))
            stack.append((group[keys < pivot], depth))
    # Zero padding may tie a string with a longer one that goes on with zero bytes: their
    # order is then that of the trie, which knows the lengths.
    common = [0] * n
    for i in range(1, n):
        common[i] = _common(strings[order[i - 1]], strings[order[i]])
    return np.array(order, np.int64), np.array(common, np.int64)


def repeated_windows(contexts: list[bytes], lefts: list[int], full: list[bool]) -> list[list[tuple[int, int]]]:
    """For each context, the byte ranges, from its anchor, that repeated windows cover.

    `lefts` has the place of the anchor in a context. A window `o` bytes before the anchor is
    repeated if another context has the same one there, or if its own context, being `full`,
    occurs more than once.
    """
    n = len(contexts)
    left = np.array(lefts, np.int64)
    right = np.array([len(c) for c in contexts], np.int64) - left
    suffixes = [c[k:] for c, k in zip(contexts, lefts, strict=True)]
    prefixes = [c[:k][::-1] for c, k in zip(contexts, lefts, strict=True)]
    by_right, common_right = deep_shallow(suffixes)
    by_left, common_left = deep_shallow(prefixes)
    twice = np.array(full, bool)
    marks = np.zeros((n, BEFORE + 1), bool)
    class_left, class_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(BEFORE + 1):
        valid = np.flatnonzero((left >= o) & (right >= WINDOW - o))
        if not len(valid):
            continue
        class_right[by_right] = np.cumsum(common_right < WINDOW - o)
        class_left[by_left] = np.cumsum(common_left < o)
        pairs = class_left[valid] * (n + 1) + class_right[valid]
        order = np.argsort(pairs)
        same = pairs[order][1:] == pairs[order][:-1]
        hit = np.zeros(len(pairs), bool)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        marks[valid, o] = hit | twice[valid]
    return [_ranges(row) for row in marks]


def _ranges(marks: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges from the anchor that windows at the marked distances cover."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return [
        (-(int(end) - 1), WINDOW - int(start)) for start, end in zip(edges[::2], edges[1::2], strict=True)
    ]


# --- documents --------------------------------------------------------------------------


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _result(doc_id, text: bytes, spans: list[tuple[int, int]]) -> tuple:
    kept, at, removed = hashlib.sha256(), 0, 0
    for start, end in spans:
        kept.update(text[at:start])
        at, removed = end, removed + end - start
    kept.update(text[at:])
    return doc_id, len(text), removed, len(spans), kept.hexdigest(), np.array(spans, "<i8").tobytes()


def _known(rows: pd.DataFrame) -> tuple[np.ndarray, dict]:
    """The distinct grams, sorted, and what is said of every gram and context."""
    grams = rows["gram"].to_numpy(np.int64)
    keys = zip(grams.tolist(), rows["context"].tolist(), strict=True)
    said = zip(rows["full"].tolist(), rows["shared"].tolist(), rows["crowd"].tolist(), strict=True)
    return np.unique(grams), dict(zip(keys, said, strict=True))


def _runs(text: bytes, grams: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """place, first, last, gram, context of the anchors whose gram is one of these."""
    place, value, first, last = anchors(text)
    own = value.view(np.int64)
    at = np.searchsorted(grams, own)
    known = grams[np.minimum(at, len(grams) - 1)] == own if len(grams) else np.zeros(len(own), bool)
    for p, a, b, gram in zip(*[x[known].tolist() for x in (place, first, last, own)], strict=True):
        yield p, a, b, gram, context_hash(text, p, a, b)


def _contexts(docs: pd.DataFrame, rows: pd.DataFrame) -> dict[tuple[int, int], list]:
    """Of a chunk, the contexts that share their gram with others: their bytes, the place of the
    anchor there, and whether all their windows are known to be repeated."""
    wanted: dict[tuple[int, int], list] = {}
    # What is said of a gram alone holds for all of its contexts in this chunk.
    grams, said = _known(rows)
    for text in docs["text"]:
        text = (text or "").encode()
        for place, first, last, gram, context in _runs(text, grams):
            state = said.get((gram, context)) or said.get((gram, 0))
            if state is None or not state[1]:
                continue
            seen = wanted.get((gram, context))
            if seen:
                seen[2] = True
            else:
                wanted[gram, context] = [text[first : last + WINDOW], place - first, state[0]]
    return wanted


def _to_sort(docs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The contexts of a chunk that share their gram with others: one row for each."""
    number = int(rows["chunk"].iloc[0]) if len(rows) else 0
    out = [
        (number, gram, context, data, left, full)
        for (gram, context), (data, left, full) in _contexts(docs, rows[rows["shared"] & ~rows["crowd"]]).items()
    ]
    return pd.DataFrame(out, columns=["chunk", "gram", "context", "data", "left", "full"])


def _windows(data: bytes, left: int) -> Iterator[tuple[int, bytes]]:
    """Of a context's windows the distance to the anchor, and a digest of the bytes."""
    import xxhash

    for at in range(len(data) - WINDOW + 1):
        yield left - at, xxhash.xxh3_128_digest(data[at : at + WINDOW])


def _count_windows(docs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Of a chunk, the windows of crowded grams, each once, with the number of contexts that have
    it; one that is known to be repeated counts twice."""
    number = int(rows["chunk"].iloc[0]) if len(rows) else 0
    counts: dict[tuple[int, int, bytes], int] = {}
    for (gram, _), (data, left, full) in _contexts(docs, rows[rows["shared"] & rows["crowd"]]).items():
        for distance, digest in _windows(data, left):
            key = (gram, distance, digest)
            counts[key] = counts.get(key, 0) + 1 + bool(full)
    out = [(number, *key, n) for key, n in counts.items()]
    return pd.DataFrame(out, columns=["chunk", "gram", "distance", "digest", "n"])


def _sort_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["gram", "context", "left", "chunk"], ignore_index=True)
    found = repeated_windows(
        [bytes(d) for d in rows["data"]], rows["left"].tolist(), rows["full"].tolist()
    )
    out = [
        (chunk_, gram, context, start, end)
        for chunk_, gram, context, ranges in zip(
            rows["chunk"], rows["gram"], rows["context"], found, strict=True
        )
        for start, end in ranges
    ]
    return pd.DataFrame(out, columns=["chunk", "gram", "context", "start", "end"]).astype("int64")


def _finish(docs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Every document of a chunk without its repeated bytes."""
    full: set[tuple[int, int]] = set()
    ranges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    counted = rows[rows["digest"].notna()]
    repeated: dict[int, set[tuple[int, bytes]]] = {}
    for gram, distance, digest in zip(*[counted[c].tolist() for c in ("gram", "start", "digest")], strict=True):
        repeated.setdefault(gram, set()).add((int(distance), bytes(digest)))
    some = rows[rows["full"] | rows["end"].notna()]
    for gram, context, whole, start, end in zip(
        *[some[c].tolist() for c in ("gram", "context", "full", "start", "end")], strict=True
    ):
        if whole:
            full.add((gram, int(context)))
        else:
            ranges.setdefault((gram, int(context)), []).append((int(start), int(end)))
    grams = np.unique(np.append(some["gram"].to_numpy(np.int64), np.array(list(repeated), np.int64)))
    done = []
    for doc_id, text in zip(docs["doc_id"].tolist(), docs["text"], strict=True):
        text = (text or "").encode()
        spans = []
        for place, first, last, *key in _runs(text, grams):
            if tuple(key) in full:
                spans.append((first, last + WINDOW))
                continue
            spans += [(place + a, place + b) for a, b in ranges.get(tuple(key), ())]
            if key[0] in repeated:
                known = repeated[key[0]]
                spans += [
                    (place - window[0], place - window[0] + WINDOW)
                    for window in _windows(text[first : last + WINDOW], place - first) if window in known
                ]
        spans = _merge(spans)
        done.append(_result(None if pd.isna(doc_id) else int(doc_id), text, spans))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    return pd.DataFrame(done, columns=names).astype({"doc_id": "Int64"})


def _chunked(documents: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text and chunk, and the bytes of all texts."""
    docs = pick(documents, "doc_id", "text").withColumn("chunk", chunk())
    sizes = cut_lineage(
        docs.groupBy("chunk").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    )
    large = sizes.filter(F.col("bytes") > CHUNK_BYTES).select(
        F.col("chunk").alias("part"), F.ceil(F.col("bytes") / CHUNK_BYTES).alias("parts")
    )
    if not large.isEmpty():
        own = F.xxhash64("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.col("parts")))
        docs = docs.join(sized(large), F.col("chunk") == F.col("part"), "left").select(
            "doc_id", "text", F.when(F.col("parts").isNotNull(), own).otherwise(F.col("chunk")).alias("chunk")
        )
    return docs, sizes.agg(F.sum("bytes")).first()[0] or 0


def remove_repeats(documents: DataFrame) -> DataFrame:
    """What is left of every document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    Windows are judged on the input and never cross documents; overlapping ones count, also
    within one document. `spans` has the removed byte ranges as pairs of little-endian longs.
    A null text is empty; texts below WINDOW bytes keep everything. Equal rows repeat each
    other. Ids are integers; one that is missing is returned as missing, one that occurs
    twice stands for two documents.
    """
    docs, size = _chunked(documents)
    n_buckets = max(1, -(-size // BUCKET_BYTES))
    counted = docs.select("text", "chunk").mapInArrow(
        _count, "chunk bigint, gram bigint, context bigint, n bigint, kinds bigint"
    )
    # Windows over a gram need its rows together: of each batch of documents that has it one,
    # or LOCAL at most.
    by_gram, by_context = Window.partitionBy("gram"), Window.partitionBy("gram", "context")
    single = F.col("kinds") == 1
    named = F.when(single, F.col("context"))
    apart = F.min(named).over(by_gram) != F.max(named).over(by_gram)
    status = written(
        counted.withColumns({
            "total": F.sum("n").over(by_gram),
            "same": F.when(single, F.sum("n").over(by_context)),
            "shared": F.coalesce(apart, F.lit(False)) | (F.max("kinds").over(by_gram) > 1),
            "crowd": F.sum("kinds").over(by_gram) > CROWD,
        })
        .filter("total > 1")
        .select(
            "chunk", "gram", "context", (F.coalesce("same", F.lit(0)) > 1).alias("full"), "shared", "crowd"
        ),
        "repeats",
    )

    def with_chunks(what, schema: str, known: DataFrame) -> DataFrame:
        said = known.withColumnRenamed("chunk", "part").groupBy("part")
        return docs.groupBy("chunk").cogroup(said).applyInPandas(
            lambda rows, part: what(rows, part.rename(columns={"part": "chunk"})), schema
        )

    ranges = (
        with_chunks(_to_sort, "chunk bigint, gram bigint, context bigint, data binary, left bigint, full boolean", status)
        .withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(n_buckets)))
        .groupBy("bucket")
        .applyInPandas(_sort_bucket, "chunk bigint, gram bigint, context bigint, start bigint, end bigint")
    )
    none, no_bytes = F.lit(None).cast("bigint"), F.lit(None).cast("binary")
    marks = status.filter("full").select(
        F.col("chunk").alias("part"), "gram", "context", "full", none.alias("start"),
        none.alias("end"), no_bytes.alias("digest"),
    ).union(ranges.select("chunk", "gram", "context", F.lit(False), "start", "end", no_bytes))
    crowded = status.filter("crowd and shared")
    if not crowded.isEmpty():
        window = ["gram", "distance", "digest"]
        counts = written(
            with_chunks(_count_windows, "chunk bigint, gram bigint, distance bigint, digest binary, n bigint", crowded),
            "windows",
        )
        twice = counts.groupBy(*window).agg(F.sum("n").alias("n")).filter("n > 1").select(*window)
        marks = marks.union(counts.join(twice, window).select(
            "chunk", "gram", F.lit(0).cast("bigint"), F.lit(False), "distance", none, "digest"
        ))
    return docs.groupBy("chunk").cogroup(marks.groupBy("part")).applyInPandas(
        _finish,
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
        "spans binary",
    )
