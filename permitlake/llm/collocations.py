"""Operator 13: phrase collocations by stripes.

A stripe is a prefix of one or two words with a counter of the words that follow it. The stripe
of (a, b) has the extensions a b x with their counts, x being "no word" at the end of a piece;
its total is the count of a b, its maximum the extension that may subsume a b. So counts of one,
two and three words, prefix totals and subsumption maxima all come from one structure, for one
shuffle. Stripes are built per chunk of text, sent to a bucket of their prefix and merged there
word by word.

Buckets: their number grows with the text, so that a merge holds a bounded part of it. Prefixes
that a sample of the text shows to be frequent have their stripes split by the next word among
buckets; what the parts of such a stripe give is added up by a grouping afterwards. The sample
decides where counts are added, never what they are.

Words travel as numbers with the message's own dictionary; a message is what one chunk has for
one bucket. Scores need joins of candidates only (phrases that occur `least` times or more).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permitlake.llm.common import cut_lineage, encoded, pick

LEAST = 10
SUBSUMED = 50  # percent of a phrase's occurrences in one longer candidate
TOP = 2000
CHUNK_BYTES = 16 << 20
BUCKET_BYTES = 16 << 20
SAMPLE_BYTES = 16 << 20
NO_LANG = "und"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_TOTAL, _WORD, _PAIR, _TRIPLE = 0, 1, 2, 3

# A-Z in lower case, every sign that ends a piece as a full stop, tab as a space.
_FOLD = bytes.maketrans(
    bytes(range(65, 91)) + b",;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + b"." * 9 + b" "
)
_STOP, _SPACE = ord("."), ord(" ")


def _words(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """All words in order, and the number of the piece that each stands in."""
    held = np.frombuffer(b".".join(texts).translate(_FOLD), dtype=np.uint8)
    stops = held == _STOP
    inside = ~(stops | (held == _SPACE))
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts),
        [None, pa.py_buffer(offsets), pa.py_buffer(held[inside])],
    )
    return words, np.cumsum(stops, dtype=np.int32)[starts]


def _coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers for words, and the words in the order of their numbers."""
    both = words.dictionary_encode()
    return both.indices.to_numpy(zero_copy_only=False).astype(np.int64), both.dictionary


def _pairs(first: np.ndarray, second: np.ndarray, base: int) -> tuple[np.ndarray, int]:
    """One number for each pair of numbers below some bound and `base`; and their bound."""
    bound = (int(first.max(initial=0)) + 1) * base
    if bound < 2**62:
        return first * base + second, bound
    known, first = np.unique(first, return_inverse=True)
    return first * base + second, len(known) * base


def _sums(columns: list[np.ndarray], base: int, counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of the columns once, in order, with the sum of their counts."""
    key, _ = _pairs(columns[0], columns[1], base)
    if len(columns) > 2:
        key, _ = _pairs(key, columns[2], base)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0))
    kept = order[first]
    sums = np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    return [c[kept] for c in columns], sums


def _stripes(texts: list[bytes]) -> tuple[pa.Array, list[np.ndarray], np.ndarray] | None:
    """The words and the stripes of a chunk as rows (a, b, x) with counts. A word's own total is
    the row (a, none, none); `none` is the number of words, one above the last."""
    words, piece = _words(texts)
    if not len(words):
        return None
    codes, known = _coded(words)
    none = len(known)

    def ahead(distance: int) -> np.ndarray:
        found = np.full(len(codes), none, dtype=np.int64)
        same = piece[distance:] == piece[: len(piece) - distance]
        found[: len(same)][same] = codes[distance:][same]
        return found

    second, third = ahead(1), ahead(2)
    follows = second < none
    rows, counts = _sums(
        [codes[follows], second[follows], third[follows]], none + 1,
        np.ones(int(follows.sum()), dtype=np.int64),
    )
    single, ends = np.arange(none), np.full(none, none, dtype=np.int64)
    rows = [np.concatenate(pair) for pair in zip(rows, (single, ends, ends), strict=True)]
    return known, rows, np.concatenate([counts, np.bincount(codes, minlength=none)])


def _text_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, texts) of about CHUNK_BYTES in all, or one text."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        for lang, text in zip(langs, encoded(batch), strict=True):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= CHUNK_BYTES:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _split_prefixes(known: pa.Array, rows: list[np.ndarray], split: set) -> np.ndarray:
    """Which rows have a prefix of `split`, a set of pairs of words."""
    found = np.zeros(len(rows[0]), dtype=bool)
    if split:
        number = {w: i for i, w in enumerate(known.to_pylist())}
        for a, b in split:
            if a in number and b in number:
                found |= (rows[0] == number[a]) & (rows[1] == number[b])
    return found


_MESSAGE = "lang string, bucket int, rows int, words binary, numbers binary"


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers, the first ascending, in few bytes: its steps, and each column's
    low bytes together, then the higher ones, which are mostly zero."""
    held = np.array([np.diff(columns[0], prepend=0), *columns[1:]], dtype="<i8")
    planes = np.ascontiguousarray(held.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1))
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, rows: int, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, columns * rows * 8, codec="zstd", asbytes=True), np.uint8)
    held = np.ascontiguousarray(planes.reshape(columns, 8, rows).transpose(0, 2, 1)).view("<i8")[..., 0]
    return [np.cumsum(held[0]), *held[1:]]


def _send(batches: Iterator[pa.RecordBatch], buckets: int, split: dict) -> Iterator[pa.RecordBatch]:
    for lang, texts in _text_chunks(batches):
        chunk = _stripes(texts)
        if chunk is None:
            continue
        known, rows, counts = chunk
        none = len(known)
        hashed = np.array([zlib.crc32(w) for w in known.to_pylist()] + [1 << 32], dtype=np.uint64)
        mixed = hashed[rows[0]] * _MIX[0] + hashed[rows[1]] * _MIX[1]
        parted = _split_prefixes(known, rows, split.get(lang, set()))
        mixed[parted] += hashed[rows[2][parted]] * _MIX[2]
        bucket = ((mixed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
        for start, end in zip(bounds, bounds[1:], strict=False):
            own = order[start:end]
            used, numbers = np.unique(np.concatenate([r[own] for r in rows]), return_inverse=True)
            if used[-1] == none:
                used = used[:-1]
            # Numbers of the message's own words; the number of words stands for `none`.
            parts = np.split(numbers, 3)
            words = b" ".join(known.take(pa.array(used)).to_pylist())
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang]), "bucket": pa.array([int(bucket[own[0]])], pa.int32()),
                "rows": pa.array([len(own)], pa.int32()), "words": pa.array([words], pa.binary()),
                "numbers": pa.array([_packed([*parts, counts[own]])], pa.binary()),
            })


_FOUND = "lang string, kind int, a string, b string, x string, n bigint, most bigint"


def _merge(messages: pa.Table, least: int, split: dict) -> pa.Table:
    """The stripes of one bucket added up: what occurs `least` times, and the sum of all words.

    Pairs whose stripe is split are returned whatever their count here.
    """
    lang = messages.column("lang")[0].as_py()
    words = [m.split(b" ") for m in messages.column("words").to_pylist()]
    codes, known = _coded(pa.array([w for own in words for w in own], pa.large_binary()))
    none, at, rows, counts = len(known), 0, [[], [], []], []
    for own, size, data in zip(words, *[messages.column(c).to_pylist() for c in ("rows", "numbers")], strict=True):
        numbers = np.append(codes[at : at + len(own)], none)
        at += len(own)
        *parts, count = _unpacked(data, size, 4)
        counts.append(count)
        for column, part in zip(rows, parts, strict=True):
            column.append(numbers[part])
    (a, b, x), n = _sums([np.concatenate(r) for r in rows], none + 1, np.concatenate(counts))

    single = b == none
    total = int(n[single].sum())
    often = single & (n >= least)
    triple = (x < none) & (n >= least)
    pair = ~single
    # Rows are in order, so that a stripe's rows stand together.
    starts = np.flatnonzero(
        pair & ((a != np.roll(a, 1)) | (b != np.roll(b, 1)) | (np.arange(len(a)) == 0) | np.roll(single, 1))
    )
    sums, most = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(starts):
        sums = np.add.reduceat(np.where(pair, n, 0), starts)
        most = np.maximum.reduceat(np.where(triple, n, 0), starts)
    wanted = (sums >= least) | _split_prefixes(known, [a[starts], b[starts]], split.get(lang, set()))

    def taken(numbers: np.ndarray) -> pa.Array:
        return known.take(pa.array(numbers, mask=numbers == none)).cast(pa.large_string()).cast(pa.string())

    kinds = np.repeat(
        [_TOTAL, _WORD, _PAIR, _TRIPLE], [1, often.sum(), wanted.sum(), triple.sum()]
    )
    places = np.concatenate([np.flatnonzero(often), starts[wanted], np.flatnonzero(triple)])
    nothing = np.array([none])
    shown = np.concatenate([nothing, np.where(kinds[1:] == _TRIPLE, x[places], none)])
    return pa.table({
        "lang": pa.array([lang] * len(kinds)), "kind": pa.array(kinds, pa.int32()),
        "a": taken(np.concatenate([nothing, a[places]])),
        "b": taken(np.concatenate([nothing, b[places]])), "x": taken(shown),
        "n": pa.array(np.concatenate([[total], n[often], sums[wanted], n[triple]]), pa.int64()),
        "most": pa.array(np.concatenate([np.zeros(1 + often.sum(), np.int64), most[wanted], np.zeros(triple.sum(), np.int64)]), pa.int64()),
    })


def _frequent_prefixes(docs: DataFrame, size: int, buckets: int) -> dict[str, set]:
    """Prefixes of two words that make up more than a quarter of a bucket's due of a sample of
    the documents, by language: at most four per bucket."""
    if buckets < 2:
        return {}
    share = min(1.0, SAMPLE_BYTES / size)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _text_chunks(batches):
            chunk = _stripes(texts)
            if chunk is None:
                continue
            known, (a, b, _), n = chunk
            (a, b), sums = _sums([a, b], len(known) + 1, n)
            all_words = int(sums[b == len(known)].sum())
            kept = (b < len(known)) & (sums * 8 * buckets >= all_words)
            names = [known.take(pa.array(c[kept])).cast(pa.binary()) for c in (a, b)]
            shared = [pa.array([lang] * len(names[0]), pa.string()), *names, pa.array(sums[kept], pa.int64())]
            own = [pa.array([lang], pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([all_words], pa.int64())]
            for columns in (shared, own):
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, a binary, b binary, n bigint")
    rows = counted.groupBy("lang", "a", "b").agg(F.sum("n").alias("n")).collect()
    every = sum(r["n"] for r in rows if r["a"] is None)
    found: dict[str, set] = {}
    for r in rows:
        if r["a"] is not None and r["n"] * 4 * buckets >= every:
            found.setdefault(r["lang"], set()).add((bytes(r["a"]), bytes(r["b"])))
    return found


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)), exact for counts below 10^15."""
    wide = [f"cast({c} as decimal(15, 0))" for c in (a, left, right)]
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * ({wide[0]} * {wide[0]})) div ({wide[1]} * {wide[2]})")


def count_phrases(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Exact counts per language: all words (lang, n); words (lang, a, n); pairs (lang, a, b, n,
    most: the largest count of a pair with one more word behind it that is `least` or more);
    triples (lang, a, b, x, n). All but the first only where n is `least` or more.

    A null text is empty, a null language `und`. Rows count as often as they occur.
    """
    docs = pick(documents, "doc_id", "text", "lang").select(
        "doc_id", "text", F.coalesce(F.col("lang"), F.lit(NO_LANG)).alias("lang")
    ).filter(F.length("text") > 0)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    spark = documents.sparkSession
    split = spark.sparkContext.broadcast(_frequent_prefixes(docs, size, buckets))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _send(batches, buckets, split.value)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The messages of one language and bucket at a time; they come in this order."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for row in range(batch.num_rows):
                message = batch.slice(row, 1)
                if held and any(message.column(c)[0] != held[0].column(c)[0] for c in (0, 1)):
                    yield from _merge(pa.Table.from_batches(held), least, split.value).to_batches()
                    held = []
                held.append(message)
        if held:
            yield from _merge(pa.Table.from_batches(held), least, split.value).to_batches()

    # A partition for each bucket, so that no two of them meet in one task.
    found = cut_lineage(
        docs.select("lang", "text").mapInArrow(send, _MESSAGE)
        .repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "lang")
        .mapInArrow(merge, _FOUND)
    )
    totals = found.filter(F.col("kind") == _TOTAL).groupBy("lang").agg(F.sum("n").alias("n"))
    words = found.filter(F.col("kind") == _WORD).select("lang", "a", "n")
    pairs = found.filter(F.col("kind") == _PAIR).groupBy("lang", "a", "b").agg(
        F.sum("n").alias("n"), F.max("most").alias("most")
    ).filter(F.col("n") >= least)
    triples = found.filter(F.col("kind") == _TRIPLE).select("lang", "a", "b", "x", "n")
    return totals, words, pairs, triples


def _named(frame: DataFrame, **names: str) -> DataFrame:
    return frame.select("lang", *[F.col(old).alias(new) for old, new in names.items()])


def collocations(documents: DataFrame, least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """Each language's `top` phrases of two or three words by score: lang, rank, phrase, a (its
    count), l, r (counts of the two parts of the cut that scores lowest, the shorter first part
    on ties), n (all words of the language), score.

    Phrases that occur less than `least` times are none; one that stands inside a phrase of
    three words with at least `subsumed` percent of its count is dropped. Ties go by a, then by
    the phrase's bytes. No documents, or none with a phrase, give no rows.
    """
    totals, words, pairs, triples = count_phrases(documents, least)
    before = triples.groupBy("lang", "b", "x").agg(F.max("n").alias("before"))
    left_word, right_word = _named(words, a="a", n="left_n"), _named(words, a="b", n="right_n")

    free = (
        pairs.join(_named(before, b="a", x="b", before="before"), ["lang", "a", "b"], "left")
        .filter(100 * F.greatest("most", F.coalesce("before", F.lit(0))) < subsumed * F.col("n"))
    )
    two = free.join(left_word, ["lang", "a"]).join(right_word, ["lang", "b"]).select(
        "lang", F.concat_ws(" ", "a", "b").alias("phrase"), F.col("n").alias("a"),
        F.col("left_n").alias("l"), F.col("right_n").alias("r"), _score("n", "left_n", "right_n").alias("score"),
    )
    cuts = (
        triples.join(left_word, ["lang", "a"])
        .join(_named(pairs, a="b", b="x", n="tail_n"), ["lang", "b", "x"])
        .join(_named(pairs, a="a", b="b", n="head_n"), ["lang", "a", "b"])
        .join(_named(words, a="x", n="right_n"), ["lang", "x"])
    )
    at_one, at_two = _score("n", "left_n", "tail_n"), _score("n", "head_n", "right_n")
    three = cuts.withColumns({"one": at_one, "two": at_two}).select(
        "lang", F.concat_ws(" ", "a", "b", "x").alias("phrase"), F.col("n").alias("a"),
        F.when(F.col("one") <= F.col("two"), F.col("left_n")).otherwise(F.col("head_n")).alias("l"),
        F.when(F.col("one") <= F.col("two"), F.col("tail_n")).otherwise(F.col("right_n")).alias("r"),
        F.least("one", "two").alias("score"),
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may have most phrases: its first ones are found in parts, of those in fewer
    # parts, then among all.
    best = two.unionByName(three)
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for number in (parts, math.isqrt(parts)):
        in_part = Window.partitionBy("lang", "part").orderBy(*order)
        best = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(number))).withColumn(
            "place", F.row_number().over(in_part)
        ).filter(F.col("place") <= top)
    in_lang = Window.partitionBy("lang").orderBy(*order)
    ranked = best.withColumn("rank", F.row_number().over(in_lang).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
