"""Operators 1 and 7."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import no_documents, odd_documents, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from permitlake.llm import packing, queries, sharding
from permitlake.llm.common import pick

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ADDED = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
FOLDER = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 3), st.integers(0, 9)), max_size=60))
def test_bins_hold_their_limits(items):
    limits = np.array([10, 4, 8])
    sizes = np.array(items, dtype=np.int64).reshape(-1, 3)
    bins = packing.place(sizes, limits)
    assert len(bins) == len(items) and (bins >= 0).all()
    for number in set(bins.tolist()):
        inside = sizes[bins == number]
        assert len(inside) == 1 or (inside.sum(axis=0) <= limits).all()


def test_scarce_dimension_is_spread():
    """Items that need much of one limit share bins with items that need the other."""
    sizes = np.array([[9, 1, 1]] * 20 + [[1, 1, 9]] * 20)
    assert len(set(packing.place(sizes, np.array([10, 99, 10])).tolist())) == 20


def test_texts_that_hold_an_added_token(spark):
    texts = dict(enumerate([
        "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  ", "<|endoftext",
        "  <|endoftext|>\n\n z", "plain", "",
    ]))
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    _check_pieces(packing.pack_documents(frame, RANKS, added=ADDED).collect(), texts)


def naive_place(sizes, limits):
    """Bins one after the other; every step looks at every item that is left."""
    share = sizes / limits
    weight = share.sum(axis=0)
    weighted = share * (weight / max(weight.sum(), 1e-9))
    order = sorted(range(len(sizes)), key=lambda i: tuple(sizes[i]))
    bins, current, left = [-1] * len(sizes), 0, list(order)
    while left:
        room, taken = limits.astype(float).copy(), False
        while True:
            fits = [i for i in left if (sizes[i] <= room).all()] or ([] if taken else left[:1])
            if not fits:
                break
            scores = [float(weighted[i] @ (np.maximum(room, 0) / limits)) for i in fits]
            best = fits[scores.index(max(scores))]
            bins[best], taken = current, True
            left.remove(best)
            room -= sizes[best]
            if (room <= 0).any() or not left:
                break
        current += 1
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 3), st.integers(0, 8)), max_size=25))
def test_bins_against_a_naive_packer(items):
    """The same sizes in the same bins; equal sizes may change places."""
    limits, sizes = np.array([10, 4, 8]), np.array(items, dtype=np.int64).reshape(-1, 3)

    def content(bins):
        held = {}
        for size, number in zip(items, bins, strict=True):
            held.setdefault(int(number), []).append(size)
        return [sorted(held[n]) for n in sorted(held)]

    assert content(packing.place(sizes, limits)) == content(naive_place(sizes, limits))


def _check_pieces(found, texts, others=()):
    """Every document's pieces, and the sequences; `others` are ids that are not looked into."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for row in found:
        by_doc.setdefault(row["doc_id"], []).append(row)
        by_sequence.setdefault(row["sequence_id"], []).append(row)
    for doc_id, text in texts.items():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], "<u4")
        pieces = sorted(by_doc.pop(doc_id), key=lambda r: r["start"])
        assert [p["start"] for p in pieces] == list(range(0, len(ids), 2048))
        for piece in pieces:
            part = ids[piece["start"] : piece["start"] + piece["length"]]
            assert len(part) == piece["length"] and piece["doc_tokens"] == len(ids)
            assert zlib.crc32(part.tobytes()) == piece["ids_crc32"]
    assert not set(by_doc) - set(others)
    for pieces in by_sequence.values():
        at = 0
        for piece in sorted(pieces, key=lambda r: r["offset"]):
            assert piece["offset"] == at
            at += piece["length"]
        assert at <= 2048 and len(pieces) <= packing.MAX_SEGMENTS


def test_packing_against_the_tokenizer(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = queries.op1_packing(spark, FOLDER).collect()
    _check_pieces(found, texts)
    full = sum(r["length"] for r in found) / 2048 / len({r["sequence_id"] for r in found})
    assert full > 0.97


def test_packing_odd_rows(spark):
    found = packing.pack_documents(odd_documents(spark), RANKS, added=ADDED).collect()
    known = [r for r in rows() if r[0] is not None and r[0] != 9]
    _check_pieces(found, {r[0]: r[1] or "" for r in known}, others=[9, None])
    assert Counter(r["doc_id"] for r in found)[9] == 2
    assert Counter(r["doc_id"] for r in found)[None] == 2
    assert packing.pack_documents(no_documents(spark), RANKS).count() == 0


def test_sequences_round_trip(spark):
    docs = odd_documents(spark).filter("doc_id = 5")
    packed = packing.pack_documents(docs, RANKS, with_ids=True, added=ADDED)
    ids = {r["sequence_id"]: bytes.fromhex(r["ids_hex"]) for r in packing.sequences(packed).collect()}
    pieces = sorted(packed.collect(), key=lambda r: r["start"])
    got = b"".join(ids[p["sequence_id"]][4 * p["offset"] : 4 * (p["offset"] + p["length"])] for p in pieces)
    assert got == b"".join(bytes(p["ids"]) for p in pieces)


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(spark, n, bits):
    cells = [F.shiftright("id", i * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for i in range(n)]
    grid = spark.range(1 << n * bits).select(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    index = sharding.hilbert_index([F.col(f"c{i}") for i in range(n)], bits)
    points = sorted(grid.withColumn("h", index).collect(), key=lambda r: r["h"])
    assert [p["h"] for p in points] == list(range(len(points)))
    for a, b in zip(points, points[1:], strict=False):
        assert sum(abs(a[i] - b[i]) for i in range(n)) == 1


def _check_shards(found, n_docs):
    sizes = Counter(r["shard"] for r in found)
    assert len(found) == n_docs
    counts = [sizes[i] for i in range(24)]
    assert sum(counts) == n_docs and max(counts) - min(counts) <= 1
    for shard in sizes:
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sizes[shard]))


def test_shards(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = queries.op7_sharding(spark, FOLDER).collect()
    _check_shards(found, len(docs))
    places = {}
    for row in found:
        data = docs[row["doc_id"]].encode()
        assert row["size"] == len(data) + 8 and row["text_crc32"] == zlib.crc32(data)
        places.setdefault(data, []).append(row["shard"])
    # Equal texts lie next to each other.
    assert all(max(p) - min(p) <= 1 for p in places.values())


def test_shards_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    found = sharding.shard_documents(docs)
    _check_shards(found.collect(), len(rows()))
    assert sharding.shard_documents(no_documents(spark)).count() == 0


def test_every_row_is_written_once(spark, tmp_path):
    """Missing ids, repeated ids and repeated rows, in the order of their slots."""
    plain = pick(odd_documents(spark), "doc_id", "text", "lang", "source", "n_chars").withColumn(
        "row", F.lit("own")
    )
    sharding.write_shards(plain, str(tmp_path / "out"), n_shards=5)
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.columns == [*plain.columns, "shard"]
    assert Counter(map(tuple, written.drop("shard").collect())) == Counter(map(tuple, plain.collect()))
    sizes = [r["count"] for r in written.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 5
    with pytest.raises(ValueError, match="SHARD"):
        sharding.write_shards(written, str(tmp_path / "other"), column="SHARD")
    sharding.write_shards(no_documents(spark).select("doc_id", "lang", "source", F.lit("").alias("text")), str(tmp_path / "none"))


def test_cells_keep_the_order(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for column in ("lang", "source"):
        cells = sorted(map(tuple, sharding.ranked_cells(docs, column, 10).collect()))
        values = sorted(r[0] for r in docs.select(column).distinct().collect())
        assert cells == [(v, i * 1024 // len(values)) for i, v in enumerate(values)]
    sizes = docs.select("n_chars", sharding.quantile_cell(docs, "n_chars", 10).alias("c")).collect()
    ordered = [c for _, c in sorted(map(tuple, sizes))]
    assert ordered == sorted(ordered) and min(ordered) >= 0 and max(ordered) == 1023
    parts = Counter(c // 64 for c in ordered)
    assert len(parts) == 16 and max(parts.values()) <= 2 * len(ordered) / 16


def test_filters_skip_shards(spark):
    """Minimum and maximum of a shard leave most shards out, whatever dimension is asked for."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "source")
    found = sharding.shard_documents(spark.read.parquet(f"{folder}/documents.parquet"))
    ends = found.join(docs, "doc_id").groupBy("shard").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("lang", "source", "size") for n, f in (("min", F.min), ("max", F.max))]
    ).collect()

    def skipped(column, values):
        held = [sum(r[f"min_{column}"] <= v <= r[f"max_{column}"] for r in ends) for v in values]
        return 1 - sum(held) / len(held) / len(ends)

    langs, sources = ([r[0] for r in docs.select(c).distinct().collect()] for c in ("lang", "source"))
    sizes = found.approxQuantile("size", [k / 20 for k in range(1, 20)], 0.01)
    shares = {"lang": skipped("lang", langs), "source": skipped("source", sources), "size": skipped("size", sizes)}
    print(shares)
    assert shares["lang"] >= 0.5 and shares["source"] >= 0.4 and shares["size"] >= 0.4, shares
