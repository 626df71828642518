"""Operators 4, 8 and 9: fingerprints, repeated bytes, near duplicates."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import LONG, WORDS, no_documents, odd_documents, rows

from permitlake.llm import fingerprints, queries, simhash_dedup, suffix_dedup

FOLDER = "/root/testdata/sf0.001"


def _documents(spark, folder=FOLDER):
    found = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return dict(sorted((r["doc_id"], r["text"]) for r in found))


# --- 4 ----------------------------------------------------------------------------------


def test_fingerprints_of_edited_texts(spark):
    docs = _documents(spark)
    ids = list(docs)
    found = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, FOLDER).collect()}
    assert list(sorted(found)) == ids
    for i, doc_id in enumerate(ids):
        text, following = docs[doc_id], docs[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = found[doc_id]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, after = map(fingerprints.fingerprint, (text, edited, following))
        assert (row["fingerprint"], row["edited_fingerprint"]) == (own.hex(), other.hex())
        assert row["near_edited"] == fingerprints.likeness(own, other)
        assert row["near_next"] == fingerprints.likeness(own, after)
    assert np.mean([r["near_edited"] > r["near_next"] for r in found.values()]) > 0.97


def test_fingerprints_of_odd_rows(spark):
    found = fingerprints.fingerprint_documents(odd_documents(spark)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows())
    prints = {r["doc_id"]: r["fingerprint"] for r in found}
    assert prints[2] == prints[3] == prints[4] == "0" * 64 and prints[1] == prints[6]
    assert fingerprints.fingerprint_documents(no_documents(spark)).count() == 0
    single = odd_documents(spark).filter("doc_id = 1")
    assert fingerprints.fingerprint_documents(single).first()["near_next"] == 1.0


def test_block_tables_find_all(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(256) for _ in range(40)]
    values = set(base)
    for value in base:
        for flips in (1, 3, 7, 8, 9):
            values.add(value ^ sum(1 << b for b in rng.sample(range(256), flips)))
    frame = spark.createDataFrame([(f"{v:064x}",) for v in values] + [(None,)], "fingerprint string")
    asked = frame.limit(100)
    found = fingerprints.within_radius(asked, frame).collect()
    want = {
        (a, f"{v:064x}", (int(a, 16) ^ v).bit_count())
        for (a,) in asked.collect() if a for v in values if (int(a, 16) ^ v).bit_count() <= 7
    }
    assert {tuple(r) for r in found} == want and len(found) == len(want)


# --- 9 ----------------------------------------------------------------------------------


def _plain_print(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def _plain_classes(prints, radius=2):
    ids = list(prints)
    above = {i: i for i in ids}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                above[y] = x
    return {i: top(i) for i in ids}


def test_near_duplicates_against_all_pairs(spark):
    prints = {i: _plain_print(t) for i, t in _documents(spark).items()}
    found = {r["doc_id"]: r for r in queries.op9_simhash_dedup(spark, FOLDER).collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in found.items()} == prints
    assert {i: r["component_id"] for i, r in found.items()} == _plain_classes(prints)


def test_tree_search_is_complete():
    rng = random.Random(1)
    values = [rng.getrandbits(10) for _ in range(300)]
    tree = simhash_dedup.BKTree()
    for value in values:
        tree.add(value)
    for asked in range(0, 1024, 7):
        want = {v for v in values if (v ^ asked).bit_count() <= 2}
        assert set(tree.search(asked, 2)) == want


def test_links_with_split_shards(spark, monkeypatch):
    """Large shards are split again, and each link is still found once."""
    monkeypatch.setattr(simhash_dedup, "LARGE", 3)
    rng = random.Random(2)
    values = {simhash_dedup._signed(rng.getrandbits(6) | rng.getrandbits(3) << 61) for _ in range(300)}
    frame = spark.createDataFrame([(v,) for v in values], "print bigint")
    found = [tuple(sorted(r)) for r in simhash_dedup.links(frame).collect()]
    full = (1 << 64) - 1
    want = {
        (a, b) for a in values for b in values
        if a < b and ((a ^ b) & full).bit_count() <= 2
    }
    assert set(found) == want and len(found) == len(want)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in simhash_dedup.components(edges).collect()}
    assert {k: v for k, v in found.items() if k < 100} == dict.fromkeys(range(1, 61), 0)
    assert found[101] == 100


def test_near_duplicates_of_odd_rows(spark):
    found = simhash_dedup.near_duplicates(odd_documents(spark)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows())
    classes = {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None}
    assert classes[2] == classes[3] == classes[4] == 2 and classes[6] == 1
    assert simhash_dedup.near_duplicates(no_documents(spark)).count() == 0
    docs = odd_documents(spark)
    kept = simhash_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(
        {c for c in classes.values()}
    ) and ids.count(None) == 1


def test_texts_of_one_id_are_judged_apart(spark):
    one = "one text about rivers and hills that is long enough to have a print of its own " * 3
    two = "quite another matter: invoices, ledgers, columns of numbers and the clerks who kept them " * 3
    three = "ships sail at dawn with salt and rope and nobody on shore remembers where they went " * 3
    rows_ = [
        (1, one, "b"), (1, two, "a"), (2, one, "c"), (1, one, "a"), (3, three, "x"), (None, three, "y"),
        (None, two + "far from it all, a different sentence with words of its own kind here " * 9, "z"),
        (0, two, "q"), (None, None, "n"), (None, "", "m"),
    ]
    docs = spark.createDataFrame(rows_, "doc_id bigint, text string, `TEXT` string")
    kept = sorted(map(tuple, simhash_dedup.keep_first(docs).collect()), key=str)
    # Both texts of id 1 are looked at: `one` stays, once; `two` goes for id 0, `three` has an id.
    assert [r for r in kept if r[0] is not None] == [(0, two, "q"), (1, one, "a"), (3, three, "x")]
    nameless = [r for r in kept if r[0] is None]
    assert len(nameless) == 2 and {r[2] for r in nameless} & {"n", "m"} and "z" in {r[2] for r in nameless}


# --- 8 ----------------------------------------------------------------------------------


def _plain_removal(texts):
    width, seen = suffix_dedup.WINDOW, Counter()
    for text in texts:
        seen.update(text[i : i + width] for i in range(len(text) - width + 1))
    out = []
    for text in texts:
        marks = bytearray(len(text))
        for i in range(len(text) - width + 1):
            if seen[text[i : i + width]] > 1:
                marks[i : i + width] = b"\1" * width
        kept = bytes(b for b, m in zip(text, marks, strict=True) if not m)
        spans = len([part for part in bytes(marks).split(b"\0") if part])
        out.append((len(text), sum(marks), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _found(frame):
    return {
        r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
        for r in suffix_dedup.remove_repeats(frame).collect()
    }


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=80).map(lambda b: b.translate(bytes([97, 98, 0] * 86)[:256])), min_size=1, max_size=40),
       st.sampled_from([0, 10, 48, 70]))
def test_deep_shallow_sorts(strings, shared):
    strings = [b"x" * shared + s for s in strings]
    order, common = suffix_dedup.deep_shallow(strings)
    assert [strings[i] for i in order] == sorted(strings)
    for a, b, n in zip(order, order[1:], common[1:], strict=False):
        assert strings[a][:n] == strings[b][:n]
        assert len(strings[a]) == n or len(strings[b]) == n or strings[a][n] != strings[b][n]


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 1])
def test_repeats_in_mixed_texts(spark, monkeypatch, crowd):
    """Passages of all lengths around the limit, overlaps, self-repeats; both ways of sorting.

    CROWD is read on the driver; more than LOCAL contexts of a gram occur in any case.
    """
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(9)
    letters = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    passages = [letters(n) for n in (150, 199, 200, 201, 260, 400, 900)]
    texts = []
    for _ in range(60):
        parts = [rng.choice([letters(rng.randint(0, 150)), rng.choice(passages)]) for _ in range(rng.randint(0, 5))]
        texts.append(b"".join(parts))
    texts += [b"ab" * 300, b"a" * 250, b"a" * 200, letters(200), b""]
    frame = spark.createDataFrame(
        [(i, t.decode()) for i, t in enumerate(texts)], "doc_id bigint, text string"
    ).repartition(3)
    assert list(dict(sorted(_found(frame).items())).values()) == _plain_removal(texts)


def test_passage_that_half_of_the_documents_share(spark, monkeypatch):
    """Each document has other text around it. A window gives one row a chunk, however many
    documents of the chunk have it, and no row is grouped alone with all others."""
    monkeypatch.setattr(suffix_dedup, "CROWD", 100)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 40_000)
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letters(330)
    texts = [letters(rng.randint(0, 150)) + (passage if i % 2 else letters(200)) + letters(rng.randint(0, 150)) for i in range(600)]
    rows_ = [(i if i % 5 else None, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows_, "doc_id bigint, text string").repartition(3)
    seen = []
    write = suffix_dedup.written
    monkeypatch.setattr(suffix_dedup, "written", lambda f, purpose: seen.append((purpose, w := write(f, purpose))) or w)
    found = suffix_dedup.remove_repeats(frame).collect()
    want = Counter(zip([r[0] for r in rows_], _plain_removal([t.encode() for t in texts]), strict=True))
    assert Counter((r[0], tuple(r)[1:5]) for r in found) == want
    counts = dict(seen)["windows"]
    chunks = counts.select("chunk").distinct().count()
    assert chunks >= 5  # also the missing ids are several
    assert counts.groupBy("gram", "distance", "digest").count().agg({"count": "max"}).first()[0] <= chunks
    assert counts.agg({"n": "max"}).first()[0] > 20


def test_repeats_across_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    rng = random.Random(3)
    text = "".join(rng.choice("abcdef") for _ in range(7000))
    texts = [text, text[1500:4100] + "x" * 30, "y" + text[3990:4300]]
    for i, t in enumerate(texts):
        places, _, first, last = suffix_dedup.anchors(t.encode())
        assert (np.diff(places) > 0).all(), i
        # The runs are all windows, in turn.
        assert first[0] == 0 and last[-1] == len(t) - suffix_dedup.WINDOW
        assert (first[1:] == last[:-1] + 1).all()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert list(dict(sorted(_found(frame).items())).values()) == _plain_removal([t.encode() for t in texts])


def test_repeats_in_documents_and_odd_rows(spark):
    docs = _documents(spark)
    found = _found(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert [found[i] for i in docs] == _plain_removal([t.encode() for t in docs.values()])
    got = suffix_dedup.remove_repeats(odd_documents(spark)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows())
    want = dict(zip([r[0] for r in rows()], _plain_removal([(r[1] or "").encode() for r in rows()]), strict=True))
    for row in got:
        if row["doc_id"] is not None:
            assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]) == want[row["doc_id"]]
    assert suffix_dedup.remove_repeats(no_documents(spark)).count() == 0
    assert len(LONG) > 20000 and len(WORDS) < 200
