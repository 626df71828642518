"""Operators 2, 5 and 10: models that are trained here."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from odd_rows import labels, no_documents, odd_documents, rows
from pyspark.sql import functions as F

from permitlake.llm import lm_scoring, quality, queries, toxicity

FOLDER = "/root/testdata/sf0.01"


def _tables(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    known = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    return docs, known


def test_base_score_and_tree(spark):
    docs, _ = _tables(spark)
    tokens = {i: [*t.encode().lower().split(), None] for i, t in docs.items()}
    held_out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = Counter(w for i, own in tokens.items() if not held_out[i] for w in own)
    total, distinct = sum(counts.values()), len(counts)
    found = queries.op2_lm_scoring(spark, FOLDER).collect()
    assert len(found) == len(docs)
    gain = []
    for row in found:
        own = tokens[row["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        assert row["n_tokens"] == len(own) and row["train_tokens"] == total
        assert row["n_known"] == sum(counts[w] > 0 for w in own)
        assert row["held_out"] == held_out[row["doc_id"]]
        if row["held_out"]:
            gain.append(row["score"] - row["base_score"])
    assert sum(gain) > 0 and np.mean(np.array(gain) > 0) > 0.7


def _brute_chances(training, depth=lm_scoring.DEPTH):
    """A function from history and symbol to the chance, built on dictionaries."""
    counts = Counter(w for own in training for w in own)
    total, distinct = sum(counts.values()), len(counts)
    once, twice = (sum(v == k for v in counts.values()) for k in (1, 2))
    totals = lm_scoring.Totals(total, distinct, min(max(once / max(once + 2 * twice, 1), 0.1), 0.9))
    cells = Counter()
    for own in training:
        padded = [None] * depth + own
        for i in range(depth, len(padded)):
            for k in range(1, depth + 1):
                cells[tuple(padded[i - k : i]), padded[i]] += 1
    nexts = {}
    for (context, symbol), n in cells.items():
        nexts.setdefault(context, {})[symbol] = n

    def chance(history, symbol, deepest):
        if deepest == 0:
            return float(totals.root(np.array([counts[symbol]]))[0])
        below = chance(history, symbol, deepest - 1)
        context = tuple(history[len(history) - deepest :])
        seen = nexts.get(context)
        # After a kept context with one symbol only, no longer one is looked at.
        settled = any(
            len(nexts.get(context[k:], ())) == 1 and kept(context[k:]) for k in range(1, deepest)
        )
        if not seen or settled or not kept(context):
            return below
        least = lm_scoring.LEAST[deepest - 1]
        kinds, counted = len(seen), sum(n for n in seen.values() if n >= least)
        own = seen.get(symbol, 0)
        return ((own if own >= least else 0) + kinds * below) / (counted + kinds)

    known = {}

    def kept(context):
        if context not in known:
            seen = nexts[context]
            n = np.array(list(seen.values()))
            # The walk asks for a longer context only where each part of it occurs twice.
            if sum(seen.values()) < 2:
                known[context] = False
            else:
                below = np.array([chance(context, s, len(context) - 1) for s in seen])
                sums = lm_scoring.gains(n, below, np.ones(len(n), bool), np.zeros(len(n), np.int64), 1)
                known[context] = bool(lm_scoring.keeps(*sums, lm_scoring.LEAST[len(context) - 1])[0])
        return known[context]

    return lambda history, symbol: chance(history, symbol, depth), set(counts)


def test_tree_against_dictionaries(spark):
    """The distributed counts give what plain dictionaries give, and chances add up to one."""
    rng = np.random.default_rng(5)
    phrase = "on the one hand it is so and on the other hand it is not"
    texts = {}
    for i in range(120):
        text = " ".join(rng.choice(["a", "b", "c", "dd", "e e", "f"], rng.integers(0, 30)))
        texts[i] = f"{text} {phrase} {text}" if i % 3 == 0 else text
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    found = lm_scoring.score_documents(frame).collect()
    learnt = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in texts}
    tokens = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    chance, known = _brute_chances([own for i, own in tokens.items() if learnt[i]])
    for row in found:
        own = tokens[row["doc_id"]]
        history, total = [None] * lm_scoring.DEPTH, 0.0
        for symbol in own:
            total += math.log10(chance(history, symbol))
            history.append(symbol)
        assert row["score"] == pytest.approx(total, rel=1e-6)
    for history in ([None, None], [b"on", b"the"], [b"a", b"b"]):
        assert sum(chance(history, s) for s in [*known, b"unknown"]) == pytest.approx(1)


def test_tree_against_dictionaries_on_documents(spark):
    rows_ = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").filter("doc_id < 150")
    texts = {r["doc_id"]: r["text"] for r in rows_.collect()}
    tokens = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    chance, _ = _brute_chances([own for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2])
    for row in lm_scoring.score_documents(rows_).collect():
        history, total = [None] * lm_scoring.DEPTH, 0.0
        for symbol in tokens[row["doc_id"]]:
            total += math.log10(chance(history, symbol))
            history.append(symbol)
        assert row["score"] == pytest.approx(total, rel=1e-6)


def test_messages_come_back_as_sent():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(1, 60))
        rows_ = np.unique(rng.integers(1, [3, 5, 1 << 40], (n, 3)), axis=0).astype(np.uint64)
        opens = lm_scoring._changes([rows_[:, 0], rows_[:, 1]])
        heads = rows_[opens]
        shorter = lm_scoring._changes([heads[:, 0]])
        above = [lm_scoring._spread(rng.integers(0, 900, shorter.sum()), shorter) for _ in range(2)]
        size, heavy = np.diff(np.flatnonzero(opens), append=len(rows_)), rng.random(len(heads)) < 0.5
        n = rng.integers(0, 1 << 34, len(rows_))
        own = (rows_[:, 0] * np.uint64(977) ^ rows_[:, 2]).astype(np.int64)  # one for each shorter cell
        question = lm_scoring.Question(
            [(4, slice(0, len(heads)), slice(0, len(rows_)))], [heads[:, 0], heads[:, 1]], size, heavy,
            [tuple(above)], rows_[:, 2], n, [own],
        )
        [(bucket, data)] = question.messages()
        back = lm_scoring.understood(data, 1)
        assert bucket == 4
        for got, sent in (
            (back["tokens"], [heads[:, 0], heads[:, 1]]), (back["above"], above),
            (back["context"], [size, heavy]), (back["cell"], [rows_[:, 2], n, own]),
        ):
            assert all(np.array_equal(g, s) for g, s in zip(got, sent, strict=True))


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_numbers_tell_counts(limit):
    """Each word has a number of its own, lower for larger counts, that tells the count."""
    rng = np.random.default_rng(4)
    buckets = [np.minimum(rng.zipf(1.5, 40), 900) - 1 for _ in range(6)]
    sizes, placed = Counter(), []
    for b, total in enumerate(buckets):
        for count in total.tolist():
            placed.append((count, sizes[count, b], b))
            sizes[count, b] += 1
    frequent = [(c, b, n) for (c, b), n in sizes.items() if c >= limit]
    rare = {c: max(n for (d, _), n in sizes.items() if c == d) for c, _ in sizes if c < limit}
    numbering = lm_scoring.Numbering.of(
        len(buckets), limit, np.array(frequent, np.int64).reshape(-1, 3),
        np.array(list(rare.items()), np.int64).reshape(-1, 2),
    )
    total, place, bucket = np.array(placed).T
    numbers = numbering.numbers(total, place, bucket)
    assert len(set(numbers.tolist())) == len(total) and numbers.min() >= 1
    assert np.all(np.diff(total[np.argsort(numbers)]) <= 0)
    assert np.array_equal(numbering.told(numbers), total)
    assert numbering.told(np.zeros(1, np.uint64)).tolist() == [0]
    assert np.sort(numbers)[: sum(total >= limit)].tolist() == list(range(1, sum(total >= limit) + 1))


def test_scores_do_not_depend_on_the_numbering(spark):
    rows_ = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").filter("doc_id < 150")
    dense = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(rows_).collect()}
    for row in lm_scoring.score_documents(rows_, top=20).collect():
        assert row["score"] == pytest.approx(dense[row["doc_id"]], rel=1e-9)


def _words_of_one_name(bits):
    """Two words whose hashes share their upper bits."""
    import xxhash

    seen = {}
    for i in range(1 << bits):
        word = f"w{i}"
        other = seen.setdefault(xxhash.xxh64_intdigest(word.encode()) >> 64 - bits, word)
        if other != word:
            return other, word


def test_words_of_similar_hashes_stay_apart(spark):
    """After two tokens, too, words have their own counts, whatever bits their hashes share."""
    one, two = _words_of_one_name(24)
    texts = {i: f"on the {one if i % 3 else two} so" for i in range(60)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    found = lm_scoring.score_documents(frame).collect()
    tokens = {i: [*t.encode().split(), None] for i, t in texts.items()}
    chance, _ = _brute_chances([own for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2])
    for row in found:
        history, total = [None] * lm_scoring.DEPTH, 0.0
        for symbol in tokens[row["doc_id"]]:
            total += math.log10(chance(history, symbol))
            history.append(symbol)
        assert row["score"] == pytest.approx(total, rel=1e-6)


def test_words_are_hashed_once(spark, monkeypatch):
    """What reads a chunk again, as four stages do, has its words' hashes from the first."""
    import xxhash

    frame = spark.createDataFrame([(1, " The end of\tthe END ", 1), (2, None, 0), (3, "end", 1)],
                                  "doc_id bigint, text string, learns int")
    [row] = lm_scoring.encode(frame.coalesce(1)).collect()
    hashes = [xxhash.xxh64_intdigest(w) for w in (b"the", b"end", b"of")]

    def refuse(word):
        raise AssertionError(f"{word} is hashed again")

    monkeypatch.setattr(xxhash, "xxh64_intdigest", refuse)
    chunk = lm_scoring.Chunk(row.asDict())
    assert chunk.hashes.tolist() == [1, *hashes] and chunk.lengths.tolist() == [5, 0, 1]
    assert chunk.word_counts().tolist() == [2, 2, 3, 1]  # two texts' ends, the, end, of


def test_a_chunk_is_placed_again_without_its_messages(spark, monkeypatch):
    """Later stages repeat where a chunk's cells are, not what it asked."""
    rows_ = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").filter("doc_id < 40")
    [row] = lm_scoring.encode(rows_.withColumn("learns", F.lit(1)).coalesce(1)).collect()
    chunk = lm_scoring.Chunk(row.asDict())
    counts = chunk.word_counts()
    numbers = np.empty(len(counts), np.uint64)
    numbers[np.argsort(-counts, kind="stable")] = np.arange(1, len(counts) + 1)
    totals = lm_scoring.Totals(int(counts.sum()), len(counts), 0.5)
    numbering = lm_scoring.Numbering(8, 1, np.zeros(0), np.zeros(0), np.zeros(0))
    walk = lm_scoring.Walk(chunk, counts, numbers, totals, numbering)
    walk.find()
    asked = walk.ask()
    monkeypatch.setattr(lm_scoring, "Question", None)
    again = lm_scoring.Walk(lm_scoring.Chunk(row.asDict()), counts, numbers, totals, numbering)
    again.find()
    assert np.array_equal(again.cell, walk.cell) and np.array_equal(again.heavy, asked.heavy)
    for which in (slice(None), np.flatnonzero(asked.heavy)):
        for got, sent in zip(again.named(which), asked.tokens, strict=True):
            assert np.array_equal(got, sent[which])
    # Each position's cell has its context and its symbol.
    assert np.array_equal(asked.symbol[walk.cell], walk.numbers[chunk.symbol[walk.at]])
    owner = np.repeat(np.arange(len(asked.size)), asked.size)
    assert np.array_equal(asked.tokens[0][owner[walk.cell]], walk.numbers[chunk.before[0][walk.at]])
    assert np.array_equal(np.bincount(walk.cell), asked.n)


def test_words_are_split_as_bytes_are():
    rng = np.random.default_rng(6)
    signs = [*map(chr, range(300)), *" " * 60, "\u00a0", "\u0085", "\u3000", "\U0001f600"]
    for size in [0, 1, 3, 40] * 50:
        texts = [
            None if rng.random() < 0.1 else "".join(rng.choice(signs, rng.integers(0, size + 1)))
            for _ in range(5)
        ]
        own = [(t or "").encode().lower().split() for t in texts]
        lengths, tokens, words = lm_scoring._split(pa.array(["cut off", *texts], pa.string()).slice(1))
        assert lengths.tolist() == [len(o) for o in own]
        assert words == list(dict.fromkeys(w for o in own for w in o))
        assert [words[t - 1] for t in tokens] == [w for o in own for w in o]


@pytest.mark.parametrize("top", [9, 1 << 40, (1 << 64) - 1])
def test_keys_of_any_width_are_grouped(top):
    keys = np.array([top, 3, top, 0, 3, top - 1], np.uint64)
    first, rank = lm_scoring._grouped(keys)
    assert rank.tolist() == [3, 1, 3, 0, 1, 2] and keys[first].tolist() == [0, 3, top - 1, top]
    assert [len(a) for a in lm_scoring._grouped(keys[:0])] == [0, 0]


def test_cells_are_told_apart_by_all_bits():
    context = np.array([5 << 40, 5 << 40 | 1, 5 << 40, 7 << 40, 5 << 40], np.uint64)
    for wide in (3, 1 << 20, 1 << 40):
        symbol = np.array([wide, wide, wide, wide, wide - 1], np.uint64)
        first, rank = lm_scoring._grouped(lm_scoring._keys([context, symbol]))
        assert rank.tolist() == [1, 2, 1, 3, 0] and len(first) == 4
        assert np.array_equal(context[first][rank], context) and np.array_equal(symbol[first][rank], symbol)


def test_scores_of_odd_rows(spark):
    found = lm_scoring.score_documents(odd_documents(spark)).collect()
    assert len(found) == len(rows())
    for row in found:
        assert row["score"] <= 1e-9 and row["base_score"] <= 0 and math.isfinite(row["score"])
    assert {r["n_tokens"] for r in found if r["doc_id"] in (2, 3, 4)} == {1}
    assert lm_scoring.score_documents(no_documents(spark)).count() == 0
    held = spark.createDataFrame([(5, "no training")], "doc_id bigint, text string")
    held = held if zlib.crc32(b"5") % 7 == 2 else spark.createDataFrame(
        [(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "no training")],
        "doc_id bigint, text string")
    row = lm_scoring.score_documents(held).first()
    assert row["n_known"] == 0 and row["train_tokens"] == 0 and row["score"] == 0


@pytest.mark.parametrize(
    ("name", "folds", "out", "label", "limit"),
    [("op5_quality", 5, 0, "quality", 0.95), ("op10_toxicity", 3, 1, "toxic", 0.9)],
)
def test_held_out_accuracy(spark, name, folds, out, label, limit):
    docs, known = _tables(spark)
    found = {r["doc_id"]: r for r in queries.queries()[name](spark, FOLDER).collect()}
    assert set(found) == set(docs)
    right = []
    for i, row in found.items():
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % folds == out)
        assert 0 <= row["score"] <= 1
        assert row["predicted"] == (row["score"] >= (0.3 if label == "quality" else 0.7))
        if row["held_out"] and i in known:
            right.append(row["predicted"] == known[i][label])
    assert np.mean(right) >= limit


def test_discriminant_against_densities():
    """The score's core is the difference of two normal log densities."""
    rng = np.random.default_rng(2)
    factor = [np.linalg.cholesky(np.cov(rng.normal(size=(3, 50)))) for _ in range(2)]
    model = quality.Discriminant(0.5, np.zeros(3), np.ones(3), [np.zeros(3), np.ones(3)], factor)
    x = rng.normal(size=(5, 3))
    for row, value in zip(x, model.difference(x), strict=True):
        logs = []
        for mean, f in zip(model.means, factor, strict=True):
            cov = f @ f.T
            away = row - mean
            logs.append(-0.5 * away @ np.linalg.inv(cov) @ away - 0.5 * np.linalg.slogdet(cov)[1])
        assert value == pytest.approx(logs[1] - logs[0])


def test_noisy_or_and_location():
    bags = toxicity.Bags({b"bad": 10.0}, -5.0)
    text = "Fine words here. Bad one! Fine é end."
    score, located = bags.score(text.encode())
    one = 1 / (1 + math.exp(5))
    assert score == pytest.approx(1 - (1 - 1 / (1 + math.exp(-5))) * (1 - one) ** 2)
    assert [text.encode()[s["start"] : s["end"]] for s in located] == [b" Bad one"]
    assert bags.score(b"") == (0.0, [])


def test_labels_teach_sentences():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(50)]
    texts, marks = [], []
    for i in range(300):
        sentences = [" ".join(rng.choice(words, 6)) for _ in range(5)]
        if i % 4 == 0:
            sentences[2] += " awful"
        texts.append(". ".join(sentences).encode())
        marks.append(int(i % 4 == 0))
    bags = toxicity.train(texts, marks)
    score, located = bags.score(texts[0])
    assert score > 0.9 and b"awful" in texts[0][located[0]["start"] : located[0]["end"]]
    assert len(located) == 1 and bags.score(texts[1])[0] < 0.5


@pytest.mark.parametrize("scorer", [quality.score_documents, toxicity.score_documents])
def test_odd_rows_and_labels(spark, scorer):
    for docs, known in [
        (odd_documents(spark), labels(spark)), (odd_documents(spark), labels(spark, False)),
        (no_documents(spark), labels(spark)),
    ]:
        found = scorer(docs, known).collect()
        assert len(found) == (0 if docs.isEmpty() else len(rows()))
        assert all(0 <= r["score"] <= 1 for r in found)


def test_keep_good_keeps_columns(spark):
    docs = odd_documents(spark)
    kept = quality.keep_good(docs, labels(spark, False))
    assert kept.columns == docs.columns and kept.count() == docs.count()  # 0.5 for all
