"""Operator 13."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import no_documents, odd_documents, rows

from permitlake.llm import collocations as stripes
from permitlake.llm import oracle, queries
from permitlake.llm.common import ship_package

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string"


def brute_force(texts, least=10, subsumed=50, top=2000):
    """Every phrase of every piece counted on its own."""
    counts, words_of = defaultdict(Counter), Counter()
    for lang, text in texts:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            words_of[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    result = []
    for lang, f in counts.items():
        longer = Counter()
        for phrase, a in f.items():
            if len(phrase) == 3 and a >= least:
                for part in (phrase[:2], phrase[1:]):
                    longer[part] = max(longer[part], a)
        found = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least or (len(phrase) == 2 and 100 * longer[phrase] >= subsumed * a):
                continue
            cuts = [
                (1000000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))
            ]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, left, right, words_of[lang], -score))
    return sorted(result)


def found(frame):
    return sorted(tuple(r) for r in frame.collect())


def documents(spark, texts):
    ship_package(spark)
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], SCHEMA)


def small_chunks(monkeypatch, buckets=2_000):
    monkeypatch.setattr(stripes, "CHUNK_BYTES", 5_000)
    monkeypatch.setattr(stripes, "BUCKET_BYTES", buckets)


def test_query_against_sql_and_counts(spark):
    result = queries.queries()["op13_collocations"](spark, FOLDER)
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    expected = brute_force([(r.lang, r.text) for r in table.collect()])
    assert found(result) == expected and len(expected) > 100
    db = duckdb.connect()
    db.execute(f"create view documents as from '{FOLDER}/documents.parquet'")
    sql = f"select {', '.join(result.columns)} from ({oracle.COLLOCATIONS})"
    assert sorted(db.execute(sql).fetchall()) == expected


def test_chunks_buckets_and_split_stripes_change_nothing(spark, monkeypatch):
    small_chunks(monkeypatch)
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    expected = brute_force([(r.lang, r.text) for r in table.collect()])
    ship_package(spark)
    assert found(stripes.collocations(table.repartition(7))) == expected


def hot_prefix():
    """One pair in most places, each time before another word; and pairs that it must not hide."""
    varied = " ".join(f"a b w{i}." for i in range(3_000))
    return [("en", varied), ("en", "a b c a b c " * 30), ("en", "x y. " * 40), ("de", "a b. " * 12)]


def test_hot_stripe_is_split_by_next_word(spark, monkeypatch):
    small_chunks(monkeypatch, buckets=500)
    docs = documents(spark, hot_prefix())
    split = stripes._frequent_prefixes(docs, 35_000, 70)
    assert (b"a", b"b") in split["en"] and sum(map(len, split.values())) <= 4 * 70
    assert found(stripes.collocations(docs)) == brute_force(hot_prefix())


def test_only_candidates_subsume(spark):
    """A longer phrase below the least count drops nothing, however large its share."""
    texts = [("en", "p q r. " * 9 + "p q. " * 3), ("fr", "p q r. " * 10 + "p q. " * 10), ("es", "p q r. " * 10 + "p q. " * 11)]
    expected = brute_force(texts)
    assert found(stripes.collocations(documents(spark, texts))) == expected
    named = {(r[0], r[2]) for r in expected}
    assert {("en", "p q"), ("es", "p q"), ("fr", "p q r")} <= named and ("fr", "p q") not in named


def test_scores_are_exact_beyond_64_bits(spark):
    n = [(999_999_999_998, 10**14 - 1, 10**14 - 3), (3, 7, 9), (10**14, 10**14, 10**14), (10**14, 10**14 + 1, 10**14 + 1)]
    frame = spark.createDataFrame(n, "a bigint, l bigint, r bigint")
    got = {tuple(r)[:3]: r.score for r in frame.withColumn("score", stripes._score("a", "l", "r")).collect()}
    assert got == {(a, left, r): 1000000 * a * a // (left * r) for a, left, r in n}


def test_top_is_per_language_and_ties_go_by_bytes(spark):
    texts = [("en", f"u{i} v{i}. " * (10 + i % 2)) for i in range(30)] + [(None, "é z. " * 10 + "z é! " * 10)]
    expected = brute_force(texts, top=7)
    assert found(stripes.collocations(documents(spark, texts), top=7)) == expected
    assert Counter(r[0] for r in expected) == {"en": 7, "und": 2}


word = st.sampled_from(["a", "b", "A", "é", "\x00", "\x1c", "c d", "", "a.b", ",", "?x", "\x0b"])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(
    st.sampled_from([None, "en", ""]),
    st.one_of(st.none(), st.lists(word, max_size=30).map(lambda w: " ".join(w) * 3), st.lists(word, max_size=9).map("\t".join)),
), max_size=8))
def test_odd_words(spark, texts):
    assert found(stripes.collocations(documents(spark, texts), least=2)) == brute_force(texts, least=2)


def test_odd_documents(spark):
    ship_package(spark)
    own = [(r[2], r[1]) for r in rows()]
    assert found(stripes.collocations(odd_documents(spark), least=3)) == brute_force(own, least=3)
    assert stripes.collocations(no_documents(spark)).collect() == []


@pytest.mark.parametrize("text", ["a " * 600_000, "x" * 1_200_000 + " " + "x" * 1_200_000, "." * 1_000_000])
def test_very_long_texts(spark, text):
    texts = [("en", text)] * 2
    assert found(stripes.collocations(documents(spark, texts), least=2)) == brute_force(texts, least=2)
