"""Operator 12."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from permitlake.llm import conversation_trie as trie
from permitlake.llm import oracle, queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute_force(rows):
    """All nodes from all prefixes of all rebuilt conversations, one by one."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv_id].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(head, [])[:h]) + tuple(turns[h:])
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        below = children[prefix]
        own_saved = (len(members[prefix]) - 1) * len(prefix[-1][1]) if prefix else 0
        leaves[prefix] = sum(leaves[b] for b in below) if below else 1
        saved[prefix] = own_saved + sum(saved[b] for b in below)
    return sorted(
        (
            min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children[p]),
            leaves[p], saved[p],
            hashlib.sha256(",".join(str(c) for c in sorted(ids) if rebuilt[c] == p).encode()).hexdigest(),
        )
        for p, ids in members.items()
    )


def found(frame):
    return sorted(tuple(r) for r in frame.collect())


def small_shards(monkeypatch):
    """So many splitters that most nodes with more than one member are in the skeleton."""
    monkeypatch.setattr(trie, "SHARD_BYTES", 200)
    monkeypatch.setattr(trie, "CHUNK_BYTES", 8)


def test_query_against_sql_and_prefixes(spark):
    result = queries.queries()["op12_conversation_trie"](spark, FOLDER)
    assert result.dtypes == [tuple(c.split()) for c in trie.COLUMNS.split(", ")]
    table = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    expected = brute_force([tuple(r) for r in table.collect()])
    assert found(result) == expected
    db = duckdb.connect()
    db.execute(f"create view conversations as from '{FOLDER}/conversations.parquet'")
    columns = ", ".join(c.split()[0] for c in trie.COLUMNS.split(", "))
    assert sorted(db.execute(f"select {columns} from ({oracle.CONVERSATION_TRIE})").fetchall()) == expected


def conversations(n, text=lambda c, t: f"text {t} of {c % 7 if t else 0}", turns=lambda c: 2 + c % 9):
    return [(c, t, "user" if t % 2 == 0 else "assistant", text(c, t)) for c in range(n) for t in range(turns(c))]


@pytest.mark.parametrize("rows", [
    conversations(400),
    conversations(700, text=lambda c, t: "the same"),
    conversations(150, turns=lambda c: 400 if c == 70 else 1 + c % 3),
    conversations(120, turns=lambda c: 1),
], ids=["shared", "one path for all", "one long", "turnless"])
def test_shards_change_nothing(spark, monkeypatch, rows):
    small_shards(monkeypatch)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(trie.conversation_trie(frame)) == brute_force(rows)


def test_hot_path_is_cut_between_its_ids(spark, monkeypatch):
    small_shards(monkeypatch)
    rows = conversations(600, text=lambda c, t: "the same", turns=lambda c: 8)
    paths = trie.rebuild(spark.createDataFrame(rows, SCHEMA))
    splitters = trie.split(paths, 8)
    assert len({path for path, _ in splitters}) < len(splitters) > 20


def test_skeleton_is_bounded(spark, monkeypatch):
    rows = conversations(300)
    paths = trie.rebuild(spark.createDataFrame(rows, SCHEMA)).cache()
    monkeypatch.setattr(trie, "SHARD_BYTES", 1)
    monkeypatch.setattr(trie, "SKELETON_BYTES", 16 * 16 * trie.SAMPLES * 10)
    assert len(trie.split(paths, 8)) <= 16


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(
    st.one_of(st.none(), st.integers(-105, 5), st.integers(95, 205)),
    st.one_of(st.none(), st.integers(-1, 3)),
    st.sampled_from([None, "", "user", "u"]), st.sampled_from([None, "", "a", "ser", "é\U0001f600"]),
), max_size=60))
def test_odd_rows(spark, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", conv string")
    assert found(trie.conversation_trie(frame)) == brute_force(rows)


def test_very_long_texts_and_clashing_columns(spark):
    rows = [(c, t, "user", "word " * 200_000 + str(t)) for c in (1, 2, 100) for t in range(3)]
    clashing = ", path string, chars string, `CONV_ID` string, node string, shard string"
    frame = spark.createDataFrame([(*r, *"abcde") for r in rows], SCHEMA + clashing)
    assert found(trie.conversation_trie(frame)) == brute_force(rows)


def test_no_conversations(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []


def test_scanned_rows_do_not_carry_texts(spark):
    frame = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    plan = trie.rebuild(frame)._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert plan.count("Exchange") == 1 and "text" not in exchange
