"""Operator 11."""

import re

import pytest
from odd_rows import no_documents, odd_documents, rows

from permitlake.llm import queries
from permitlake.llm.license_scan import (
    NOTICES, PHRASES, Template, find_licenses, label_documents, template_words,
)

FOLDER = "/root/testdata/sf0.001"
FILL = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def base_of(text):
    """What the contract asks of phrases, by looking at every place."""
    words = words_of(text)
    places = [
        (i, t.label) for t in PHRASES for i in range(len(words))
        if words[i : i + len(t.text.split())] == t.text.split()
    ]
    starts = [i for i, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({label for _, label in places})),
    )


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def check_base(found, texts):
    assert len(found) == len(texts)
    for row in found:
        got = (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels)
        assert got == base_of(texts[row.doc_id])
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
        assert 0 <= row.score <= 1


def test_query_against_every_place(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = queries.queries()["op11_license_scan"](spark, FOLDER).collect()
    check_base(found, texts)
    assert any(r.n_base for r in found)


def test_phrases_in_odd_places(spark):
    texts = [
        "MIT License", "mit\x00license!", "M\u0130T LICENSE mit license", "\u212A mit license \u212Aappa", "mit licenses", "x mit license",
        "cc by cc by-cc   BY", "Apache, License of the GNU\nGeneral Public License",
        "gnu general public gnu general public license", "Kappa mit K license mit license",
        "é mit license é", "gnu general public", "", "   ", "cc", "by cc", "mit0 license",
    ]
    check_base(label_documents(documents(spark, texts)).collect(), texts)


def test_one_phrase_many_times(spark):
    """A megabyte of one phrase: every place is counted, in groups that stream."""
    texts = ["cc by " * 170_000, "word " * 200_000, "cc by"]
    check_base(label_documents(documents(spark, texts)).collect(), texts)


def notice(label, start):
    return next(t for t in NOTICES if t.label == label and t.text.startswith(start))


@pytest.mark.parametrize("words_in", [0, 1, 3])
def test_changed_notice_is_verified_on_neighbouring_diagonals(spark, words_in):
    own = template_words(notice("isc", "Permission to use").text)
    changed = FILL + own[:12] + FILL[:words_in] + own[12:25] + own[26:] + FILL
    found = find_licenses(documents(spark, [" ".join(changed)])).collect()
    assert [(r.label, r.first_word) for r in found] == [("isc", len(FILL))]
    assert found[0].end_word == len(changed) - len(FILL)
    assert 0.8 <= found[0].similarity < 1


def test_part_of_a_notice_is_not_one(spark):
    own = template_words(notice("isc", "Permission to use").text)
    texts = [" ".join(own[: len(own) // 2]), " ".join(reversed(own)), " ".join(own[::2])]
    found = {r.doc_id: r for r in label_documents(documents(spark, texts)).collect()}
    assert all(r.labels == "" for r in found.values())
    assert found[0].score == pytest.approx(0.5, abs=0.1) and found[1].score == 0


def test_two_copies_are_two_spans(spark):
    text = notice("bsd", "Redistribution and use").text
    found = find_licenses(documents(spark, [f"{text} {' '.join(FILL)} {text}"])).collect()
    n = len(template_words(text))
    assert sorted(r.first_word for r in found) == [0, n + len(FILL)]


def test_long_template_goes_by_sections(spark):
    long = " ".join(f"w{i}" for i in range(500))
    found = find_licenses(documents(spark, [f"a b {long} c"]), [Template("own", long)]).collect()
    assert sorted((r.first_word, r.end_word) for r in found) == [(2, 194), (194, 386), (386, 502)]
    assert all(r.similarity == 1 for r in found)


def test_every_given_notice_is_found(spark):
    found = label_documents(documents(spark, [t.text for t in NOTICES])).collect()
    assert all(NOTICES[r.doc_id].label in r.labels.split(",") and r.score == 1 for r in found)


def test_odd_documents(spark):
    found = label_documents(odd_documents(spark)).collect()
    assert len(found) == len(rows())
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted([(r.doc_id, r.n_words, r.n_base, r.labels, r.score) for r in found], key=key)
    assert got == sorted([(r[0], len(words_of(r[1])), 0, "", 0.0) for r in rows()], key=key)


def test_repeated_rows_and_missing_ids(spark):
    frame = [(9, "The MIT License")] * 3 + [(None, "mit license")] * 2 + [(9, "other")]
    found = label_documents(spark.createDataFrame(frame, "doc_id bigint, text string")).collect()
    counted = sorted((r.doc_id is None, r.n_words, r.n_base, r.first_word) for r in found)
    assert counted == sorted(
        [(False, 3, 1, 1)] * 3 + [(True, 2, 1, 0)] * 2 + [(False, 1, 0, None)], key=str
    )
    assert label_documents(no_documents(spark)).collect() == []
    assert find_licenses(no_documents(spark)).collect() == []


def test_no_python_and_one_broadcast(spark):
    """Splitting, hashing and the join are one stage: its input is the scan, its output hits."""
    found = queries.queries()["op11_license_scan"](spark, FOLDER)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert plan.count("FileScan") == 1 and "BroadcastHashJoin [key" in plan
