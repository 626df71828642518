"""Operator 3: secret scans with a random forest that removes false positives.

A scan takes every long run of key characters as a candidate, and every value with a digit
or sign that is assigned to a key word, at each of its places. A forest, trained from
labelled findings, then tells secrets from the rest by length, character transitions,
dictionary coverage, path signs and neighbouring words.

DataFrame functions and Spark's own forest only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitlake.llm.common import cut_lineage, pick, sized

MIN_LENGTH = 16
RUN = rf"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{{{MIN_LENGTH},}}+"
SHORT_LENGTH = 6  # characters of an assigned value, at least
BEFORE, AFTER = 40, 20  # characters of context
DICTIONARY = 400  # most frequent words that coverage is measured with
SHORTEST = 3  # letters of a dictionary word
TRAIN_ROWS = 20_000  # labelled findings that the forest is grown on, at most
TREES, DEPTH, SEED = 40, 6, 7
THRESHOLD = 0.5
MASK = "[SECRET]"

KEY_WORD = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)"
_WORD = KEY_WORD.replace("(?i)(", "(?i:").replace("(word", "(?:word")
# A name that has a key word, a sign and a value, whatever stands between them. It starts where
# the name starts and goes on without a step back, so it reads a text once, however long the
# name or the space is. Group 1 is the value, which ends the match; what it must have is
# looked at afterwards.
VALUE = (
    r"(?<![A-Za-z0-9_\-])(?=[A-Za-z0-9_\-]*?" + _WORD + r")[A-Za-z0-9_\-]++[\"']?+\s*+[:=]\s*+[\"']?+"
    rf"([^\s\"'`,;<>=:][^\s\"'`,;<>]{{{SHORT_LENGTH - 2},}}[^\s\"'`,;<>.:?()\[\]{{}}])"
)
NO_WORD = r"[0-9!@#$%^&*+/_~\-]"  # a value has one of these
PROVIDER = r"^(AKIA|ASIA|AGPA|AIDA|AROA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-"
PLACEHOLDER = r"(?i)example|placeholder|changeme|your[_-]|xxxx|(.)\1{7}"

FEATURES = [
    "length", "digits", "uppers", "lowers", "signs", "vowels", "variety", "turns", "case_turns",
    "digit_turns", "covered", "slashes", "dashes", "path_before", "path_after", "dot_after", "mail", "assigned",
    "key_word", "equals", "quoted", "word_before", "word_after",
]


def frequent_words(documents: DataFrame) -> list[str]:
    """The DICTIONARY most frequent lower-case ASCII words of at least SHORTEST letters.

    Counted over all documents; ties go to the lower word.
    """
    words = F.explode(F.split(F.lower("text"), r"[^a-z]+"))
    counted = (
        pick(documents, "text").select(words.alias("word"))
        .filter(F.length("word") >= SHORTEST)
        .groupBy("word").agg(F.count("*").alias("n"))
    )
    top = counted.orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()
    return [row["word"] for row in top]


_BLOCK = 256


def _sums(lengths: str) -> Column:
    """The sums of a list's first numbers: after the first, after the second, and so on.

    By blocks, as a list that grows by one is copied each time.
    """
    def along(numbers: Column, start: Column) -> Column:
        return F.aggregate(
            numbers, F.array().cast("array<int>"),
            lambda known, n: F.concat(known, F.array(
                F.coalesce(F.get(known, F.size(known) - 1), start) + n
            )),
        )

    first = F.sequence(F.lit(1), F.size(lengths), F.lit(_BLOCK))
    blocks = F.transform(first, lambda at: F.slice(lengths, at, F.lit(_BLOCK)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n))
    before = F.concat(F.array(F.lit(0)), along(totals, F.lit(0)))
    whole = F.flatten(F.transform(blocks, lambda b, k: along(b, F.get(before, k))))
    return F.when(F.size(lengths) > 0, whole).otherwise(F.array().cast("array<int>"))


def candidates(documents: DataFrame) -> DataFrame:
    """Each place of each candidate of each row: row, doc_id, text_hash, candidate, start,
    before, after, in_value.

    Candidates are runs of key characters and the values of key words (`in_value`); where both
    start at one place the value counts, which may be longer. `row` is a number of the row.
    `start` counts characters from 0; the context is that of the place. Null and empty texts
    have none.
    """
    text = F.col("text")

    def matches(pattern: str, group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def between(pattern: str, whole: str) -> Column:
        return F.when(F.size(whole) > 0, F.split(text, pattern, -1))

    def steps(outside: str, whole: str) -> Column:
        """Characters from the end of one match to the end of the next."""
        return F.zip_with(
            F.slice(outside, F.lit(1), F.size(whole)), whole, lambda a, b: F.length(a) + F.length(b)
        )

    def listed(found: str, ends: str, in_value: bool) -> Column:
        return F.zip_with(found, ends, lambda c, end: F.struct(
            c.alias("candidate"), (end - F.length(c)).alias("start"), F.lit(in_value).alias("in_value")
        ))

    docs = pick(documents, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text",
        matches(VALUE, 0).alias("assignments"), matches(RUN, 0).alias("runs"),
    ).filter((F.size("assignments") > 0) | (F.size("runs") > 0))
    # What stands between the matches tells where each ends; one step after the other, so that
    # nothing is computed again for every element.
    docs = docs.withColumns({
        "values": F.when(F.size("assignments") > 0, matches(VALUE, 1)).otherwise(F.col("assignments")),
        "outside_values": F.coalesce(between(VALUE, "assignments"), F.array().cast("array<string>")),
        "outside_runs": F.coalesce(between(RUN, "runs"), F.array().cast("array<string>")),
    })
    docs = docs.withColumns({
        "value_steps": steps("outside_values", "assignments"), "run_steps": steps("outside_runs", "runs"),
    })
    docs = docs.withColumns({"value_ends": _sums("value_steps"), "run_ends": _sums("run_steps")})
    docs = docs.withColumn("own_values", F.filter(
        listed("values", "value_ends", True), lambda v: v["candidate"].rlike(NO_WORD)
    ))
    docs = docs.withColumn("value_starts", F.transform("own_values", lambda v: v["start"]))
    both = F.concat("own_values", listed("runs", "run_ends", False))
    taken = F.array_contains("value_starts", F.col("start"))
    places = docs.select("row", "doc_id", "text", "value_starts", F.inline(both)).filter(
        F.col("in_value") | ~taken
    )
    at = F.col("start") + 1
    first = F.greatest(at - BEFORE, F.lit(1))
    return places.select(
        "row", "doc_id", F.xxhash64("text").alias("text_hash"), "candidate", "start",
        F.substr(text, first, at - first).alias("before"),
        F.substr(text, at + F.length("candidate"), F.lit(AFTER)).alias("after"), "in_value",
    )


def with_features(found: DataFrame, dictionary: list[str]) -> DataFrame:
    """The columns FEATURES as doubles, beside those of `candidates`."""
    c = F.col("candidate")
    before, after = F.col("before"), F.col("after")
    length = F.length(c)

    def share(pattern: str) -> Column:
        return (length - F.length(F.regexp_replace(c, pattern, ""))) / length

    def turns(text: Column) -> Column:
        return (F.length(F.regexp_replace(text, r"(.)\1+", "$1")) - 1) / length

    # One sign per character class: vowel, other letter, capital, digit, sign.
    classes = F.regexp_replace(c, "[aeiou]", "v")
    classes = F.regexp_replace(classes, "[b-df-hj-np-tw-z]", "c")
    classes = F.regexp_replace(classes, "[A-Z]", "U")
    classes = F.regexp_replace(F.regexp_replace(classes, "[0-9]", "9"), r"[+/_\-]", ".")
    cases = F.regexp_replace(F.regexp_replace(classes, "[vc]", "a"), r"[9.]", "")
    kinds = F.regexp_replace(classes, "[vcU]", "a")
    pieces = "|".join(sorted(map(re.escape, dictionary), key=lambda w: (-len(w), w)))
    covered = share(f"(?i){pieces}") if pieces else F.lit(0.0)
    values = {
        "length": length,
        "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"),
        "signs": share(r"[+/_\-]"), "vowels": share("(?i)[aeiou]"),
        "variety": F.size(F.array_distinct(F.split(c, ""))) / length,
        "turns": turns(classes), "case_turns": turns(cases), "digit_turns": turns(kinds),
        "covered": covered,
        "slashes": F.length(F.regexp_replace(c, "[^/]", "")),
        "dashes": F.length(F.regexp_replace(c, "[^_-]", "")),
        "path_before": before.rlike(r"[/\\.][\w.]*$|://\S*$"),
        "path_after": after.rlike(r"^[./\\]\w"),
        "dot_after": after.rlike(r"^[.,;:!?]?(\s|$)"),
        "mail": before.rlike(r"@\S*$") | after.rlike(r"^\S*@"),
        "assigned": F.col("in_value"), "key_word": F.col("in_value") | before.rlike(KEY_WORD),
        "equals": before.rlike(r"[:=]\s*[\"']?$"), "quoted": before.rlike(r"[\"']$"),
        "word_before": F.length(F.regexp_extract(before, r"(\S*)\s*$", 1)),
        "word_after": F.length(F.regexp_extract(after, r"^\S*\s*(\S*)", 1)),
    }
    return found.select(
        *found.columns,
        *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"f_{k}") for k, v in values.items()],
    )


def format_labels() -> Column:
    """A label for findings that their format settles, null for all others.

    1: a provider's key format, or a value with letters and digits that is assigned to a key
    word. 0: placeholders, plain words, numbers, parts of addresses.
    """
    c = F.col("candidate")
    mixed = c.rlike("[0-9]") & c.rlike("[A-Za-z]")
    return (
        F.when(c.rlike(PLACEHOLDER), 0)
        .when(c.rlike(PROVIDER), 1)
        .when((F.col("f_assigned") > 0) & mixed, 1)
        .when(c.rlike(r"^[A-Za-z]?[a-z]+$|^[A-Z]+$|^[0-9]+$") & (F.col("f_assigned") == 0), 0)
        .when(F.col("f_mail") > 0, 0)
    )


@dataclass
class Forest:
    """The trained forest; without both labels there is none, and formats alone decide.

    What they leave open then counts as a secret: nothing is removed on a guess.
    """

    model: RandomForestClassificationModel | None

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds `probability`, that the finding is a secret."""
        if self.model is None:
            settled = F.coalesce(format_labels(), F.lit(1)).cast("double")
            return rows.withColumn("probability", settled)
        scored = self.model.transform(_assembled(rows))
        return scored.withColumn("probability", vector_to_array("probability")[1]).drop("features")


def _assembled(rows: DataFrame) -> DataFrame:
    columns = [f"f_{name}" for name in FEATURES]
    return VectorAssembler(inputCols=columns, outputCol="features").transform(rows)


def train(labelled: DataFrame) -> Forest:
    """Grow the forest from rows of `with_features` with a column `label` (0 or 1).

    At most TRAIN_ROWS of them, those of the smallest hashes, half of each label; a sample of
    that bound is enough for trees of this depth, at any input size.
    """
    rows = labelled.filter(F.col("label").isin(0, 1))
    halves = [
        rows.filter(F.col("label") == label)
        .select("label", "candidate", *[f"f_{name}" for name in FEATURES])
        .orderBy(F.xxhash64("candidate"), "candidate", *[f"f_{name}" for name in FEATURES])
        .limit(TRAIN_ROWS // 2)
        for label in (0, 1)
    ]
    sample = cut_lineage(
        _assembled(halves[0].union(halves[1]).withColumn("label", F.col("label").cast("double")))
        .select("label", "features")
    )
    if sample.select("label").distinct().count() < 2:
        return Forest(None)
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label",
        predictionCol="_predicted", rawPredictionCol="_votes", featureSubsetStrategy="sqrt",
    )
    return Forest(forest.fit(sample))


def scan(documents: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """All findings of all documents with the forest's verdict.

    Returns doc_id, text_hash, candidate, start, starts, length, probability, is_secret: one
    row for each string in a document, with its first place and all of its places, and the
    probability of that place that looks most like a secret's. `labelled`
    holds findings with their label (columns as of `with_features`); without it, findings
    whose format settles the matter are the labels. A repeated row has its findings each
    time; a null doc_id keeps them.
    """
    found = cut_lineage(with_features(candidates(documents), frequent_words(documents)))
    if labelled is None:
        labelled = found.withColumn("label", format_labels())
    forest = train(labelled)
    strings = forest.score(found).groupBy("row", "doc_id", "text_hash", "candidate").agg(
        F.array_sort(F.collect_list("start")).alias("starts"),
        F.max("probability").alias("probability"),
    )
    return strings.select(
        "doc_id", "text_hash", "candidate", F.get("starts", F.lit(0)).alias("start"), "starts",
        F.length("candidate").alias("length"),
        "probability", (F.col("probability") >= THRESHOLD).cast("int").alias("is_secret"),
    )


def redact(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """`documents`, all rows and columns, with MASK in place of every confirmed secret.

    A string that is confirmed at one place of a text is masked at all of them.

    n_chars, if there is such a column, counts the characters of the new text.
    """
    secrets = findings.filter("is_secret = 1").groupBy("text_hash").agg(
        F.collect_set("candidate").alias("secrets")
    )
    # Longest first: a secret may be part of a longer one.
    longest = F.reverse(F.array_sort(F.transform("secrets", lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))))
    secrets = cut_lineage(secrets.select("text_hash", longest.alias("secrets")))
    names = documents.columns
    text = f"_{names.index('text')}"
    held = documents.toDF(*[f"_{i}" for i in range(len(names))])
    joined = held.withColumn("text_hash", F.xxhash64(text)).join(sized(secrets), "text_hash", "left")
    masked = F.aggregate("secrets", F.col(text), lambda t, s: F.replace(t, s["s"], F.lit(MASK)))
    new = F.when(F.col("secrets").isNotNull(), masked).otherwise(F.col(text))
    result = joined.withColumn(text, new)
    if "n_chars" in names:
        count = f"_{names.index('n_chars')}"
        kind = documents.schema["n_chars"].dataType
        counted = F.when(F.col("secrets").isNotNull(), F.length(text).cast(kind)).otherwise(F.col(count))
        result = result.withColumn(count, counted)
    return result.select(*held.columns).toDF(*names)
