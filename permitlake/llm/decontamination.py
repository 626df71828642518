"""Operator 6: benchmark decontamination by spaced seeds.

A mask looks at some of SPAN neighbouring tokens and ignores the others. The hashes of all
masked windows of the benchmark are joined with those of all documents; a hit fixes a
diagonal, the shift between the two texts. The tokens on both sides are then compared along
the diagonal: a window of WINDOW tokens that agree in SHARE of the places is an overlap,
whatever stands in the other places. Masks of this shape hit every such window: of 12 or 13
tokens with any two substituted, one placement always avoids both (tests/llm check all cases).

An item of fewer than SHORT tokens is sought as a whole, by masks for its length: it is cut
into blocks, and a mask leaves out as many of them as tokens may be substituted. Documents
are looked through only for the short lengths that the benchmark has.

DataFrame functions only.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitlake.llm.common import cut_lineage, pick, sized

# Tokens that a mask compares, of SPAN in a row.
MASKS = ((0, 1, 3, 6, 7), (0, 1, 4, 6, 7))
SPAN = 8
WINDOW = 13
SHARE = 0.8
SHORT = 12  # tokens of an item from which MASKS hit all its windows


def _tokens(text: str) -> Column:
    """Hashes of the words: runs of letters and digits, lower-cased."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def short_masks(length: int) -> list[tuple[int, ...]]:
    """Masks over a whole item, of which one avoids any substitutions that SHARE allows."""
    allowed = length - math.ceil(length * SHARE)
    blocks = [range(length)[k :: 2 * allowed + 1] for k in range(2 * allowed + 1)] if allowed else []
    return [
        tuple(o for o in range(length) if not any(o in block for block in left_out))
        for left_out in itertools.combinations(blocks, allowed)
    ]


def _seeds(
    rows: DataFrame, span: int, masks: list[tuple[int, ...]], *keep: str | Column
) -> DataFrame:
    """The hash of every masked window of the column `tokens`: keep..., place, key."""
    n = F.size("tokens") - span + 1

    def windows(number: int, mask: tuple[int, ...]) -> Column:
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.xxhash64(
                F.lit(span), F.lit(number), *[F.get(F.col("tokens"), i + o) for o in mask]
            ),
        )

    keys = F.concat(*[windows(k, m) for k, m in enumerate(masks)])
    exploded = rows.filter(F.size("tokens") >= span).select(
        *keep, n.alias("n"), F.posexplode(keys).alias("at", "key")
    )
    names = [c for c in exploded.columns if c not in ("n", "at", "key")]
    return exploded.select(*names, (F.col("at") % F.col("n")).alias("place"), "key")


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The benchmark items that overlap each document: one row per document and item.

    Returns doc_id, text_hash, item_id, share (the largest share of agreeing tokens in a
    window), matched (agreeing tokens on that diagonal), item_words, doc_start (the first
    token of the document on that diagonal).

    Null and empty texts overlap nothing. A window of an item shorter than WINDOW is the whole
    item, however short: one of fewer than five tokens overlaps only verbatim, and may be
    common language. Equal items are searched once and all returned;
    rows of equal id and text are returned once, a null id like any other. Of several diagonals the
    one of the largest share counts, then of most matches, then the lowest.
    """
    items = pick(benchmark, "item_id", "text").select(
        "item_id", _tokens("text").alias("tokens")
    ).filter(F.size("tokens") > 0)
    items = items.groupBy("tokens").agg(F.collect_set(F.struct("item_id")).alias("item_ids"))
    items = cut_lineage(items.withColumn("item", F.xxhash64("tokens")))
    size = F.size("tokens")
    lengths = sorted(
        row[0] for row in items.select(F.least(size, F.lit(SHORT)).alias("n")).distinct().collect()
    )
    shapes = {n: (n, short_masks(n)) if n < SHORT else (SPAN, MASKS) for n in lengths or [SHORT]}
    seeds = functools.reduce(DataFrame.union, [
        _seeds(items.filter(F.least(size, F.lit(SHORT)) == n), *shape, "item")
        for n, shape in shapes.items()
    ])
    seeds = cut_lineage(seeds.distinct().withColumnRenamed("place", "item_place"))
    docs = pick(documents, "doc_id", "text").filter(F.col("text").isNotNull())
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    hashed = docs.select("text_hash", _tokens("text").alias("tokens"))
    windows = functools.reduce(
        DataFrame.union, [_seeds(hashed, *shape, "text_hash") for shape in shapes.values()]
    )
    diagonal = (F.col("place") - F.col("item_place")).alias("diagonal")
    hits = cut_lineage(
        windows.join(sized(seeds), "key").select("text_hash", "item", diagonal).distinct()
    )
    wanted = sized(cut_lineage(hits.select("text_hash").distinct()))
    # Kept, as generated code would split the text again for each diagonal it is joined with.
    suspects = cut_lineage(docs.join(wanted, "text_hash").select(
        "doc_id", "text_hash", _tokens("text").alias("tokens")
    ))
    lengths_of = items.select("item", F.size("tokens").alias("item_words"))
    aimed = hits.join(sized(lengths_of), "item")
    # Of the document only the item's stretch on the diagonal goes on; its other tokens stay in
    # the task that has just read them. A text that repeats itself has the same stretch on many
    # diagonals: the lowest one stands for all, as the shares are the same.
    lead = F.least(F.greatest(F.lit(0), -F.col("diagonal")), F.col("item_words"))
    stretch = F.slice(
        F.col("tokens"), F.greatest(F.col("diagonal"), F.lit(0)) + 1,
        F.greatest(F.lit(0), F.least(F.col("item_words") - lead, F.size("tokens") - F.greatest(F.col("diagonal"), F.lit(0)))),
    )
    stretches = (
        suspects.join(sized(aimed), "text_hash")
        .select("doc_id", "text_hash", "item", "diagonal", "item_words", lead.alias("lead"), stretch.alias("own"))
        .groupBy("doc_id", "text_hash", "item", "lead", "own", "item_words")
        .agg(F.min("diagonal").alias("diagonal"))
    )
    pairs = stretches.join(
        sized(items.select("item", "item_ids", F.col("tokens").alias("item_tokens"))), "item"
    )
    agree = F.zip_with(
        F.col("own"), F.slice(F.col("item_tokens"), F.col("lead") + 1, F.size("own")),
        lambda a, b: (a == b).cast("int"),
    )
    width = F.least(F.lit(WINDOW), F.size("item_tokens"))
    best = F.array_max(F.transform(
        F.sequence(F.lit(0), F.size("agree") - F.col("width")),
        lambda i: F.aggregate(F.slice("agree", i + 1, F.col("width")), F.lit(0), lambda a, b: a + b),
    ))
    checked = (
        pairs.select(
            "doc_id", "text_hash", "item", "item_ids", "diagonal",
            "item_words", F.col("lead").alias("from"),
            agree.alias("agree"), width.alias("width"),
        )
        .filter(F.size("agree") >= F.col("width"))
        .withColumn("best", best)
        .filter(F.col("best") >= F.ceil(F.col("width") * SHARE))
    )
    found = checked.select(
        "doc_id", "text_hash", "item", "item_ids", "item_words",
        F.struct(
            (F.col("best") / F.col("width")).alias("share"),
            F.aggregate("agree", F.lit(0), lambda a, b: a + b).alias("matched"),
            (-F.col("diagonal")).alias("shift"),
            (F.col("from") + F.col("diagonal")).alias("doc_start"),
        ).alias("found"),
    )
    return (
        found.groupBy("doc_id", "text_hash", "item")
        .agg(F.max("found").alias("found"), F.first("item_ids").alias("item_ids"),
             F.first("item_words").alias("item_words"))
        .select("doc_id", "text_hash", F.explode("item_ids.item_id").alias("item_id"),
                "found.share", "found.matched", "item_words", "found.doc_start")
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `documents`, all columns, whose text overlaps no benchmark item."""
    found = cut_lineage(overlaps(documents, benchmark).select("text_hash").distinct())
    text = documents.columns.index("text")
    held = documents.toDF(*[f"_{i}" for i in range(len(documents.columns))])
    kept = held.withColumn("text_hash", F.xxhash64(f"_{text}")).join(
        sized(found), "text_hash", "left_anti"
    )
    return kept.drop("text_hash").toDF(*documents.columns)
