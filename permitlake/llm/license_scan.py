"""Operator 11: license scans by diagonal voting.

All rolling word k-grams of all documents are joined with the places of the same grams in
fixed templates. A hit votes for a diagonal: the document's place less the template's, so the
votes of one copy of a template fall on one diagonal, whatever stands around it. Words left
out or put in move the rest of a copy to a neighbouring diagonal; runs of neighbours are
merged. A run is verified by the template's words that its grams cover: their number against
the longer of the template and of the span in the document.

Short phrases (grams of two words) count where all their words stand on one diagonal; notices
(grams of five) from a similarity of 0.8. Grams are joined by hash and compared word by word in
the same join, so no hash decides a result.

DataFrame functions only. The grams are never written anywhere: splitting, hashing and the
join with the templates are one stage, and only hits and one row per document are shuffled.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permitlake.llm.common import pick, sized

PHRASE_GRAM = 2
NOTICE_GRAM = 5
SHARE = 0.8
SHIFT = 3  # words left out or put in between two places of one copy
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between words, once A-Z are lower-cased
SECTION = 192  # words; longer templates are sought as sections of this length
_BITS = 64


class Template(NamedTuple):
    label: str
    text: str
    phrase: bool = False  # sought verbatim


# Phrases with their labels, and the opening or granting sentences of public
# licenses as their stewards publish them.
PHRASES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]
NOTICES = [
    Template("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    Template("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by", "Licensed under CC BY 4.0"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Template("cc0", "has waived all copyright and related or neighboring rights to this work"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("mit", "Released under the MIT License"),
    Template("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]

_DOC = ("doc_id", "h1", "h2", "n_words")
_COVERS = [f"cover{j}" for j in range(SECTION // _BITS)]


def template_words(text: str) -> list[str]:
    """The words of a template, as those of documents."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [w for w in re.split(SEPARATORS, lowered) if w]


def _sections(templates: list[Template]) -> list[tuple[Template, list[str], int]]:
    """(template, words, gram) of all sections. Each has one gram at least."""
    found = []
    for template in templates:
        words = template_words(template.text)
        for at in range(0, max(len(words), 1), SECTION):
            part = words[at : at + SECTION]
            gram = min(PHRASE_GRAM if template.phrase else NOTICE_GRAM, len(part))
            if gram:
                found.append((template, part, gram))
    return found


def _signed(bits: int) -> int:
    return bits - (1 << _BITS) if bits >> (_BITS - 1) else bits


def _gram_key(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def _template_grams(spark, sections) -> DataFrame:
    """key, gram, template, label, phrase, words, template_at and the words that it covers as
    bits: one row per place of a gram. The gram '' stands for a document itself."""
    schema = (
        "gram string, gram_words array<string>, template int, label string, phrase boolean, "
        "template_words int, template_at int, " + ", ".join(f"{c} bigint" for c in _COVERS)
    )
    rows = [("", [], -1, None, False, 0, 0, *[0] * len(_COVERS))]
    for number, (template, words, gram) in enumerate(sections):
        for at in range(len(words) - gram + 1):
            bits = ((1 << gram) - 1) << at
            covers = [_signed(bits >> (_BITS * j) & (1 << _BITS) - 1) for j in range(len(_COVERS))]
            own = words[at : at + gram]
            rows.append((" ".join(own), own, number, template.label, template.phrase, len(words), at, *covers))
    frame = spark.createDataFrame(rows, schema)
    key = F.lit(0).cast("bigint")
    for size in sorted({gram for *_, gram in sections}):
        own = [F.get("gram_words", F.lit(o)) for o in range(size)]
        key = F.when(F.size("gram_words") == size, _gram_key(own)).otherwise(key)
    return frame.select(key.alias("key"), *[c for c in frame.columns if c != "gram_words"])


def _lowered(text: Column) -> Column:
    """A-Z in lower case. lower() also changes letters that no template has, which is faster and
    makes no difference here, but for the two of them that it turns into ASCII letters."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    turned = text.contains("\u212A") | text.contains("\u0130")  # Kelvin sign, dotted I
    return F.when(turned, F.translate(text, capitals, capitals.lower())).otherwise(F.lower(text))


def _hits(documents: DataFrame, sections) -> DataFrame:
    """Places of documents that hold a gram of a template, and one row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = pick(documents, "doc_id", "text").select(
        "doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"),
        F.split(_lowered(text), SEPARATORS).alias("found"),
    )
    lead = F.when(F.get("found", F.lit(0)) == "", 1).otherwise(0)
    tail = F.when(F.get("found", F.size("found") - 1) == "", 1).otherwise(0)
    docs = docs.withColumn("lead", lead).withColumn(
        "n_words", F.greatest(F.lit(0), F.size("found") - F.col("lead") - tail)
    )
    sizes = sorted({gram for *_, gram in sections})
    each = docs.select(
        "*", F.explode(F.sequence(F.lit(-1), F.col("n_words") * len(sizes) - 1)).alias("i")
    ).withColumn("doc_at", F.expr(f"cast(i div {len(sizes)} as int)"))
    key = F.when(F.col("i") < 0, F.lit(0).cast("bigint"))
    gram = F.when(F.col("i") < 0, F.lit(""))
    for number, size in enumerate(sizes):
        mine = (F.col("i") % len(sizes) == number) & (F.col("doc_at") + size <= F.col("n_words"))
        words = [F.get("found", F.col("lead") + F.col("doc_at") + o) for o in range(size)]
        key = key.when(mine, _gram_key(words))
        gram = gram.when(mine, F.concat_ws(" ", *words))
    templates = sized(_template_grams(documents.sparkSession, sections)).withColumnRenamed(
        "key", "template_key"
    )
    # Not an equality of the join, or each gram would be put together, met or not. A place without
    # a gram has a key and no words, so that the key needs no check for null, a second hashing.
    same = F.coalesce(gram == F.col("gram"), F.lit(False))
    met = each.withColumn("key", key.otherwise(F.lit(0).cast("bigint"))).join(
        templates, (F.col("key") == F.col("template_key")) & same
    )
    return met.withColumn("gram_words", F.size(F.split("gram", " "))).select(
        *_DOC, "template", "label", "phrase", "template_words", "doc_at", "gram_words",
        (F.col("doc_at") - F.col("template_at")).alias("diagonal"), *_COVERS,
    )


def _similarity(first: str, last: str) -> Column:
    covered = functools.reduce(lambda a, b: a + b, [F.bit_count(c) for c in _COVERS])
    return covered / F.greatest(F.col("template_words"), F.col(last) - F.col(first), F.lit(1))


def _spans(documents: DataFrame, templates: list[Template]) -> DataFrame:
    """Merged diagonals with their similarity, and one row of template -1 per document, whose
    `votes` is the number of its copies."""
    own = [*_DOC, "template", "label", "phrase", "template_words"]
    covers = [F.bit_or(c).alias(c) for c in _COVERS]
    diagonals = (
        _hits(documents, _sections(templates))
        .groupBy(*own, "diagonal")
        .agg(
            F.min("doc_at").alias("first"), F.max(F.col("doc_at") + F.col("gram_words")).alias("last"),
            F.count(F.lit(1)).alias("votes"), *covers,
        )
        .withColumn("alone", _similarity("first", "last"))
    )
    order = Window.partitionBy(*_DOC, "template").orderBy("diagonal")
    apart = F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(order) > SHIFT)
    runs = diagonals.withColumn("opens", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "run", F.sum("opens").over(order)
    )
    merged = runs.groupBy(*own, "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("alone").alias("alone"),
        F.min("diagonal").alias("diagonal"), F.sum("votes").alias("votes"), *covers,
    )
    similarity = F.greatest("alone", _similarity("first", "last"))
    return merged.withColumn("similarity", similarity).drop("alone", *_COVERS)


def _is_base() -> Column:
    return F.col("phrase") & (F.col("similarity") >= 1)


def _is_found() -> Column:
    return F.col("label").isNotNull() & (
        F.col("similarity") >= F.when(F.col("phrase"), 1.0).otherwise(SHARE)
    )


def find_licenses(
    documents: DataFrame, templates: list[Template] | None = None
) -> DataFrame:
    """The verified spans: doc_id, label, phrase, first_word, end_word (words from 0, the end
    exclusive), similarity. Rows of equal id and text are reported once.

    Null and empty texts have no span. Of templates that share words, each is reported.
    """
    spans = _spans(documents, PHRASES + NOTICES if templates is None else templates)
    return spans.filter(_is_found()).select(
        "doc_id", "label", "phrase", F.col("first").alias("first_word"),
        F.col("last").alias("end_word"), "similarity",
    )


def label_documents(
    documents: DataFrame, templates: list[Template] | None = None
) -> DataFrame:
    """One row per row of `documents`, repeated ones included: doc_id, n_words, n_base (places of
    phrases), first_word, last_word (their smallest and largest start), base_labels, labels (of
    phrases, of all templates; distinct, sorted, comma-joined) and score (the largest similarity
    of any span, verified or not; 0 without one).

    A null text is an empty one: no words, no labels, score 0. A null id is kept as any other.
    """
    spans = _spans(documents, PHRASES + NOTICES if templates is None else templates)

    def joined(condition: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(condition, F.col("label")))), ",")

    by_doc = spans.groupBy(*_DOC).agg(
        F.count(F.when(_is_base(), 1)).alias("n_base"),
        F.min(F.when(_is_base(), F.col("diagonal"))).cast("bigint").alias("first_word"),
        F.max(F.when(_is_base(), F.col("diagonal"))).cast("bigint").alias("last_word"),
        joined(_is_base()).alias("base_labels"), joined(_is_found()).alias("labels"),
        F.max(F.when(F.col("template") >= 0, F.col("similarity")).otherwise(0.0)).alias("score"),
        F.max(F.when(F.col("template") < 0, F.col("votes"))).alias("copies"),
    )
    return by_doc.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), "n_base", "first_word",
        "last_word", "base_labels", "labels", "score",
    )
