"""Operator 10: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has a probability of its own, logistic in the
words it holds; the document's probability is their noisy-or, one minus the product of the
complements. Only documents have labels: the likelihood of the bags trains the weights, and
the sentence probabilities then locate what offends.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitlake.llm.common import encoded, pick, remainder, small_batches

FOLDS = 3
HELD_OUT = 1
THRESHOLD = 0.7
TRAIN_ROWS = 5000  # labelled documents that the weights are fitted on, at most
TRAIN_BYTES = 16384  # of sentences that each of them gives; scoring reads texts of any length
STEMS = (4,)  # bytes; a stem stands for the forms of a word
MIN_DOCUMENTS = 5  # of the training documents must hold a word for it to have a weight
STEPS = 300
RATE = 0.1
SPARSITY = 2e-4
NOISE = 0.02  # share of labels taken to be wrong, either way
LOCATED = 0.5  # a sentence is reported from this probability on

# Sentence ends become line feeds, other ASCII signs spaces; letters are lower-cased.
_FOLD = bytearray(range(256)).lower()
for _i in range(128):
    if not chr(_i).isalnum():
        _FOLD[_i] = 10 if chr(_i) in ".!?\n" else 32
_FOLD = bytes(_FOLD)


def sentences(text: bytes) -> list[tuple[int, int, list[bytes]]]:
    """Byte start, byte end and the words of every sentence that has a word."""
    found, start = [], 0
    for part in text.translate(_FOLD).split(b"\n"):
        words = part.split()
        if words:
            found.append((start, start + len(part), words))
        start += len(part) + 1
    return found


def shortened(text: bytes, size: int = TRAIN_BYTES) -> bytes:
    """A text of at most `size` bytes as it is; of a longer one, sentences from all parts of it,
    evenly spaced, up to `size` bytes. One sentence that is longer gives its first words."""
    if len(text) <= size:
        return text
    share, taken, held = size / len(text), [], 0
    for number, (start, end, _) in enumerate(sentences(text)):
        if int((number + 1) * share) == int(number * share) and taken:
            continue
        part = text[start : min(end, start + size - held)]
        if part:
            taken.append(part)
            held += len(part) + 1
        if held >= size:
            break
    return b"\n".join(taken)[:size]


def units(words: list[bytes]) -> set[bytes]:
    """What a sentence is described by: its words, and their stems of STEMS bytes, each once."""
    found = set(words)
    for length in STEMS:
        found.update([b"^" + word[:length] for word in words if len(word) > length])
    return found


@dataclasses.dataclass
class Bags:
    """Weights of words and the bias of a sentence; `prior` when a class is missing."""

    weights: dict[bytes, float]
    bias: float
    prior: float | None = None

    def score(self, text: bytes) -> tuple[float, list[dict]]:
        """The noisy-or of a text's sentences, and the sentences that offend."""
        if self.prior is not None:
            return self.prior, []
        get = self.weights.get
        none, located = 0.0, []
        plain = -math.log1p(math.exp(self.bias))
        for start, end, words in sentences(text):
            hits = [w for w in (get(unit) for unit in units(words)) if w]
            if not hits:
                none += plain
                continue
            z = min(max(self.bias + sum(sorted(hits)), -30.0), 30.0)
            none -= math.log1p(math.exp(z))
            p = 1 / (1 + math.exp(-z))
            if p >= LOCATED:
                located.append({"start": start, "end": end, "probability": p})
        return -math.expm1(none), located


def train(texts: list[bytes], labels: list[int]) -> Bags:
    """Fit the weights by proximal gradient steps on the likelihood of the bags."""
    y = np.array(labels, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return Bags({}, 0.0, prior=float((y.sum() + 1) / (len(y) + 2)))
    ids: dict[bytes, int] = {}
    last: list[int] = []
    documents: list[int] = []
    word_at, sentence_at, bag_of = [], [], []
    for doc, text in enumerate(texts):
        for _, _, words in sentences(text):
            for word in units(words):
                i = ids.setdefault(word, len(ids))
                if i == len(documents):
                    documents.append(0)
                    last.append(-1)
                if last[i] != doc:
                    last[i] = doc
                    documents[i] += 1
                word_at.append(i)
                sentence_at.append(len(bag_of))
            bag_of.append(doc)
    word_at, sentence_at = np.array(word_at, np.int32), np.array(sentence_at, np.int32)
    bag_of = np.array(bag_of, np.int32)
    common = np.array(documents) >= MIN_DOCUMENTS
    renumbered = np.cumsum(common) - 1
    held = common[word_at]
    word_at, sentence_at = renumbered[word_at[held]], sentence_at[held]
    n_words, n_bags = int(common.sum()), len(y)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / n_bags

    w, b = np.zeros(n_words), -4.0
    moment, second = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for step in range(1, STEPS + 1):
        z = np.clip(np.bincount(sentence_at, w[word_at], len(bag_of)) + b, -30, 30)
        log_none = np.bincount(bag_of, -np.log1p(np.exp(z)), n_bags)
        any_ = -np.expm1(np.minimum(log_none, -1e-12))
        told = NOISE + (1 - 2 * NOISE) * any_
        slope = balance * (told - y) / (told * (1 - told)) * (1 - 2 * NOISE) * (1 - any_)
        by_sentence = slope[bag_of] / (1 + np.exp(-z))
        gradient = np.append(
            np.bincount(word_at, by_sentence[sentence_at], n_words), by_sentence.sum()
        )
        moment = 0.9 * moment + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        size = RATE / (np.sqrt(second / (1 - 0.999**step)) + 1e-6)
        move = size * moment / (1 - 0.9**step)
        w = w - move[:-1]
        b -= move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - size[:-1] * SPARSITY, 0)
    names = [word for word, keep in zip(ids, common, strict=True) if keep]
    kept = {name: float(v) for name, v in zip(names, w, strict=True) if abs(v) > 1e-3}
    return Bags(kept, float(b))


def fit(documents: DataFrame, labelled: DataFrame) -> Bags:
    """Train on up to TRAIN_ROWS labelled documents, those of the smallest id hashes.

    The sample has this many rows of at most TRAIN_BYTES, at any input size; long documents give
    sentences from all their parts. It goes to the driver.
    """
    chosen = (
        labelled.filter(F.col("label").isin(0, 1))
        .join(documents.select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(TRAIN_ROWS)
    )
    whole = (
        documents.join(F.broadcast(chosen), "doc_id")
        .select("doc_id", F.encode("text", "utf-8").alias("text"), "label")
    )

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shortened(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()), batch.column(2)],
                names=["doc_id", "text", "label"],
            )

    kinds = ", ".join(f"{c} {whole.schema[c].dataType.simpleString()}" for c in ("doc_id", "text", "label"))
    rows = whole.mapInArrow(shorten, kinds).orderBy("doc_id", "text", "label").limit(TRAIN_ROWS).collect()
    return train([bytes(r["text"] or b"") for r in rows], [r["label"] for r in rows])


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted, offending.

    `offending` lists the sentences of probability LOCATED or more by their byte range in
    the UTF-8 text. Learns from labels whose crc32(doc_id) modulo FOLDS is not HELD_OUT.
    Null and empty texts have no sentence and score 0. Repeated documents are scored each
    time; null labels and null ids teach nothing; without both classes every score is the
    smoothed share of label 1.
    """
    docs = pick(documents, "doc_id", "text")
    known = pick(labels, "doc_id", label="toxic").filter(
        F.col("doc_id").isNotNull() & (remainder("doc_id", FOLDS) != HELD_OUT)
    )
    model = fit(docs, known)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64(), "probability": pa.float64()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            scored = [model.score(text) for text in encoded(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([s for s, _ in scored], pa.float64()),
                    pa.array([spans for _, spans in scored], span),
                ],
                names=["doc_id", "score", "offending"],
            )

    scored = docs.mapInArrow(
        run,
        f"doc_id {kind}, score double, "
        "offending array<struct<start: bigint, end: bigint, probability: double>>",
    )
    return scored.select(
        "doc_id",
        (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "offending",
    )
