"""Operator 5: document quality by regularised quadratic discriminant analysis.

Every text becomes a few statistics, transformed to be closer to normal. Each class has a
mean and a covariance, shrunk towards the pooled covariance and a multiple of the identity;
the covariances are factored once (Cholesky), and the score is the difference of the two
log densities, from Mahalanobis distances by triangular solves, mapped to 0..1 by a
logistic curve fitted to the labelled rows.

Nothing but sums goes to the driver: class moments and a histogram of fixed size.
Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitlake.llm.common import cut_lineage, encoded, pick, remainder, small_batches

FOLDS = 5
THRESHOLD = 0.3
POOLED = 0.1  # share of the pooled covariance in a class covariance
RIDGE = 0.02  # share of the identity, after features have unit variance
BINS = 2000
SPAN = 60.0  # log-density differences are clipped here

_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HIGH = np.arange(256) >= 128
_SPACE = np.isin(np.arange(256), [32, 9, 11, 12, 13])
_NEWLINE = np.arange(256) == 10
_STOPS = np.isin(np.arange(256), list(b".,;:'-"))
_MARKS = np.isin(np.arange(256), list(b"!?"))
_OTHER = ~(_LOWER | _UPPER | _DIGIT | _HIGH | _SPACE | _NEWLINE | _STOPS | _MARKS)
_KINDS = np.stack(
    [_LOWER, _UPPER, _DIGIT, _HIGH, _SPACE, _NEWLINE, _STOPS, _MARKS, _OTHER]
).astype(np.int64)

FEATURES = [
    "log_bytes", "lower", "upper", "digit", "high", "space", "newline", "stops", "marks",
    "other", "word_length", "distinct_words", "distinct_lines", "top_word",
]


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text; all zero for an empty one.

    Shares are sqrt-arcsine transformed, counts and lengths logarithmic.
    """
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = _KINDS @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = text.split(b"\n")
    n_words = max(len(words), 1)
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    shares = [*(counts / n), len(seen) / n_words, len(set(lines)) / len(lines)]
    shares.append(max(seen.values(), default=0) / n_words)
    bent = np.arcsin(np.sqrt(np.clip(shares, 0, 1))).tolist()
    return [float(np.log1p(n)), *bent[:9], float(np.log1p((n - n_words) / n_words)), *bent[9:]]


def features(documents: DataFrame) -> DataFrame:
    """doc_id and the array `x` of statistics, for every document; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            values = np.array([statistics(t) for t in encoded(batch)]).ravel()
            arrays = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES)), values
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), arrays], names=["doc_id", "x"])

    docs = pick(documents, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, x array<double>")


@dataclasses.dataclass
class Discriminant:
    """Class means, Cholesky factors and the calibration; `prior` when a class is missing."""

    prior: float
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: list[np.ndarray] | None = None
    factors: list[np.ndarray] | None = None
    slope: float = 1.0
    intercept: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 minus that under class 0, clipped to SPAN."""
        z = (x - self.shift) / self.scale
        logs = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            solved = np.linalg.solve(factor, (z - mean).T)
            logs.append(-0.5 * (solved**2).sum(axis=0) - np.log(np.diag(factor)).sum())
        return np.clip(logs[1] - logs[0], -SPAN, SPAN)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-(self.slope * self.difference(x) + self.intercept)))


def _moments(labelled: DataFrame, d: int) -> dict[int, tuple]:
    """Count, sum and sum of outer products per class; added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), dtype=float).reshape(-1, d)
            y = np.array(batch.column(1).to_pylist())
            for label, add in total.items():
                part = x[y == label]
                add += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        size = 1 + d + d * d
        yield pa.RecordBatch.from_pydict({
            "label": np.repeat([0, 1], size).astype(np.int32),
            "place": np.tile(np.arange(size, dtype=np.int32), 2),
            "value": np.concatenate([total[0], total[1]]),
        })

    parts = labelled.select("x", "label").mapInArrow(run, "label int, place int, value double")
    rows = parts.groupBy("label", "place").agg(F.sum("value").alias("value")).collect()
    sums = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    for row in rows:
        sums[row["label"]][row["place"]] = row["value"]
    return {k: (s[0], s[1 : 1 + d], s[1 + d :].reshape(d, d)) for k, s in sums.items()}


def _calibrate(model: Discriminant, labelled: DataFrame) -> None:
    """Fit the logistic curve on a histogram of differences, by Newton's steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BINS))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), dtype=float).reshape(-1, len(model.shift))
            y = np.array(batch.column(1).to_pylist(), dtype=np.int64)
            place = ((model.difference(x) + SPAN) / (2 * SPAN) * (BINS - 1)).round().astype(int)
            np.add.at(held, (y, place), 1)
        label, place = np.nonzero(held)
        yield pa.RecordBatch.from_pydict({
            "label": label.astype(np.int32), "place": place.astype(np.int32),
            "value": held[label, place],
        })

    parts = labelled.select("x", "label").mapInArrow(run, "label int, place int, value double")
    rows = parts.groupBy("label", "place").agg(F.sum("value").alias("value")).collect()
    y = np.array([r["label"] for r in rows], float)
    z = np.array([r["place"] for r in rows]) / (BINS - 1) * 2 * SPAN - SPAN
    n = np.array([r["value"] for r in rows])
    design = np.stack([z, np.ones_like(z)], axis=1)
    beta = np.array([0.1, np.log((n @ y + 1) / (n @ (1 - y) + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 1e-3 * beta
        hessian = (design.T * (n * p * (1 - p))) @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.intercept = max(float(beta[0]), 1e-6), float(beta[1])


def fit(labelled: DataFrame) -> Discriminant:
    """Learn from the columns x and label (0 or 1) of all labelled rows.

    With fewer than two rows of a class, the model scores the smoothed share of label 1.
    """
    d = len(FEATURES)
    labelled = labelled.filter(F.col("label").isin(0, 1))
    moments = _moments(labelled, d)
    n0, n1 = moments[0][0], moments[1][0]
    model = Discriminant(prior=float((n1 + 1) / (n0 + n1 + 2)))
    if min(n0, n1) < 2:
        return model
    total = sum(m[1] for m in moments.values())
    spread = sum(np.diag(m[2]) for m in moments.values())
    model.shift = total / (n0 + n1)
    model.scale = np.sqrt(np.maximum(spread / (n0 + n1) - model.shift**2, 1e-12))
    means, covariances = [], []
    for label in (0, 1):
        n, s, outer = moments[label]
        mean = s / n
        cov = (outer / n - np.outer(mean, mean)) / np.outer(model.scale, model.scale)
        means.append((mean - model.shift) / model.scale)
        covariances.append(cov)
    pooled = (n0 * covariances[0] + n1 * covariances[1]) / (n0 + n1)
    shrunk = [
        (1 - RIDGE) * ((1 - POOLED) * c + POOLED * pooled) + RIDGE * np.eye(d)
        for c in covariances
    ]
    model.means, model.factors = means, [np.linalg.cholesky(c) for c in shrunk]
    _calibrate(model, labelled)
    return model


def apply(model: Discriminant, rows: DataFrame) -> DataFrame:
    """Scores of all rows of `features`: doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `documents`, all columns, that score THRESHOLD or more.

    Learns like `score_documents`, then scores each row where it lies: nothing is joined, so
    rows of one id are judged by their own text.
    """
    rows = cut_lineage(features(documents))
    known = pick(labels, "doc_id", label="quality").filter(remainder("doc_id", FOLDS) != 0)
    model = fit(rows.join(known, "doc_id").select("x", "label"))
    names, place = documents.columns, documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, f"_{place}"):
            x = np.array([statistics(t) for t in encoded(batch, f"_{place}")])
            yield batch.filter(pa.array(model.score(x.reshape(-1, len(FEATURES))) >= THRESHOLD))

    plain = documents.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted.

    Learns from labels whose crc32(doc_id) modulo FOLDS is not 0 and that have a document.
    Null and empty texts have a score like any other; a repeated document is scored each
    time, a repeated label counts each time, null labels and null ids teach nothing. Without
    labels all scores are 0.5. Texts are read once; only statistics are kept.
    """
    rows = cut_lineage(features(documents))
    known = pick(labels, "doc_id", label="quality").filter(remainder("doc_id", FOLDS) != 0)
    model = fit(rows.join(known, "doc_id").select("x", "label"))
    return apply(model, rows).select(
        "doc_id",
        (remainder("doc_id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
