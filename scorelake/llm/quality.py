"""Quality by Bradley-Terry ranking of pairs.

Each text becomes a fixed row of features of its form: shares of kinds of characters and of what follows what, lengths of
words and lines, repetition of words and lines. A linear score is learned from preference pairs (a text labelled 1 over one
labelled 0) by logistic loss on feature differences: the chance that a is better than b is 1 / (1 + exp(score(b) -
score(a))). Pairs are drawn from a bounded sample of the labelled rows, at most ``per_label`` of each label, those whose id
hashes lowest. A part of the sample is kept back, on which a logistic curve turns scores into the chance of label 1.

Scoring covers every whole text in the scan, without a shuffle. ``select_top`` keeps the rows above a quantile of the
score over all rows.

Defined results: null counts as the empty text; it and texts without words have features of zero and a score like any
other. If only one label, or none, is there to learn from, every score is the share of label 1 (0.5 if none). Repeated rows
are scored alike. Other columns are neither read nor returned by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm import common

#: Classes of bytes: lower case, upper case, digit, blank, line end, sentence marks, other marks, control, beyond ASCII.
LOWER, UPPER, DIGIT, BLANK, LINE, SENTENCE, MARK, CONTROL, OTHER = range(9)
CLASSES = 9
WIDTH = CLASSES * CLASSES + 11
KINDS = np.array(
    [
        LOWER if 97 <= c <= 122 else UPPER if 65 <= c <= 90 else DIGIT if 48 <= c <= 57 else LINE if c in (10, 13)
        else BLANK if c in (9, 11, 12, 32) else SENTENCE if chr(c) in ".,;:'\"?()-" else MARK if 33 <= c <= 126
        else OTHER if c >= 128 else CONTROL
        for c in range(256)
    ],
    np.uint8,
)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    intercept: float


def features(text: bytes) -> np.ndarray:
    """Pair shares of byte classes, then the features of words and lines."""
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    out = np.zeros(WIDTH)
    if not n:
        return out
    kinds = KINDS[data]
    pairs = np.bincount(kinds[:-1] * np.uint8(CLASSES) + kinds[1:], minlength=CLASSES * CLASSES)
    words, lines = text.split(), text.split(b"\n")
    w, distinct = len(words), len(set(words))
    mean = sum(map(len, words)) / max(1, w)
    marks = np.count_nonzero((kinds[1:] == MARK) & (data[1:] == data[:-1]))
    out[: CLASSES * CLASSES] = np.sqrt(pairs / max(1, n - 1))
    out[CLASSES * CLASSES :] = (
        np.log1p(n), np.log1p(w), mean / (1 + mean), distinct / max(1, w), len(set(lines)) / len(lines), len(lines) / (w + 1),
        np.sqrt(marks / n), np.sqrt(np.count_nonzero(kinds == MARK) / n), np.sqrt(np.count_nonzero(kinds == UPPER) / n),
        len(set(zip(words, words[1:], strict=False))) / max(1, w - 1), np.sqrt(sum(map(eq, words, words[1:])) / max(1, w)),
    )
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    per_label: int = 1500,
    pairs: int = 40_000,
    epochs: int = 12,
    penalty: float = 1e-4,
    seed: int = 10,
) -> Model:
    """Learn from documents whose id ``labels`` marks 0 or 1. Only the features of the bounded sample reach the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.slices(batches, "text"):
            found = [features(x) for x in common.text_bytes(piece.column("text"))]
            yield pa.record_batch([piece.column("h"), piece.column("label"), pa.array(found, pa.list_(pa.float64()))], ["h", "label", "x"])

    # labels are ranked without texts; the chosen ids, at most per_label a label, are broadcast to fetch them
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    known = known.select(F.col(doc_id).alias("id"), F.xxhash64(doc_id).alias("h"), F.col(label).cast("int").alias("label")).distinct()
    chosen = common.lowest(known.withColumnRenamed("h", "r"), "label", per_label, "id").withColumnRenamed("r", "h")
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    sample = common.bounded_sample(texts.select("h", "label", "text"), "label", per_label)
    found = sample.mapInArrow(rows, "h long, label int, x array<double>").toArrow()
    order = np.lexsort((found["h"].to_numpy(), found["label"].to_numpy()))
    x = np.array(found["x"].to_pylist(), float).reshape(found.num_rows, WIDTH)[order]
    return train(x, found["label"].to_numpy()[order], pairs, epochs, penalty, seed)


def train(x: np.ndarray, y: np.ndarray, pairs: int, epochs: int, penalty: float, seed: int) -> Model:
    width = WIDTH
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / np.where(scale > 1e-9, scale, np.inf)
    kept_back = np.arange(len(y)) % 4 == 0
    good, bad = np.flatnonzero((y == 1) & ~kept_back), np.flatnonzero((y == 0) & ~kept_back)
    if not len(good) or not len(bad):
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    weights, batch = np.zeros(width), 64
    for epoch in range(epochs):
        shuffled = rng.permutation(pairs)
        for start in range(0, pairs, batch):
            p = shuffled[start : start + batch]
            gap = z[a[p]] - z[b[p]]
            gain = (1 - sigmoid(gap @ weights)) @ gap / len(p)
            weights += 0.1 / (1 + epoch) * (gain - penalty * weights)
    # the curve from scores to chances, by Newton's method, on texts that no pair was drawn from
    held = kept_back if len(set(y[kept_back].tolist())) == 2 else np.ones(len(y), bool)
    s, t = z[held] @ weights, y[held].astype(float)
    # every label counts as its share among the rows, with one row of each added, so that the curve stays finite
    t = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
    spread = s.std() or 1.0
    basis = np.column_stack((s / spread, np.ones(len(s))))
    curve = np.zeros(2)
    for _ in range(50):
        chance = sigmoid(basis @ curve)
        gradient = basis.T @ (t - chance) - 1e-3 * curve
        curve += np.linalg.solve(basis.T @ (basis * (chance * (1 - chance))[:, None]) + 1e-3 * np.eye(2), gradient)
    return Model(mean, np.where(scale > 1e-9, scale, np.inf), weights, float(curve[0] / spread), float(curve[1]))


def chances(model: Model, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bradley-Terry score and chance of label 1 of each text."""
    x = np.array([features(v) for v in values], float).reshape(len(values), WIDTH)
    raw = ((x - model.mean) / model.scale) @ model.weights if len(values) else np.zeros(0)
    return raw, sigmoid(model.slope * raw + model.intercept)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (chance of label 1) and raw (the pairwise score) of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.slices(batches, "text"):
            raw, chance = chances(shared.value, common.text_bytes(piece.column("text")))
            yield pa.record_batch([piece.column("doc_id"), pa.array(chance), pa.array(raw)], ["doc_id", "score", "raw"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, raw double")


def mark_top(scored: DataFrame, share: float, column: str = "raw", accuracy: int = 100_000) -> DataFrame:
    """``scored`` with ``selected``: whether a row is at or above the (1 - share) quantile of ``column`` over all rows; not for a null.

    The quantile is Spark's percentile_approx, whose relative rank error is 1 / accuracy. ``scored`` is read twice, so it should be kept.
    """
    cut = scored.agg(F.percentile_approx(column, 1 - share, accuracy).alias("cut")).first()["cut"]
    return scored.withColumn("selected", F.coalesce(F.col(column) >= F.lit(cut), F.lit(False)))


def select_top(scored: DataFrame, share: float, column: str = "raw", accuracy: int = 100_000) -> DataFrame:
    """The rows that ``mark_top`` selects."""
    return mark_top(scored, share, column, accuracy).where("selected").drop("selected")
