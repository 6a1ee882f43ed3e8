"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the bag of its byte n-grams (A-Z lower-cased). Each n-gram hashes to a row of an embedding table; the text's
vector is the mean of the rows, and a linear softmax over it gives the languages. Table and softmax are trained together
by stochastic gradient descent in numpy on a bounded sample of the labelled rows: at most ``per_language`` texts of each
language, those whose id hashes lowest. Prediction covers every whole text, in the tasks that scan it, with no shuffle:
since both layers are linear, each n-gram's share of the class scores is one row of a small table.

Part of the sample is kept back to set the softmax temperature and the rejection threshold: the confidence that all but
``reject_share`` of the correctly named texts reach, at most ``reject_most``.

Defined results: a text that is null or has no letter is ``und`` with score 0 and is rejected. Ties between languages
go to the first in sorted order. Without a labelled row every text is ``und``. Repeated rows are scored alike; other
columns of the input, whatever their names, are neither read nor returned by ``predict`` and are kept by ``annotate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm import common

ORDERS = (1, 2, 3)
BITS = 15
DIM = 16
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    scores: np.ndarray  # n-gram bucket x language: what an n-gram adds to the class scores, over the number of n-grams
    bias: np.ndarray
    temperature: float
    threshold: float


def buckets(data: np.ndarray, order: int) -> np.ndarray:
    """Hash bucket of the n-gram that starts at each byte."""
    n = max(0, len(data) - order + 1)
    code = np.full(n, order, np.uint32)
    for j in range(order):
        code *= np.uint32(0x9E3779B1)
        code ^= data[j : j + n]
    code *= np.uint32(0x85EBCA6B)
    return code >> np.uint32(32 - BITS)


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    data = np.frombuffer(text.translate(common.ASCII_LOWER), np.uint8)
    found = [buckets(data, k) for k in ORDERS if len(data) >= k]
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32)
    rows, counts = np.unique(np.concatenate(found), return_counts=True)
    return rows, (counts / counts.sum()).astype(np.float32)


def fit(
    labelled: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = 400,
    epochs: int = 6,
    reject_share: float = 0.001,
    reject_most: float = 0.35,
    seed: int = 7,
) -> Model:
    """Train on the sample. Its bags, bounded in number and size by the bucket count, are all that reaches the driver."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.slices(batches, "text"):
            found = [bag(x) for x in common.text_bytes(piece.column("text"))]
            rows = [r.astype(np.int32) for r, _ in found]
            yield pa.record_batch(
                [piece.column("h"), piece.column("lang"), pa.array(rows, pa.list_(pa.int32())),
                 pa.array([s for _, s in found], pa.list_(pa.float32()))],
                ["h", "lang", "rows", "shares"],
            )

    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    rows = rows.select(F.xxhash64(doc_id).alias("h"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sample = common.bounded_sample(rows, "lang", per_language)
    found = sample.mapInArrow(bags, "h long, lang string, rows array<int>, shares array<float>").toArrow()
    order = np.lexsort((found["h"].to_numpy(), found["lang"].to_numpy(zero_copy_only=False).astype(str)))
    names = found["lang"].to_pylist()
    languages = tuple(sorted(set(names)))
    place = {x: i for i, x in enumerate(languages)}
    rows, shares = found["rows"].combine_chunks(), found["shares"].combine_chunks()
    bags_ = [(rows[i].values.to_numpy(), shares[i].values.to_numpy(), place[names[i]]) for i in order.tolist()]
    return train([b for b in bags_ if len(b[0])], languages, epochs, reject_share, reject_most, seed)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(bags: list, languages: tuple, epochs: int, reject_share: float, reject_most: float, seed: int) -> Model:
    """SGD over single texts; every fifth text is kept back for the temperature and the threshold."""
    k = len(languages)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    if not bags or k < 2:
        return Model(languages, np.zeros((1 << BITS, k), np.float32), bias, 1.0, 0.0)
    kept_back, used = bags[::5], [b for i, b in enumerate(bags) if i % 5] or bags
    steps, done = epochs * len(used), 0
    for _ in range(epochs):
        for i in rng.permutation(len(used)):
            rows, shares, label = used[i]
            rate = np.float32(2.0 * (1 - done / steps))
            done += 1
            x = shares @ table[rows]
            error = softmax(x @ weights + bias)
            error[label] -= 1
            back = weights @ error
            weights -= rate * np.outer(x, error)
            bias -= np.float32(0.05) * rate * error
            # an n-gram's share is small; the step is scaled so that a text moves its mean by about the rate
            table[rows] -= rate * np.outer(shares / (shares @ shares), back) * np.float32(0.2)
    scores = table @ weights
    logits = np.stack([shares @ scores[rows] + bias for rows, shares, _ in kept_back])
    labels = np.array([b[2] for b in kept_back])
    at = np.arange(len(labels))
    heats = np.geomspace(1e-3, 1e3, 240)
    # smoothed labels keep the temperature finite when every text is named rightly
    logs = [np.log(np.maximum(softmax(logits / t), 1e-12)) for t in heats]
    loss = [-(0.99 * x[at, labels] + 0.01 * x.mean(axis=1)).mean() for x in logs]
    temperature = float(heats[int(np.argmin(loss))])
    sure = softmax(logits / temperature)
    right = sure.argmax(axis=1) == labels
    threshold = min(reject_most, float(np.quantile(sure.max(axis=1)[right], reject_share)) if right.any() else 0.0)
    return Model(languages, scores, bias, temperature, threshold)


def classify(model: Model, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language and confidence of each text."""
    k = len(model.languages)
    data, starts, ends = common.joined([v.translate(common.ASCII_LOWER) for v in values], pad=max(ORDERS))
    sums, counts = np.zeros((len(values), k)), np.zeros(len(values))
    for order in ORDERS:
        stops = np.maximum(starts, ends - order + 1)
        sums += common.segment_sums(model.scores[buckets(data, order)], starts, stops)
        counts += stops - starts
    sure = softmax((sums / np.maximum(counts, 1)[:, None] + model.bias) / model.temperature)
    return sure.argmax(axis=1), sure.max(axis=1)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def annotate(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected"),
             slice_bytes: int = 1 << 20) -> DataFrame:
    """All columns of ``docs`` and three more: language, confidence and rejection. Columns of those names are replaced."""
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS rows of one float a language
    added = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for piece in common.slices(batches, text, slice_bytes):
            known = np.array([has_letter(x) for x in piece.column(text).to_pylist()], bool) & bool(m.languages)
            if m.languages:
                best, sure = classify(m, common.text_bytes(piece.column(text)))
            else:
                best, sure = np.zeros(piece.num_rows, int), np.zeros(piece.num_rows)
            lang = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
            sure = np.where(known, sure, 0.0)
            new = [pa.array(lang, pa.string()), pa.array(sure), pa.array(~known | (sure < m.threshold))]
            yield pa.record_batch([*piece.columns, *new], schema=pa.schema([*piece.schema, *map(pa.field, names, (x.type for x in new))]))

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, language, confidence and rejection of each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return annotate(rows, model).select("doc_id", "lang_pred", "score", "rejected")


def keep_accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is named with enough confidence, in their own columns."""
    names = tuple(f"__{n}" for n in ("lang", "score", "rejected"))
    return annotate(docs, model, text, names).where(~F.col(names[2])).drop(*names)
