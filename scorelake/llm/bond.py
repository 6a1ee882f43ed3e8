"""Hard negatives by a vertical scan (BOND): columns of dimensions, read in each anchor's order of descending magnitude.

Vectors are written to the shared folder as pages of at most ``PAGE`` rows, a column a dimension, with the least and greatest
value of each. For an anchor a task reads a page's columns from the anchor's component of greatest magnitude down, ``STEP`` at a
time, and adds up each candidate's part of the inner product. What the columns still to come can add is bounded by their least
and greatest values, so every candidate has a lower and an upper bound, and the bitmap of candidates shrinks:

* Positives: a candidate goes when its upper bound is below the k-th best lower bound, or the k-th best score so far.
* Negatives: every positive gives a window of scores. A candidate goes when no window can hold it, or when every window that
  can already holds enough rows that surely beat it.

What is left at the last column has its exact score. Anchors are blocks in the shared folder too, and every group of pages
gets every block: a task holds its pages (about ``GROUP`` components) and takes one block after the other, so that neither goes through the
driver. A task returns a bounded number of rows an anchor, and a rank per anchor, or anchor and positive, merges them.

Defined results: rows whose id, label or vector is null, or that hold null or non-finite components, take no part. An anchor's
candidates are the rows with another id and as many components; rows that repeat an id are candidates each, and anchors each. Ties go to the
smaller id. Without a positive or without a row in the window there is no row. Components and scores beyond 64 bits raise an error.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.session import materialize, new_table_path

PAGE = 8192
STEP = 8
#: Components of the pages that a task holds, and of a block of anchors.
GROUP = 1 << 23
BLOCK = 1 << 17
#: Float arithmetic is exact below this.
EXACT = float(1 << 53)

PACKED = "number long, dim int, size int, kind string, ids binary, labels binary, cells binary"


def integers(vectors: DataFrame, label: Column, is_anchor: Column, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """vec_id, label, anchor and v (array of longs) of the rows that take part."""
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.col(embedding).alias("x"),
    )
    x = F.col("x")
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return rows.where("vec_id is not null and label is not null and x is not null").where(fine).select("vec_id", "label", "anchor", whole.alias("v"))


def smallest(values: np.ndarray) -> np.dtype:
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    return next(np.dtype(k) for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)


def packed(rows: DataFrame, size: Callable[[int], int]) -> DataFrame:
    """Rows of (vec_id, label, v) as tables of at most ``size(dim)`` rows of one number of components, by id, a column a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        held, number = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, labels, lists = (batch.column(c) for c in ("vec_id", "label", "v"))
            ids, labels, sizes = ids.to_numpy(), labels.to_numpy(), lists.value_lengths().to_numpy()
            values, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
            for dim in np.unique(sizes).tolist():
                chosen = np.flatnonzero(sizes == dim)
                for at in range(0, len(chosen), PAGE):
                    part = chosen[at : at + PAGE]
                    v = values[starts[part][:, None] + np.arange(dim)] if dim else np.zeros((len(part), 0), np.int64)
                    waiting.setdefault(dim, []).append((ids[part], labels[part], v))
                    held += v.size + len(part)
                    if sum(len(x[0]) for x in waiting[dim]) >= size(dim):
                        held -= sum(x[2].size + len(x[0]) for x in waiting[dim])
                        for out in tables(waiting.pop(dim), number):
                            number += 1
                            yield out
            if held > GROUP:
                for own in waiting.values():
                    for out in tables(own, number):
                        number += 1
                        yield out
                waiting, held = {}, 0
        for own in waiting.values():
            for out in tables(own, number):
                number += 1
                yield out

    def tables(own: list[tuple[np.ndarray, np.ndarray, np.ndarray]], number: int) -> Iterator[pa.RecordBatch]:
        ids, labels, v = (np.concatenate([x[i] for x in own]) for i in range(3))
        for i, at in enumerate(range(0, len(ids), size(v.shape[1]))):
            part = slice(at, at + size(v.shape[1]))
            order = np.argsort(ids[part], kind="stable")
            cells = v[part][order].T
            kind = smallest(cells)
            values = (number + i, v.shape[1], len(order), kind.str, ids[part][order].tobytes(), labels[part][order].tobytes(), cells.astype(kind).tobytes())
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
            names = ["number", "dim", "size", "kind", "ids", "labels", "cells"]
            yield pa.record_batch([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], names)

    return rows.select("vec_id", "label", "v").mapInArrow(run, PACKED)


class Page:
    """One table: columns as exact floats, or as whole numbers of any size where ``wide``; which rows hold which label."""

    def __init__(self, row: dict) -> None:
        self.dim, self.ids, self.labels = row["dim"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        cells = np.frombuffer(row["cells"], row["kind"]).reshape(row["dim"], row["size"])
        self.whole = cells
        self.cells = cells.astype(np.float64)
        self.low, self.high = (cells.min(axis=1), cells.max(axis=1)) if row["size"] else (np.zeros(row["dim"], np.int64),) * 2
        self.reach = np.maximum(np.abs(self.low.astype(float)), np.abs(self.high.astype(float)))
        self.by_label: dict[tuple[int, bool], np.ndarray] = {}

    def candidates(self, own: int, label: int, same: bool) -> np.ndarray:
        """Places of rows with that label (or another one), without those of id ``own``."""
        if (label, same) not in self.by_label:
            self.by_label[label, same] = np.flatnonzero((self.labels == label) == same)
        found = self.by_label[label, same]
        ids = self.ids[found]
        a, b = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
        return found if a == b else np.delete(found, slice(a, b))


Keep = Callable[[np.ndarray, float, float], np.ndarray]


def scan(page: Page, query: np.ndarray, alive: np.ndarray, keep: Keep) -> tuple[np.ndarray, np.ndarray]:
    """Places that ``keep`` left to the end, and their exact scores. It gets the sums so far and the least and most still to come."""
    exact = float(np.abs(query.astype(float)) @ page.reach) < EXACT
    cells, kind = (page.cells, np.float64) if exact else (page.whole, object)
    order = np.argsort(-np.abs(query.astype(float)), kind="stable")
    q = query[order].astype(kind)
    a, b = q * page.low[order].astype(kind), q * page.high[order].astype(kind)
    rest = [np.append(np.cumsum(x[::-1])[::-1], 0) for x in (np.minimum(a, b), np.maximum(a, b))]
    sums = np.zeros(len(alive), kind)
    for at in range(0, len(order), STEP):
        if not len(alive):
            break
        columns = cells[order[at : at + STEP]]
        columns = columns if len(alive) == columns.shape[1] else columns[:, alive]
        sums = sums + q[at : at + STEP] @ (columns if exact else columns.astype(object))
        end = min(at + STEP, len(order))
        left = keep(sums, rest[0][end], rest[1][end])
        if not left.all():
            alive, sums = alive[left], sums[left]
    return alive, sums.astype(np.int64) if exact else np.array([int(x) for x in sums], np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k first (-score, id)."""
    order = np.lexsort((ids, -scores))[:k]
    return list(zip((-scores[order]).tolist(), ids[order].tolist(), strict=True))


def nearest(pages: list[Page], own: int, label: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(-score, id) of the k first rows of the anchor's label."""
    found: list[tuple[int, int]] = []
    for page in pages:
        alive = page.candidates(own, label, True) if page.dim == len(query) else ()
        if not len(alive):
            continue
        known = -found[-1][0] if len(found) == k else None

        def keep(sums: np.ndarray, least: float, most: float, known=known) -> np.ndarray:
            left = np.ones(len(sums), bool) if known is None else sums + most >= known
            return left if len(sums) <= k else left & (sums + most >= np.partition(sums, -k)[-k] + least)

        alive, scores = scan(page, query, alive, keep)
        found = sorted(found + best(page.ids[alive], scores, k))[:k]
    return found


def within(pages: list[Page], own: int, label: int, query: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """By window (least, greatest score), (-score, id) of the k first rows of other labels in it."""
    found: list[list[tuple[int, int]]] = [[] for _ in windows]
    for page in pages:
        alive = page.candidates(own, label, False) if page.dim == len(query) and windows else ()
        if not len(alive):
            continue
        floors = [max(low, -f[-1][0]) if len(f) == k else low for f, (low, _) in zip(found, windows, strict=True)]

        def keep(sums: np.ndarray, least: float, most: float, floors=floors) -> np.ndarray:
            lower, upper = sums + least, sums + most
            left = np.zeros(len(sums), bool)
            for (low, high), floor in zip(windows, floors, strict=True):
                can = (upper >= floor) & (lower <= high)
                sure = lower[can & (lower >= low) & (upper <= high)]
                left |= can if len(sure) < k else can & (upper >= np.partition(sure, -k)[-k])
            return left

        alive, scores = scan(page, query, alive, keep)
        for i, (low, high) in enumerate(windows):
            inside = (scores >= low) & (scores <= high)
            if inside.any():
                found[i] = sorted(found[i] + best(page.ids[alive[inside]], scores[inside], k))[:k]
    return found


def visited(
    pages: DataFrame, blocks: DataFrame, hold: Callable[[dict], object], visit: Callable[[list, dict], Iterator[tuple]], names: list[str], group: int
) -> DataFrame:
    """What ``visit`` gives for every group of pages and every block, as rows of longs.

    A task holds the pages of a group, about ``group`` components in the form that ``hold`` gives them, and takes one block after the other.
    """
    size = pages.agg(F.sum(F.col("dim").cast("long") * F.col("size"))).first()[0] or 0
    groups = max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // group))
    held = pages.withColumn("g", F.pmod(F.xxhash64("number"), F.lit(groups))).withColumn("part", F.lit(0))
    asked = blocks.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).withColumn("part", F.lit(1))
    both = held.unionByName(asked, allowMissingColumns=True).repartition("g").sortWithinPartitions("g", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["g"] != last:
                    last, own = row["g"], []
                if not row["part"]:
                    own.append(hold(row))
                elif own:
                    columns = list(zip(*visit(own, row), strict=True)) or [[]] * len(names)
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names)

    return both.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def anchors_of(block: dict) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """at, id, label and vector of each anchor of a block."""
    ids, labels = np.frombuffer(block["ids"], np.int64).tolist(), np.frombuffer(block["labels"], np.int64).tolist()
    cells = np.frombuffer(block["cells"], block["kind"]).reshape(block["dim"], block["size"]).T.astype(np.int64)
    yield from zip(range(len(ids)), ids, labels, cells, strict=True)


def hard_negatives(
    vectors: DataFrame,
    label: Column,
    is_anchor: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: float = 256.0,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    An anchor's positives are its first rows of the same label; a positive's negatives the first rows of other labels whose score
    is from ``low`` to ``high`` percent of the positive's. Both go by score, highest first.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, label, is_anchor, vec_id, embedding, scale)
    paths = [new_table_path(spark, name) for name in ("bond-pages", "bond-anchors")]
    packed(rows, lambda dim: PAGE).write.parquet(paths[0])
    packed(rows.where("anchor"), lambda dim: max(1, min(PAGE, BLOCK // (dim + 1)))).write.parquet(paths[1])
    pages, blocks = map(spark.read.parquet, paths)

    def near(own: list[Page], block: dict) -> Iterator[tuple]:
        for at, name, kind, query in anchors_of(block):
            for score, other in nearest(own, name, kind, query, positives):
                yield block["number"], at, name, other, -score

    first = visited(pages, blocks, Page, near, ["number", "at", "anchor_id", "vec_id", "score"], GROUP)
    place = F.row_number().over(Window.partitionBy("number", "at").orderBy(F.desc("score"), "vec_id"))
    chosen = first.withColumn("place", place).where(F.col("place") <= positives)
    # at most ``positives`` rows an anchor, and a block has a bounded number of anchors
    chosen = chosen.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("at", "place", "vec_id", "score"))).alias("positives"))
    asked = materialize(blocks.join(chosen, "number"))

    def hard(own: list[Page], block: dict) -> Iterator[tuple]:
        wanted: dict[int, list[dict]] = {}
        for p in block["positives"]:
            wanted.setdefault(p["at"], []).append(p)
        for at, name, kind, query in anchors_of(block):
            mine = wanted.get(at, [])
            span = {s: (-(-low * s // 100), high * s // 100) for s in {p["score"] for p in mine}}
            windows = sorted({w for w in span.values() if w[0] <= w[1]})
            found = dict(zip(windows, within(own, name, kind, query, windows, negatives), strict=True))
            for p in mine:
                for score, other in found.get(span[p["score"]], ()):
                    yield block["number"], at, p["place"], name, p["vec_id"], p["score"], other, -score

    names = ["number", "at", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    found = visited(pages, asked, Page, hard, names, GROUP)
    rank = F.row_number().over(Window.partitionBy("number", "at", "place").orderBy(F.desc("negative_score"), "negative_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
