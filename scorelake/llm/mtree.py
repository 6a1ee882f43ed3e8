"""Exact top-k search by integer inner product, best-first over paged M-trees.

Components become floor(scale * x). A vector x is stored with one more coordinate, sqrt(M^2 - |x|^2) for the largest norm M of
its tree, and a query with a 0 there; the squared Euclidean distance of the two is then |q|^2 + M^2 - 2 q.x, so the nearest
vectors have the highest inner products, and a metric tree can search them.

Every task of the scan cuts its vectors into trees of at most ``TREE_ROWS`` and bulk-loads each: leaf pages of at most ``PAGE``
vectors around a routing vector, inner nodes over ``FAN`` pages. A node keeps its routing vector, its covering radius, and the
distance from each entry to the routing vector. The index holds every vector, one row a tree, and is written to the shared folder.

Queries are blocks of about ``block`` components at most in the shared folder, and every group of trees gets every block: a task holds its
trees and takes one block after the other, so that queries go neither through the driver nor to every machine at once. Each query runs
best-first through the trees of a task: the
node with the least lower bound next, entries ruled out by the stored distances (triangle inequality) before any distance is
computed, until no bound beats the k-th score so far, which goes on from tree to tree. Scores are exact integers; bounds leave
room for rounding. Each task gives k rows a query at most, and a rank per query merges them.

Defined results: vectors that are null, or hold null or non-finite components, and rows without an id take no part. A query's
candidates are the rows with another id and as many components. Ties go to the smaller id; equal vectors under different ids are
all candidates. A query with fewer than k candidates gets them all, one with none no row. Rows that repeat a query's id are
queries each, numbered apart while they are searched. Other columns are not read. Scores beyond 64 bits raise an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm import bond
from scorelake.session import new_table_path

TREE_ROWS = 4096
PAGE = 128
FAN = 16
#: Components of the trees that a task holds.
GROUP = 1 << 22
#: Float arithmetic is exact below this.
EXACT = 1 << 53


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """vec_id (long) and v (array of longs) of the rows that take part."""
    x = F.col(embedding)
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return (
        vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & fine)
        .select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))
    )


@dataclass
class Tree:
    """Leaf page p holds rows first[p]:first[p + 1]; inner node i holds pages i * FAN and on."""

    ids: np.ndarray
    vectors: np.ndarray  # by page
    limit: float  # squared norm of the longest vector
    first: np.ndarray
    router: np.ndarray  # row of each page's routing vector
    radius: np.ndarray
    to_router: np.ndarray  # of each row
    inner_router: np.ndarray  # row of each inner node's routing vector
    inner_radius: np.ndarray
    to_inner: np.ndarray  # of each page's routing vector


def lifted(vectors: np.ndarray, limit: float) -> np.ndarray:
    v = vectors.astype(float)
    return np.column_stack((v, np.sqrt(np.maximum(0.0, limit - (v * v).sum(axis=1)))))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between each row of ``a`` and the vector ``b``."""
    gap = a - b
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def build(ids: np.ndarray, vectors: np.ndarray) -> Tree:
    """Bulk-load: halve the rows by their distance to a far-off vector until they fit in a page, so close rows share pages."""
    n = len(ids)
    squares = (vectors.astype(float) ** 2).sum(axis=1)
    limit = float(squares.max(initial=0.0))
    points = lifted(vectors, limit)
    pages, stack = [], [np.arange(n)]
    while stack:
        rows = stack.pop()
        if len(rows) <= PAGE:
            pages.append(rows)
            continue
        far = points[rows[np.argmax(distances(points[rows], points[rows[0]]))]]
        other = points[rows[np.argmax(distances(points[rows], far))]]
        gap = distances(points[rows], far) - distances(points[rows], other)
        rows = rows[np.argsort(gap, kind="stable")]
        stack += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
    order = np.concatenate(pages)
    points, first = points[order], np.concatenate(([0], np.cumsum([len(p) for p in pages])))
    center = lambda a, b: a + int(np.argmin(distances(points[a:b], points[a:b].mean(axis=0))))
    router = np.array([center(a, b) for a, b in zip(first, first[1:], strict=False)])
    to_router = np.concatenate([distances(points[a:b], points[r]) for a, b, r in zip(first, first[1:], router, strict=False)])
    radius = np.maximum.reduceat(to_router, first[:-1])
    groups = range(0, len(router), FAN)
    bounds = [(int(first[g]), int(first[min(g + FAN, len(router))])) for g in groups]
    inner = np.array([center(a, b) for a, b in bounds])
    inner_radius = np.array([distances(points[a:b], points[r]).max() for (a, b), r in zip(bounds, inner, strict=True)])
    to_inner = np.concatenate([distances(points[router[g : g + FAN]], points[r]) for g, r in zip(groups, inner, strict=True)])
    return Tree(ids[order], vectors[order], limit, first, router, radius, to_router, inner, inner_radius, to_inner)


FIELDS = (
    ("ids", np.int64), ("vectors", np.int64), ("first", np.int64), ("router", np.int64), ("radius", np.float64), ("to_router", np.float64),
    ("inner_router", np.int64), ("inner_radius", np.float64), ("to_inner", np.float64),
)
INDEX = "dim int, size int, limit double, " + ", ".join(f"{name} binary" for name, _ in FIELDS)


def row_of(tree: Tree) -> pa.RecordBatch:
    fixed = [pa.array([tree.vectors.shape[1]], pa.int32()), pa.array([len(tree.ids)], pa.int32()), pa.array([tree.limit])]
    data = [pa.array([np.ascontiguousarray(getattr(tree, name), kind).tobytes()], pa.binary()) for name, kind in FIELDS]
    return pa.record_batch([*fixed, *data], ["dim", "size", "limit", *(name for name, _ in FIELDS)])


def index(rows: DataFrame, path: str) -> None:
    """Write the trees of all rows of ``integer_vectors`` below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # by number of components
        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("v")
            sizes = lists.value_lengths().to_numpy()
            values, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
            for dim in np.unique(sizes).tolist():
                chosen = np.flatnonzero(sizes == dim)
                for at in range(0, len(chosen), TREE_ROWS):
                    part = chosen[at : at + TREE_ROWS]
                    vectors = values[starts[part][:, None] + np.arange(dim)] if dim else np.zeros((len(part), 0), np.int64)
                    waiting.setdefault(dim, []).append((ids[part], vectors))
                    if sum(len(i) for i, _ in waiting[dim]) >= TREE_ROWS:
                        yield from grown(waiting.pop(dim))
        for own in waiting.values():
            yield from grown(own)

    def grown(own: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, vectors = np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own])
        for at in range(0, len(ids), TREE_ROWS):
            yield row_of(build(ids[at : at + TREE_ROWS], vectors[at : at + TREE_ROWS]))

    rows.mapInArrow(run, INDEX).write.parquet(path)


def products(vectors: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Exact integer inner products."""
    if exact:
        return (vectors @ query.astype(float)).astype(np.int64)
    found = [sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in vectors.astype(np.int64)]
    return np.array(found, np.int64)  # raises where 64 bits don't hold a score


def search(tree: Tree, floats: np.ndarray, query: np.ndarray, own: int, k: int, best: list[tuple[int, int]]) -> None:
    """Bring ``best``, a heap of (score, -id) of at most k rows, up to date with a tree."""
    square = float(query.astype(float) @ query.astype(float))
    exact = (square + 1) * (tree.limit + 1) < EXACT * 1.0
    wide = np.append(query.astype(float), 0.0)
    slack = 1e-9 * (square + tree.limit + 1)

    def reach() -> float:
        """Distance within which a vector can still be among the k best."""
        return np.sqrt(max(0.0, square + tree.limit - 2.0 * best[0][0]) + slack) + 1e-9 if len(best) == k else np.inf

    inner = distances(floats[tree.inner_router], wide)
    queue = [(max(0.0, d - r), 0, i, d) for i, (d, r) in enumerate(zip(inner.tolist(), tree.inner_radius.tolist(), strict=True))]
    heapq.heapify(queue)
    while queue:
        bound, leaf, node, distance = heapq.heappop(queue)
        near = reach()
        if bound > near:
            return
        if not leaf:
            a, b = node * FAN, min((node + 1) * FAN, len(tree.router))
            open_ = np.flatnonzero(np.abs(distance - tree.to_inner[a:b]) - tree.radius[a:b] <= near) + a
            if len(open_):
                for page, d in zip(open_.tolist(), distances(floats[tree.router[open_]], wide).tolist(), strict=True):
                    if d - tree.radius[page] <= near:
                        heapq.heappush(queue, (max(0.0, d - float(tree.radius[page])), 1, page, d))
            continue
        a, b = tree.first[node], tree.first[node + 1]
        open_ = np.flatnonzero(np.abs(distance - tree.to_router[a:b]) <= near) + a
        if not len(open_):
            continue
        scores = products(floats[open_, :-1] if exact else tree.vectors[open_], query, exact)
        if len(best) == k:
            kept = scores >= best[0][0]
            open_, scores = open_[kept], scores[kept]
        for name, score in zip(tree.ids[open_].tolist(), scores.tolist(), strict=True):
            if name == own:
                continue
            if len(best) < k:
                heapq.heappush(best, (score, -name))
            elif (score, -name) > best[0]:
                heapq.heapreplace(best, (score, -name))


class Held:
    """A tree of the index with its vectors as floats."""

    def __init__(self, row: dict) -> None:
        parts = {name: np.frombuffer(row[name], kind) for name, kind in FIELDS}
        parts["vectors"] = parts["vectors"].reshape(row["size"], row["dim"])
        self.tree = Tree(limit=row["limit"], **parts)
        self.floats = lifted(self.tree.vectors, self.tree.limit)


def top_k(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0,
          block: int = 1 << 17) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every row for which the column ``is_query`` is true."""
    spark = vectors.sparkSession
    paths = [new_table_path(spark, name) for name in ("mtree-index", "mtree-queries")]
    index(integer_vectors(vectors, vec_id, embedding, scale), paths[0])
    queries = integer_vectors(vectors.where(is_query), vec_id, embedding, scale).withColumn("label", F.lit(0).cast("long"))
    bond.packed(queries, lambda dim: max(1, block // (dim + 1))).write.parquet(paths[1])
    trees = spark.read.parquet(paths[0]).withColumn("number", F.xxhash64("ids"))

    def visit(own: list[Held], asked: dict) -> Iterator[tuple]:
        for at, name, _, query in bond.anchors_of(asked):
            best: list[tuple[int, int]] = []
            for held in own:
                if len(query) == held.tree.vectors.shape[1]:
                    search(held.tree, held.floats, query, name, k, best)
            for score, other in best:
                yield asked["number"], at, name, -other, score

    names = ["number", "at", "query_id", "vec_id", "score"]
    blocks = spark.read.parquet(paths[1]).withColumnsRenamed({"ids": "query_ids", "cells": "query_cells"})
    blocks = blocks.select("number", "dim", "size", "kind", "labels", "query_ids", "query_cells")
    found = bond.visited(trees, blocks, Held, lambda own, row: visit(own, row | {"ids": row["query_ids"], "cells": row["query_cells"]}), names, GROUP)
    rank = F.row_number().over(Window.partitionBy("number", "at").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
