"""SimHash near-duplicates: fingerprints, links within a few bits by a Gray-order hierarchical index, and components.

A fingerprint has 64 bits; a bit is set if it is set in over half of the XXH64 values (seed 42) of the text's shingles of
``shingle`` words, repeats included. Fingerprints that differ in at most ``max_bits`` bits are linked.

How the links are found, exactly and without pairs of all rows:

1. Only distinct fingerprints take part; copies of a text are one row whatever their number.
2. The 64 bits are cut into max_bits + 2 parts. Fingerprints within max_bits agree on at least two of them, so every
   distinct fingerprint is dealt once to each pair of parts, by the value of those parts. A value that over ``hot``
   fingerprints share is dealt again by each pair of parts of the bits that are left, so a group is bounded by the bits
   that remain free, and a large group of near copies is spread over many tasks. This loses no pair (the same counting
   argument holds on the remaining bits).
3. A task sorts each of its groups by Gray rank, so that neighbours differ in few bits, and builds a hierarchy over the
   order: a leaf spans a few fingerprints and every node keeps the mask of bits that all below it share and their common
   pattern. A node factors out only bits its parent doesn't share yet. Going down from pairs of nodes, the differences of
   the factored bits add up; a pair of groups is left as soon as the sum exceeds max_bits.
4. What a group found leaves the task as a forest, at most one edge a fingerprint, and of bounded degree, so no row of
   the graph gets more than a few dozen edges.
5. Components come from rounds of hooking each node to a neighbour and contracting, as joins and
   aggregations over the linked fingerprints only. Each round is checkpointed in the shared folder.

Defined results: null and wordless texts have fingerprint zero and are linked like any other; a text of fewer words than
a shingle is one shingle. Rows without an id get no say in a component's id, and a component of such rows only has a null
id. Repeated rows come back as often as they come in. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm import common
from scorelake.session import materialize, settle

SEED = 42
HOT = 4096
MANY = 10_000
LEAF = 16
FAN = 8

#: Lower-cases A-Z and turns the white space of the word rule (0x20, 0x09 to 0x0D) into blanks.
WORD_BYTES = bytes(32 if 9 <= c <= 13 else b for c, b in enumerate(common.ASCII_LOWER))


def words_of(text: bytes) -> list[bytes]:
    return [w for w in text.translate(WORD_BYTES).split(b" ") if w]


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    found = [digest(whole[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    return np.array(found, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed number."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[start : start + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """The 64-bit fingerprint as a signed number."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row, in one scan."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.slices(batches, "text"):
            found = [fingerprint_of(x, shingle) for x in common.text_bytes(piece.column("text"))]
            yield pa.record_batch([piece.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


# --- the index ----------------------------------------------------------------------------------------------------


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray order."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def hierarchy(sorted_values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels from the leaves up: (first value of each node, mask of shared bits, shared pattern)."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    starts = np.arange(0, len(sorted_values), LEAF)
    both, any_ = np.bitwise_and.reduceat(sorted_values, starts), np.bitwise_or.reduceat(sorted_values, starts)
    levels = []
    while True:
        mask = both | (any_ ^ full)
        levels.append((starts, mask, both & mask))
        if len(starts) == 1:
            return levels
        cut = np.arange(0, len(starts), FAN)
        starts, both, any_ = starts[cut], np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(any_, cut)


def close_pairs(values: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs (i < j in Gray order) of the sorted distinct values within ``max_bits`` bits.

    Node pairs go down level by level. The difference so far is carried and only bits that both children share, and
    their parents didn't, are added to it.
    """
    levels = hierarchy(values)
    left = right = np.zeros(1, np.int64)
    so_far = np.zeros(1, np.int64)
    known = np.zeros(1, np.uint64)
    stack = [(len(levels) - 1, left, right, so_far, known)]
    while stack:
        level, left, right, so_far, known = stack.pop()
        _, mask, pattern = levels[level]
        shared = mask[left] & mask[right]
        so_far = so_far + np.bitwise_count((pattern[left] ^ pattern[right]) & shared & ~known)
        near = so_far <= max_bits
        left, right, so_far, known = left[near], right[near], so_far[near], shared[near] | known[near]
        if level:
            width, fan = len(levels[level - 1][0]), FAN
        else:
            width, fan = len(values), LEAF
        # few enough at once that the children of a block fit in a fixed space
        for at in range(0, len(left), 4096):
            part = slice(at, at + 4096)
            a = (left[part, None] * fan + np.arange(fan))[:, :, None]
            b = (right[part, None] * fan + np.arange(fan))[:, None, :]
            a, b = np.broadcast_arrays(a, b)
            fits = (a < width) & (b < width) & ((a <= b) if level else (a < b))
            n = np.count_nonzero(fits, axis=(1, 2))
            a, b = a[fits], b[fits]
            if level:
                stack.append((level - 1, a, b, np.repeat(so_far[part], n), np.repeat(known[part], n)))
            else:
                hit = np.bitwise_count(values[a] ^ values[b]) <= max_bits
                if hit.any():
                    yield a[hit], b[hit]


def roots_after(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each class after the links a-b are added; ``roots`` is the same before."""
    while True:
        x, y = roots[a], roots[b]
        apart = x != y
        if not apart.any():
            return roots
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while (again := roots[roots]).tobytes() != roots.tobytes():
            roots = again


def heaps(roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the members of each class as a heap, FAN children a node."""
    order = np.argsort(roots, kind="stable")
    first = np.searchsorted(roots[order], roots[order])  # where each member's class begins
    place = np.arange(len(order)) - first
    inner = place > 0
    return order[inner], order[first[inner] + (place[inner] - 1) // FAN]


def forest(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of bounded degree that join what links of ``values`` (unsigned, distinct) join."""
    values = values[np.argsort(gray_rank(values), kind="stable")]
    roots = np.arange(len(values))
    for a, b in close_pairs(values, max_bits):
        roots = roots_after(roots, a, b)
    a, b = heaps(roots)
    return values[a], values[b]


def parts(bits: int, count: int) -> list[int]:
    """Masks that cut the lowest ``bits`` bits into ``count`` parts."""
    cuts = [bits * i // count for i in range(count + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(max_bits: int, within: int | None = None) -> list[int]:
    """Masks of which two values within ``max_bits`` agree on at least one; over the bits of ``within`` only, if given."""
    if within is None:
        return [a | b for a, b in combinations(parts(64, max_bits + 2), 2)]
    places = [i for i in range(64) if within >> i & 1]
    cuts = [len(places) * i // (max_bits + 2) for i in range(max_bits + 3)]
    pieces = [sum(1 << p for p in places[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [a | b for a, b in combinations(pieces, 2)]


def dealt(values: DataFrame, max_bits: int, hot: int) -> DataFrame:
    """fp with the group keys (mask, key) under which it meets every other fingerprint within ``max_bits`` bits."""

    def keys(ms: list[int]) -> Column:
        return F.array(*[F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(signed(m)).alias("key")) for m in ms])

    first = values.select("fp", F.explode(keys(masks(max_bits))).alias("g")).select("fp", "g.mask", "g.key")
    crowded = first.groupBy("mask", "key").count().where(F.col("count") > hot).select("mask", "key", F.lit(True).alias("hot"))
    seen = first.join(crowded, ["mask", "key"], "left")
    finer = F.lit(None).cast("array<struct<mask:bigint,key:bigint>>")
    for m in masks(max_bits):
        rest = [m | x for x in masks(max_bits, ~m & (1 << 64) - 1)]
        finer = F.when(F.col("mask") == signed(m), keys(rest)).otherwise(finer)
    own = F.array(F.struct("mask", "key"))
    chosen = F.when(F.col("hot"), finer).otherwise(own)
    return seen.select("fp", F.explode(chosen).alias("g")).select("fp", "g.mask", "g.key").distinct()


def crowds(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The groups of two rows or more of batches that are sorted by ``keys`` (numbers). A group may go on in the next batch."""
    rest: list[pa.RecordBatch] = []
    last = None
    whole = lambda parts: parts[0] if len(parts) == 1 else pa.concat_batches(parts)
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        starts, stops = np.append(0, cut), np.append(cut, batch.num_rows)
        if rest and last != tuple(c[0] for c in columns):
            if sum(x.num_rows for x in rest) > 1:
                yield whole(rest)
            rest = []
        if len(starts) > 1:
            rest.append(batch.slice(0, stops[0]))
            if sum(x.num_rows for x in rest) > 1:
                yield whole(rest)
            rest = []
            for i in np.flatnonzero(stops[1:-1] - starts[1:-1] > 1) + 1:
                yield batch.slice(starts[i], stops[i] - starts[i])
        rest.append(batch.slice(starts[-1]))
        last = tuple(c[-1] for c in columns)
    if sum(x.num_rows for x in rest) > 1:
        yield whole(rest)


def links(values: DataFrame, max_bits: int = 2, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join exactly what all links within ``max_bits`` bits join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in crowds(batches, ("mask", "key")):
            a, b = forest(group.column("fp").to_numpy().view(np.uint64), max_bits)
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    groups = dealt(values, max_bits, hot).repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return groups.mapInArrow(run, "a long, b long").distinct()


# --- components ---------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node and root (one member for the whole component) of every node that has an edge.

    Each round hooks every node to the least of itself and its neighbours, in an order that a hash draws anew every round, follows two
    hooks, and goes on with the edges between what is left. Whatever the shape of a component, a round leaves a fraction of its nodes, so
    that rounds grow with the logarithm of the largest one. Nodes that have no edge any more keep their root.
    """
    number = 0
    edges = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    roots = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        drawn = lambda c, number=number: F.struct(F.xxhash64(F.lit(number), c).alias("h"), F.col(c).alias("up"))
        hook = both.groupBy("a").agg(F.min(drawn("b")).alias("least")).select("a", F.least(drawn("a"), F.col("least"))["up"].alias("up"))
        hook = settle(hook, "hook")
        number += 1
        far = hook.select(F.col("a").alias("up"), F.col("up").alias("top"))
        hook = settle(hook.join(far, "up").select(F.col("a").alias("node"), F.col("top").alias("up")), "hook")
        roots = settle(
            roots.join(hook.withColumnRenamed("node", "root"), "root", "left")
            .select("node", F.coalesce("up", "root").alias("root")),
            "roots",
        )
        ends = edges.join(hook.select(F.col("node").alias("a"), F.col("up").alias("x")), "a")
        ends = ends.join(hook.select(F.col("node").alias("b"), F.col("up").alias("y")), "b").where("x <> y")
        edges = settle(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return roots


def named_groups(rows: DataFrame, who: Column, max_bits: int, hot: int) -> DataFrame:
    """fp, its number of rows, and first (the least ``who`` of its component) of every fingerprint of ``rows``."""
    values = rows.groupBy("fp").agg(F.min(who).alias("least"), F.count("*").alias("rows"))
    roots = components(links(values.select("fp"), max_bits, hot))
    member = values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("least").alias("first"))
    return member.select("fp", "rows", "root").join(least, "root").select("fp", "rows", "first")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2, hot: int = HOT) -> DataFrame:
    """doc_id, fp and component_id (smallest id of the component) of every row."""
    rows = materialize(fingerprints(docs, doc_id, text, shingle))
    named = materialize(named_groups(rows, F.col("doc_id"), max_bits, hot))
    # fingerprints of more than one row in MANY, so at most as many, are sent to every task; no other key of the join is hot
    many = rows.count() // MANY
    crowded = named.where(F.col("rows") > many).select("fp", F.struct("first").alias("crowd"))
    found = rows.join(F.broadcast(crowded), "fp", "left")
    key = F.when(F.col("crowd").isNull(), F.col("fp")).otherwise(F.xxhash64("doc_id"))
    rest = named.where(F.col("rows") <= many).select(F.col("fp").alias("key"), F.struct("first").alias("rest"))
    found = found.withColumn("key", key).join(rest, "key", "left")
    return found.select("doc_id", "fp", F.coalesce("crowd", "rest")["first"].alias("component_id"))


def keep_representatives(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2, hot: int = HOT
) -> DataFrame:
    """One row of each component, in the columns of ``docs``: that of the smallest id, rows without an id last.

    Rows are told apart by id and text together, so an id that recurs with another text decides nothing about that text; rows
    of equal id and text are in one component, and one of them stays. Texts are shuffled once, by a digest of id and text.
    """
    key = next(name for i in range(len(docs.columns) + 1) if (name := f"row_digest_{i}") not in docs.columns)
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (doc_id, text)]
    keyed = docs.withColumn(key, F.unhex(F.md5(F.concat_ws("\0", *parts))))
    who = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(key).alias("key"))
    rows = materialize(fingerprints(keyed.select(who.alias("who"), F.col(text).alias("text")), "who", "text", shingle))
    named = named_groups(rows.withColumnRenamed("doc_id", "who"), F.col("who"), max_bits, hot)
    return keyed.join(named.select(F.col("first.key").alias(key)), key, "left_semi").dropDuplicates([key]).drop(key)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
