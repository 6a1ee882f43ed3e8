"""Benchmark decontamination by suffix arrays over the training text.

Words are runs of letters a-z (A-Z lower-cased), digits and characters beyond ASCII. A window is ``window`` consecutive
words of a benchmark item; an item of fewer words, but not none, is one window. A document word inside any occurrence of
a window is hit.

The documents are cut into shards of a bounded size inside the tasks that scan them. Each shard maps its words to the
numbers of the benchmark's words and keeps only runs of known words that are long enough to hold a window: nothing else
can match. Over what is kept it builds a suffix array by prefix doubling, and every benchmark suffix is binary-searched in
it, all at once, one word of depth after another, down to its window's length. The range of suffixes at window depth are
the window's places, from which hit words and matched items follow. The parts of the benchmark that occur are then sorted into the shard's
suffix array, where each kept position has its longest verbatim match beside it, read off as a common prefix, whatever else is in the
shard and however long the match. Documents aren't shuffled.

The benchmark is dealt into blocks of at most ``block_bytes`` bytes of text, by the hash of its items; one block is
broadcast at a time, and with more blocks the documents flow through one search after another in the same stage. An item
longer than that is a block of its own.

Defined results: null texts and texts without words have no words, no hits and no items. Repeated item ids count once for
a document; repeated documents are judged each. Items without an id still mark words, but aren't listed. Columns of the
documents with other names pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm import common

#: Lower-cases A-Z and turns every ASCII byte that is neither letter nor digit into a blank.
WORD_BYTES = bytes(
    b if c >= 128 or 48 <= c <= 57 or 97 <= b <= 122 else 32 for c, b in enumerate(common.ASCII_LOWER)
)
FOUND = {
    "n_words": T.LongType(),
    "hits": T.ArrayType(T.IntegerType()),
    "items": T.ArrayType(T.StringType()),
    "longest": T.IntegerType(),
    "longest_at": T.IntegerType(),
}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass(frozen=True)
class Block:
    """Part of the benchmark: words as numbers from 1, one row of positions after another, 0 after each item."""

    vocabulary: dict[bytes, int]
    words: np.ndarray
    item: np.ndarray  # of each position
    names: list[str | None]
    depth: np.ndarray  # window length of the window that starts at each position, or 0
    least: int  # the shortest window


def block_of(items: list[tuple[str | None, bytes]], window: int) -> Block:
    vocabulary: dict[bytes, int] = {}
    words, item, depth, names = [], [], [], []
    for name, text in items:
        own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        if not own:
            continue
        n = len(own)
        starts = np.zeros(n + 1, np.int32)
        starts[: max(1, n - window + 1)] = min(n, window)
        words.append(np.array([*own, 0], np.int32))
        depth.append(starts)
        item.append(np.full(n + 1, len(names), np.int32))
        names.append(name)
    flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int32)
    depths = flat(depth)
    return Block(vocabulary, flat(words), flat(item), names, depths, int(depths[depths > 0].min()) if len(names) else 0)


def suffix_array(values: np.ndarray, levels: list[np.ndarray] | None = None) -> np.ndarray:
    """Order of the suffixes of ``values`` (numbers from 0) by prefix doubling; ``levels`` gets the rank of each suffix by its first 1, 2, 4, ... values."""
    n = len(values)
    rank = values.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        if levels is not None:
            levels.append(rank)
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))[:n]
        rank = new
        step *= 2
        if n == 0 or rank[order[-1]] == n - 1 or step >= n:
            return order


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values that the suffixes at ``a`` and ``b`` share from their start, longest power of two first."""
    a, b, shared = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero(levels[k][a] == levels[k][b])
        a[same] += 1 << k
        b[same] += 1 << k
        shared[same] += 1 << k
    return shared


def bound(text: np.ndarray, order: np.ndarray, first: np.ndarray, last: np.ndarray, word: np.ndarray, depth: int, right: bool) -> np.ndarray:
    """Where ``word`` begins (or ends) at that depth in each range of the suffix array of ``text``, which has one more value, the least, behind it."""
    first, last = first.copy(), last.copy()
    while (first < last).any():
        middle = (first + last) // 2
        seen = text[np.minimum(order[np.minimum(middle, len(order) - 1)].astype(np.int64) + depth, len(text) - 1)]
        go = ((seen <= word) if right else (seen < word)) & (first < last)
        first, last = np.where(go, middle + 1, first), np.where(go | (first >= last), last, middle)
    return first


def search(text: np.ndarray, order: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each benchmark suffix: its suffix-array range at window depth.

    All suffixes narrow their range by one word at a time; a suffix leaves when its range is empty or its window ends.
    """
    m = len(block.words)
    low, high = np.zeros(m, np.int64), np.full(m, len(order), np.int64)
    window_low, window_high = np.zeros(m, np.int64), np.zeros(m, np.int64)
    padded = np.append(text, np.iinfo(np.int64).min)
    live = np.flatnonzero(block.depth > 0)
    depth = 0
    while len(live):
        word = block.words[live + depth]
        a = bound(padded, order, low[live], high[live], word, depth, False)
        b = bound(padded, order, a, high[live], word, depth, True)
        some = b > a
        live, a, b = live[some], a[some], b[some]
        low[live], high[live] = a, b
        depth += 1
        full = block.depth[live] == depth
        window_low[live[full]], window_high[live[full]] = a[full], b[full]
        live = live[~full]
    return window_low, window_high


def longest_matches(text: np.ndarray, order: np.ndarray, block: Block) -> np.ndarray:
    """Words of the longest match of each position of ``text`` with the benchmark, where it has ``block.least`` at least; else 0.

    Only the parts of the benchmark go on whose first ``least`` words are somewhere in the text. They join the text in one suffix array:
    the longest match of a position is with the nearest of them on either side, by common prefixes. A number of the text
    that isn't positive ends a run, and each is another.
    """
    best = np.zeros(len(text), np.int64)
    size = block.least
    padded = np.append(text, np.iinfo(np.int64).min)
    left = ranges_left(block.words > 0)
    live = np.flatnonzero(left >= size)
    low, high = np.zeros(len(live), np.int64), np.full(len(live), len(order), np.int64)
    for depth in range(size):
        word = block.words[live + depth]
        low = bound(padded, order, low, high, word, depth, False)
        high = bound(padded, order, low, high, word, depth, True)
        some = high > low
        live, low, high = live[some], low[some], high[some]
    if not len(live):
        return best
    change = np.zeros(len(block.words) + 1, np.int64)
    np.add.at(change, live, 1)
    np.add.at(change, live + size, -1)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]))))
    begin, stop = edge[::2], edge[1::2]
    part = block.words[ranges(begin, stop - begin + 1) % len(block.words)].astype(np.int64)
    part[np.cumsum(stop - begin + 1) - 1] = text.min() - 1 - np.arange(len(begin))  # each part ends by itself too
    both = np.concatenate((text, part))
    levels: list[np.ndarray] = []
    sorted_ = suffix_array(both - both.min(), levels)
    theirs = sorted_ >= len(text)
    at = np.arange(len(sorted_))
    before = np.maximum.accumulate(np.where(theirs, at, -1))
    after = np.minimum.accumulate(np.where(theirs, at, len(at))[::-1])[::-1]
    mine = np.flatnonzero(~theirs)
    for near in (before[mine], after[mine]):
        some = np.flatnonzero((near >= 0) & (near < len(at)))
        own = sorted_[mine[some]]
        best[own] = np.maximum(best[own], common_prefixes(levels, own, sorted_[near[some]]))
    best[best < size] = 0
    return best


def ranges_left(inside: np.ndarray) -> np.ndarray:
    """How many places from each on lie inside, one after another."""
    ends = np.flatnonzero(~inside)
    next_end = np.append(ends, len(inside))[np.searchsorted(ends, np.arange(len(inside)))]
    return next_end - np.arange(len(inside))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for lengths[i] numbers each, one after another."""
    total = int(lengths.sum())
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(total)


def shard_hits(block: Block, docs: list[list[bytes]]) -> tuple[list[np.ndarray], list[list[str]], np.ndarray, np.ndarray]:
    """Of each document: hit word positions, matched items, words of the longest verbatim match, and where it is."""
    n = len(docs)
    sizes = np.fromiter(map(len, docs), np.int64, n)
    none = [np.zeros(0, np.int32)] * n, [[]] * n, np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not block.names or not sizes.sum():
        return none
    get, missing = block.vocabulary.get, 0
    first = np.cumsum(sizes + 1) - sizes - 1
    flat = np.zeros(int(sizes.sum()) + n, np.int32)  # 0 after each document
    flat[ranges(first, sizes)] = np.fromiter((get(w, missing) for words in docs for w in words), np.int32, int(sizes.sum()))
    # runs of known words, of which only those that can hold a window go on, each with a 0 behind it
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (flat > 0).astype(np.int8), [0]))))
    begin, stop = edge[::2], edge[1::2]
    long_enough = stop - begin >= block.least
    begin, stop = begin[long_enough], stop[long_enough]
    if not len(begin):
        return none
    place = ranges(begin, stop - begin + 1)  # place of each kept word in flat; the 0 too
    text = flat[place].astype(np.int64)
    behind = np.cumsum(stop - begin + 1) - 1
    text[behind] = -1 - np.arange(len(behind))  # no two runs compare beyond their ends
    order = suffix_array(text - text.min())
    low, high = search(text, order, block)
    doc_of = lambda places: np.searchsorted(first, places, side="right") - 1
    # distinct ranges are spread out once, whatever number of items has the window
    windows = np.flatnonzero(high > low)
    change = np.zeros(len(flat) + 1, np.int64)
    listed: list[list[str]] = [[] for _ in range(n)]
    if len(windows):
        spans, which = np.unique(np.column_stack((low[windows], high[windows], block.depth[windows])), axis=0, return_inverse=True)
        which = which.ravel()
        count = spans[:, 1] - spans[:, 0]
        places = place[order[ranges(spans[:, 0], count)]]
        np.add.at(change, places, 1)
        np.add.at(change, places + np.repeat(spans[:, 2], count), -1)
        # (window, document) once each, then the window's items
        pairs = np.unique(np.repeat(np.arange(len(spans)), count) * n + doc_of(places))
        members = np.unique(which * len(block.names) + block.item[windows])
        span_of, item_of = members // len(block.names), members % len(block.names)
        from_, to = np.searchsorted(span_of, pairs // n), np.searchsorted(span_of, pairs // n, side="right")
        found = np.unique(np.repeat(pairs % n, to - from_) * len(block.names) + item_of[ranges(from_, to - from_)])
        for d, i in zip((found // len(block.names)).tolist(), (found % len(block.names)).tolist(), strict=True):
            if block.names[i] is not None:
                listed[d].append(block.names[i])
    hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    cuts = np.searchsorted(hit, np.append(first, len(flat)))
    hits = [(hit[a:b] - f).astype(np.int32) for a, b, f in zip(cuts, cuts[1:], first.tolist(), strict=False)]
    longest, longest_at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    best = longest_matches(text, order, block)
    tops = np.flatnonzero(best >= block.least)
    places, best = place[tops], best[tops]
    owner = doc_of(places)
    by = np.lexsort((-places, best, owner))
    longest[owner[by]], longest_at[owner[by]] = best[by], (places - first[owner])[by]
    return hits, listed, longest, longest_at


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks whose mean size is half of ``block_bytes``, by the hash of the item."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()["size"]
    count = max(1, -(-size * 2 // block_bytes)) if size > block_bytes else 1
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k) if count > 1 else items
        yield sorted(((r["item"], r["text"].encode()) for r in part.toLocalIterator()), key=lambda x: (x[0] is None, x))


def search_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                     window: int = 10, block_bytes: int = 32 << 20, prefix: str = "__") -> DataFrame:
    """``docs`` with what was found, in columns named ``prefix`` and n_words, hits, items, longest and longest_at.

    hits: positions of hit words, from 0; items: ids with an occurring window; longest: words of the document's longest
    verbatim match with an item (of those of a block's shortest window at least), longest_at: the first position where one begins.
    """
    found = T.StructType([T.StructField(prefix + name, kind) for name, kind in FOUND.items()])
    base = docs.drop(*found.names)
    empty = [(F.array() if isinstance(kind, T.ArrayType) else F.lit(0)).cast(kind).alias(prefix + name) for name, kind in FOUND.items()]
    out = base.select("*", *empty)
    sc = docs.sparkSession.sparkContext
    for items in benchmark_blocks(benchmark, item_id, item_text, block_bytes):
        shared = sc.broadcast(block_of(items, window))  # at most block_bytes of text, or one item

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for piece in common.slices(batches, text):
                words = [words_of(x) for x in common.text_bytes(piece.column(text))]
                hits, items, longest, at = shard_hits(shared.value, words)
                had = [piece.column(prefix + c) for c in ("hits", "items", "longest", "longest_at")]
                hits = [np.union1d(a.values.to_numpy(), b) if len(a.values) else b for a, b in zip(had[0], hits, strict=True)]
                items = [sorted({*a.as_py(), *b}) if len(a.values) else sorted(set(b)) for a, b in zip(had[1], items, strict=True)]
                before, there = had[2].to_numpy(), had[3].to_numpy()
                more = (longest > before) | (longest == before) & (at < there)
                new = {
                    "n_words": pa.array([len(w) for w in words], pa.int64()),
                    "hits": pa.array(hits, pa.list_(pa.int32())),
                    "items": pa.array(items, pa.list_(pa.string())),
                    "longest": pa.array(np.where(more, longest, before), pa.int32()),
                    "longest_at": pa.array(np.where(more, at, there), pa.int32()),
                }
                kept = [c for c in piece.schema.names if c not in found.names]
                yield pa.record_batch([*map(piece.column, kept), *new.values()], [*kept, *(prefix + c for c in new)])

        out = out.mapInArrow(run, T.StructType([*base.schema.fields, *found.fields]))
    return out


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 10) -> DataFrame:
    """One row a document: how much of it is hit, by which items, and its longest verbatim match."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = search_documents(rows, benchmark, window=window)
    ids = F.array_join(F.array_sort("__items"), ",")
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.size("__hits").cast("long").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (F.size("__hits") > 0).alias("contaminated"),
        F.col("__longest").cast("long").alias("longest"),
        F.col("__longest_at").cast("long").alias("longest_at"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs`` without a hit word."""
    return search_documents(docs, benchmark, text, window=window).where(F.size("__hits") == 0).select(*docs.columns)


def items_digest(items: list[str]) -> str:
    """What ``report`` gives for a list of item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
