"""Read large JSON documents that hold one long list, split by split.

A file is read as text that ends at closing braces, so Spark cuts it into splits like any other text. What a split begins with, inside a
string or not and how deep, follows from the splits before it: the parity of their quotes and the sum of their brackets.
Three scans, each a row-local pass over byte arrays:

1. every split gives its parity, and the change of depth for both ways to begin; sums over earlier splits, a row a split, give
   where each begins;
2. every split names the lists under ``results`` near the top, and the first places where the depth falls back; from that, a file's rows
   of a few numbers a split tell which list is meant and where it ends;
3. every split cuts its part of the list at the commas of the list's own depth. Elements that lie across splits come as pieces, at
   most two a split, and are put together; what is beside the list is the document's shell, with the list empty.

Accepted are a bare list, ``{"results": [..]}`` and ``{"results": {"results": [..]}}``; of a repeated key the last counts. The key is
looked for as it is usually written, without escapes. Elements are cut, not checked; see ``results.load_results``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.session import materialize

#: Splits whose states are sent to every task: some 50 MB. States of more splits are joined by a shuffle.
BROADCAST_SPLITS = 500_000

_ESCAPE = re.compile(rb"\\.", re.S)
_KEY = re.compile(rb'"results"\s*:\s*([\[{])')
_NEVER = (1 << 62, 0)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", "true").option("lineSep", "}").text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("file_size"),
        "value",
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes, bool]]:
    """The text of each split in runs: the first row's other columns, bytes with the closing braces put back, and whether it begins the split."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, starts = batch.column("file_path").dictionary_encode(), batch.column("split").to_numpy()
        codes = paths.indices.to_numpy()
        begins = np.append(0, np.flatnonzero((starts[1:] != starts[:-1]) | (codes[1:] != codes[:-1])) + 1)
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows], strict=True):
            head = {c: batch.column(c)[a].as_py() for c in batch.schema.names if c != "value"}
            texts = batch.column("value").slice(a, b - a).cast(pa.binary()).to_pylist()
            own = (head["file_path"], head["split"])
            yield head, b"}".join([*texts, b""]), own != last
            last = own


def _plain(data: bytes) -> bytes:
    """The same length without escapes, so that every quote begins or ends a string."""
    return _ESCAPE.sub(b"__", data) if b"\\" in data else data


def _change(parts: list[bytes]) -> int:
    text = b"".join(parts)
    return text.count(b"{") + text.count(b"[") - text.count(b"}") - text.count(b"]")


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(head: dict, state: list) -> pa.RecordBatch:
        columns = [[head["file_path"]], [head["split"]], [head["file_size"]], *[[x] for x in state]]
        return pa.record_batch([pa.array(c) for c in columns], ["file_path", "split", "file_size", "parity", "outside", "inside", "size"])

    head, state = None, [0, 0, 0, 0]
    for own, data, fresh in _runs(batches):
        if fresh and head is not None:
            yield row(head, state)
        if fresh:
            head, state = own, [0, 0, 0, 0]
        parts = _plain(data).split(b'"')
        even, odd = _change(parts[0::2]), _change(parts[1::2])
        if state[0]:
            even, odd = odd, even
        state = [(state[0] + len(parts) - 1) % 2, state[1] + even, state[2] + odd, state[3] + len(data)]
    if head is not None:
        yield row(head, state)


def _states(scan: DataFrame) -> DataFrame:
    """A row a split: what it begins with, and whether the file's last brace is its own or was put there by the scan."""
    found = materialize(scan.mapInArrow(_summary, "file_path string, split long, file_size long, parity long, outside long, inside long, size long"))
    earlier = Window.partitionBy("file_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file_path")
    begun = found.withColumn("in_string", (F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2).cast("int"))
    begun = begun.withColumn("change", F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside")))
    return begun.select(
        "file_path", "split", "in_string", F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("depth"),
        (F.sum("size").over(whole) <= F.col("file_size")).alias("closed"),
        (F.col("split") == F.max("split").over(whole)).alias("is_last"),
    )


def _placed(scan: DataFrame, states: DataFrame) -> DataFrame:
    """Rows of the scan with the state of their split, in the scan's order."""
    states = materialize(states)
    if states.count() <= BROADCAST_SPLITS:
        return scan.join(F.broadcast(states), ["file_path", "split"])
    joined = scan.withColumn("at", F.monotonically_increasing_id()).join(states, ["file_path", "split"])
    return joined.repartition("file_path", "split").sortWithinPartitions("file_path", "split", "at").drop("at")


class _Depths:
    """Which bytes of a run lie outside strings, and the depth behind each."""

    def __init__(self, data: bytes, in_string: int, depth: int) -> None:
        self.plain = _plain(data)
        self.bytes = np.frombuffer(self.plain, np.uint8)
        quotes = self.bytes == 34
        self.inside = ((np.cumsum(quotes) + in_string) & 1).astype(bool)
        out = ~self.inside
        step = ((self.bytes == 123) | (self.bytes == 91)).astype(np.int8) - ((self.bytes == 125) | (self.bytes == 93)).astype(np.int8)
        step[~out] = 0
        self.step = step
        self.depth = depth + np.cumsum(step, dtype=np.int64)
        self.end = (int(self.inside[-1]) if len(data) else in_string, int(self.depth[-1]) if len(data) else depth)

    def falls(self, to: int, after: int = -1) -> int:
        """First place behind ``after`` where a bracket closes to the depth, or -1."""
        found = np.flatnonzero((self.step[after + 1 :] < 0) & (self.depth[after + 1 :] == to))
        return int(found[0]) + after + 1 if len(found) else -1


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By run: lists and objects that may be meant, as (offset, depth inside, is a list, where it closes), and first falls."""
    state, offset = (0, 0), 0
    for head, data, fresh in _runs(batches):
        if fresh:
            state, offset = (head["in_string"], head["depth"]), 0
        depths = _Depths(data, *state)
        opened: list[tuple[int, int, bool, int]] = []
        if head["split"] == 0 and offset == 0:
            at = len(data) - len(data.lstrip(b" \t\r\n"))
            if data[at : at + 1] == b"[":
                opened.append((at, 1, True, depths.falls(0, at)))
        for m in _KEY.finditer(depths.plain):
            at = m.start(1)
            if depths.inside[m.start()] and not depths.inside[at] and depths.depth[at] in (2, 3):
                opened.append((at, int(depths.depth[at]), m[1] == b"[", depths.falls(int(depths.depth[at]) - 1, at)))
        columns = [[x + offset if i in (0, 3) and x >= 0 else x for x in c] for i, c in enumerate(zip(*opened, strict=True))] or [[]] * 4
        falls = [x + offset if x >= 0 else x for x in (depths.falls(d) for d in (0, 1, 2))]
        lists = [pa.array([c], pa.list_(k)) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=True)]
        names = ["file_path", "split", "falls", "at", "inside", "is_list", "closes"]
        yield pa.record_batch([pa.array([head["file_path"]]), pa.array([head["split"]]), pa.array([falls], pa.list_(pa.int64())), *lists], names)
        state, offset = depths.end, offset + len(data)


def _meant(key: tuple, runs: pd.DataFrame) -> pd.DataFrame:
    """The list of a file that holds its results: depth inside it, and the (split, offset) of its brackets."""
    falls = sorted((int(s), int(f), d) for s, fs in zip(runs["split"], runs["falls"], strict=True) for d, f in enumerate(fs) if f >= 0)

    def closing(split: int, inside: int, closes: int) -> tuple[int, int]:
        if closes >= 0:
            return split, closes
        # the split of the opening bracket has no fall behind it, so the next is in a later one, or in a later run of the split
        return next(((s, f) for s, f, d in falls if d == inside - 1 and (s, f) > (split, at)), _NEVER)

    opened = []
    for split, *lists in zip(*(runs[c] for c in ("split", "at", "inside", "is_list", "closes")), strict=True):
        for at, inside, is_list, closes in zip(*lists, strict=True):
            opened.append(((int(split), int(at)), int(inside), bool(is_list), closing(int(split), int(inside), int(closes))))
    opened.sort()
    found = [x for x in opened if x[1] == 1]
    first = [x for x in opened if x[1] == 2][-1:]
    if not found and first:
        start, _, is_list, end = first[0]
        found = first if is_list else [x for x in opened if x[1] == 3 and x[2] and start < x[0] < end][-1:]
    rows = [(key[0], x[1], *x[0], *x[3]) for x in found]
    return pd.DataFrame(rows, columns=["file_path", "inside", "from_split", "from_at", "to_split", "to_at"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file_path, split, kind, at, text): whole elements e and pieces p by the commas of the list ahead of them in their
    split, the number of those commas c, and pieces of the shell s."""
    names = ["file_path", "split", "kind", "at", "text"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    head, rest, commas, begun, shell, out = None, b"", 0, False, 0, []

    def finish() -> None:
        """The end of a split: what is left goes on in the next."""
        if head is not None:
            if rest:
                out.append(("p", commas, rest))
            out.append(("c", commas, b""))

    def flush() -> pa.RecordBatch:
        rows = [(head["file_path"], head["split"], k, n, t.decode("utf-8", "replace")) for k, n, t in out]
        out.clear()
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    state, offset = (0, 0), 0
    for own, data, fresh in _runs(batches):
        if fresh:
            finish()
            if head is not None:
                yield flush()
            head, rest, commas, begun, shell = own, b"", 0, False, 0
            state, offset = (own["in_string"], own["depth"]), 0
        depths = _Depths(data, *state)
        split, n = own["split"], len(data)
        start = stop = n if own["inside"] is None else None
        if start is None:
            here = lambda s, at: n if s > split else 0 if s < split else min(max(at - offset, 0), n)
            opening = own["from_split"] == split and offset <= own["from_at"] < offset + n
            start, stop = here(own["from_split"], own["from_at"] + 1), here(own["to_split"], own["to_at"])
            closing = own["to_split"] == split and offset <= own["to_at"] < offset + n
        else:
            opening = closing = False
        if start:
            out.append(("s", shell, data[:start]))
            shell += 1
        if start < stop or opening or closing:
            if opening:
                begun = True  # the first element begins here, not in an earlier split
            inside = slice(start, stop)
            cuts = np.flatnonzero((depths.bytes[inside] == 44) & ~depths.inside[inside] & (depths.depth[inside] == own["inside"])) + start
            at = start
            for cut in [*cuts.tolist(), *[stop] * closing]:
                text, rest = rest + data[at:cut], b""
                out.append(("e" if begun else "p", commas, text))
                begun, at = True, cut + 1
                commas += cut < stop
            if not closing:
                rest += data[at:stop]
        if stop < n:
            out.append(("s", shell, data[stop:]))
            shell += 1
        if sum(len(t) for *_, t in out) > 1 << 23:
            yield flush()
        state, offset = depths.end, offset + n
    finish()
    if head is not None:
        yield flush()


def split_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Elements (file_path, ord, element) of the lists and shells (file_path, shell) of the documents below a path.

    An empty list has no element. A file without such a list is a shell only, and the shell of a list with nothing between two
    commas is null.
    """
    scan = _scan(spark, path)
    states = materialize(_states(scan))
    placed = _placed(scan, states.select("file_path", "split", "in_string", "depth"))
    runs = placed.mapInArrow(
        _places, "file_path string, split long, falls array<long>, at array<long>, inside array<long>, is_list array<boolean>, closes array<long>"
    )
    # rows of a few numbers, some a split
    place = "file_path string, inside long, from_split long, from_at long, to_split long, to_at long"
    meant = runs.groupBy("file_path").applyInPandas(_meant, place)
    begun = states.join(meant, "file_path", "left")
    cut = materialize(_placed(scan, begun).mapInArrow(_cut, "file_path string, split long, kind string, at long, text string"))
    earlier = Window.partitionBy("file_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.where("kind = 'c'").select("file_path", "split", F.coalesce(F.sum("at").over(earlier), F.lit(0)).alias("before"))
    side = materialize(counts)
    side = F.broadcast(side) if side.count() <= BROADCAST_SPLITS else side
    placed_rows = cut.where("kind in ('e', 'p')").join(side, ["file_path", "split"])
    ord_ = (F.col("at") + F.col("before")).alias("ord")
    text = lambda rows, order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"]), "")
    whole = placed_rows.where("kind = 'e'").select("file_path", ord_, F.col("text").alias("element"))
    pieces = placed_rows.where("kind = 'p'").select("file_path", ord_, "split", "text")
    joined = pieces.groupBy("file_path", "ord").agg(text(pieces, ["split"]).alias("element"))  # of one element
    elements = whole.unionByName(joined)
    blank = F.col("element").rlike(r"^[ \t\r\n]*$")
    # nothing between two brackets is an empty list, nothing between commas is an error
    gaps = elements.groupBy("file_path").agg(((F.max("ord") > 0) & F.bool_or(blank)).alias("gap"))
    shells = cut.where("kind = 's'").groupBy("file_path").agg(text(cut, ["split", "at"]).alias("shell"))
    ended = states.where("is_last").select("file_path", "closed")
    shells = shells.join(ended, "file_path").withColumn("shell", F.when(F.col("closed"), F.col("shell")).otherwise(F.expr("left(shell, length(shell) - 1)")))
    shells = shells.join(gaps, "file_path", "left").select("file_path", F.when(~F.coalesce("gap", F.lit(False)), F.col("shell")).alias("shell"))
    return elements.where(~blank), shells
