"""What the operators share: typed columns, bounded slices of Arrow batches, bytes of texts and case folding."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text a task works on at once. A longer text is a slice of its own.
SLICE_BYTES = 4 << 20

#: Lower-cases A-Z and nothing else, on UTF-8 bytes.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def is_remainder(doc_id: str, n: int, value: int) -> Column:
    """Whether the remainder is ``value``; false for a null id."""
    return F.coalesce(id_remainder(doc_id, n) == value, F.lit(False))


def bounded_sample(rows: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` of the distinct (h, label, text) rows of each label, those of the lowest hash h.

    Texts stay out of the ranking; the chosen keys, at most ``most`` a label, are broadcast to fetch them.
    """
    keyed = rows.withColumn("t", F.xxhash64("text"))
    chosen = lowest(keyed.select(F.col("h").alias("r"), "t", label).distinct(), label, most, "t").withColumnRenamed("r", "h")
    return keyed.join(F.broadcast(chosen), ["h", "t", label], "left_semi").dropDuplicates(["h", "t", label]).drop("t")


def lowest(keys: DataFrame, label: str, most: int, *then: str) -> DataFrame:
    """At most ``most`` rows of each label, those of the lowest hash ``r`` (ties by the columns ``then``); keys: distinct rows.

    Rows beyond twice the hash below which ``most`` of a label are expected never reach the ranking, so one label of most rows is no
    hot key.
    """
    sizes = keys.groupBy(label).agg(F.count("*").alias("size"))  # a row a label
    share = F.lit(2.0 * most) / F.col("size")
    near = keys.join(F.broadcast(sizes), label).where((share >= 1) | (F.col("r").cast("double") / 2.0**63 < 2 * share - 1)).drop("size")
    rank = F.row_number().over(Window.partitionBy(label).orderBy("r", *then))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece hold at most ``limit`` bytes, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives b""."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def joined(values: list[bytes], pad: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one byte array, ``pad`` zero bytes after each; and where each begins and ends."""
    gap = bytes(pad)
    data = np.frombuffer(gap.join([*values, b""]) if pad else b"".join(values), np.uint8)
    size = np.fromiter(map(len, values), np.int64, len(values))
    ends = np.cumsum(size + pad) - pad
    return data, ends - size, ends


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of rows starts[i]:ends[i] of ``values``; ranges ascend and don't overlap, and may be empty."""
    out = np.zeros((len(starts), *values.shape[1:]), np.float64)
    some = np.flatnonzero(ends > starts)
    if len(some):
        cuts = np.ravel(np.column_stack((starts[some], ends[some])))
        inside = cuts[:-1] if cuts[-1] == len(values) else cuts
        out[some] = np.add.reduceat(values, inside, axis=0, dtype=np.float64)[::2]
    return out


#: A blank alone between other characters.
ALONE = re.compile(r"(?<=\S) (?=\S)")


class OddlyCut(Exception):
    """A piece that is empty or begins with white space: blanks of the text don't stand alone."""


class Remembered(dict):
    """Ids of pieces, made when they are first asked for; those of an older generation move over."""

    def __init__(self, make: Callable[[str], bytes], longest: int, older: dict[str, bytes]) -> None:
        super().__init__()
        self.make, self.longest, self.older = make, longest, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= self.longest:
            self[piece] = ids
        return ids


class PieceEncoder:
    """Encodes texts piece by piece, and remembers pieces.

    Tokenizers of the byte-level kind begin a match at a blank that has no white space behind it, whatever is ahead of it. So
    a text may be cut there, and the ids of a text are those of its pieces, each with its blank. With ``lines`` a single new line is a
    match of its own too, and the text is also cut ahead of it. ``encode`` gives the ids of a text's first piece, ``encode_piece`` those of
    another, without its blank or with its new line, as bytes; it raises OddlyCut for what it is not sure of, and
    ``encode_odd`` gives the ids of any piece that was cut at lone blanks only. A bounded number of
    pieces of bounded length is remembered, in two generations: a full one is kept as the older one until the next is full, and
    pieces that come again move over. Forgetting costs time and nothing else.

    With ``ahead`` the new pieces of a call are encoded together before its texts: it gives pieces with what ``encode_piece`` would give, and
    may leave some out.
    """

    def __init__(
        self, encode: Callable[[str], bytes], encode_piece: Callable[[str], bytes], encode_odd: Callable[[str], bytes],
        lines: bool = False, most: int = 400_000, longest: int = 64, ahead: Callable[[list[str]], Iterable[tuple[str, bytes]]] | None = None,
    ) -> None:
        self.encode, self.encode_piece, self.encode_odd, self.ahead = encode, encode_piece, encode_odd, ahead
        self.lines, self.most, self.longest = lines, most, longest
        self.known = Remembered(encode_piece, longest, {})
        self.heads = Remembered(encode, longest, {})

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Nothing here makes a cycle of references, and looking for some costs a third of the time, so that waits."""
        if len(self.known) > self.most:
            self.known.older = {}
            self.known = Remembered(self.encode_piece, self.longest, self.known)
        if len(self.heads) > self.most // 10:
            self.heads.clear()
        looking = gc.isenabled()
        gc.disable()
        try:
            cut = map(self.pieces, texts)
            if self.ahead:
                cut = list(cut)
                new = set().union(*cut) - self.known.keys() - self.known.older.keys()
                self.known.update(self.ahead([p for p in new if len(p) <= self.longest]))
            return list(map(self.one, texts, cut))
        finally:
            if looking:
                gc.enable()

    def pieces(self, text: str) -> list[str]:
        return (text.replace("\n", " \n") if self.lines else text).split(" ")

    def one(self, text: str, pieces: list[str]) -> bytes:
        head = self.heads[pieces.pop(0)]
        try:
            return head + b"".join(map(self.known.__getitem__, pieces))
        except OddlyCut:
            head, *pieces = ALONE.split(text)
            return self.heads[head] + b"".join(map(self.encode_odd, pieces))


def surely_cut(piece: str) -> bool:
    """Whether a piece is not empty and doesn't begin with white space (or, to be cheap, another control character)."""
    return piece >= "!" and not (piece >= "\x80" and piece[0].isspace())
