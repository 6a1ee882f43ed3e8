"""Token ids as wavelet matrices, one succinct file a shard.

A wavelet matrix keeps one bit-plane for each bit of an id, from the highest; after each plane the ids are dealt stably,
zeros ahead of ones. With the counts of ones before every block of a plane, access to a position, the count of an id up to
a position (rank) and the place of its k-th occurrence (select) take one step a plane, without decoding the shard.

File format of a shard, little-endian: the magic ``WMX1``, bits and reserved as 32-bit, ids as 64-bit; then for each plane the
number of its zeros as 64-bit and the length of its compressed bits as 64-bit, and the bits, packed lowest first and
compressed with zstandard. The block counts are made when a plane is opened.

``write`` brings documents in ascending order of id, encodes them, ends each with ``end`` and writes rows of shards through
Spark, so that any store Spark writes to can hold them; a shard row names its documents and their lengths, and where the shard
begins within its partition. ``read_documents`` gives each document's place from the files alone: a sum over partitions, of
which there are few, adds what lies before a partition.

Defined results: null counts as the empty text and has the end id only. Documents with the same id keep the order of the
scan, null ids come first. A document longer than ``shard_tokens`` is a shard of its own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scorelake.llm import common

MAGIC = b"WMX1"
BLOCK = 512  # bits between two counts
SHARD_TOKENS = 1 << 20


class WaveletMatrix:
    """Planes of packed bits with counts; made from ids or from a file."""

    def __init__(self, size: int, planes: list[np.ndarray], zeros: list[int]) -> None:
        self.size, self.planes, self.zeros = size, planes, zeros
        self.bits = len(planes)
        self.counts: list[np.ndarray | None] = [None] * self.bits

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        values = np.ascontiguousarray(ids, np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for bit in range(bits - 1, -1, -1):
            ones = (values & values.dtype.type(1 << bit)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            low = values.take(np.flatnonzero(~ones))  # by places: a mask of random bits is slow
            zeros.append(len(low))
            values = np.concatenate((low, values.take(np.flatnonzero(ones))))
        return cls(len(values), planes, zeros)

    def to_bytes(self) -> bytes:
        out = [MAGIC, struct.pack("<IIQ", self.bits, 0, self.size)]
        pack = zstandard.ZstdCompressor(level=1).compress
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            data = pack(plane.tobytes())
            out += struct.pack("<QQ", zeros, len(data)), data
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        bits, _, size = struct.unpack_from("<IIQ", data, 4)
        at, planes, zeros = 20, [], []
        unpack = zstandard.ZstdDecompressor().decompress
        for _ in range(bits):
            zero, length = struct.unpack_from("<QQ", data, at)
            at += 16
            planes.append(np.frombuffer(unpack(data[at : at + length]), np.uint8) if size else np.zeros(0, np.uint8))
            zeros.append(zero)
            at += length
        return cls(size, planes, zeros)

    def values(self) -> np.ndarray:
        """All ids: the planes undone from the lowest."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.size, kind)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.size, bitorder="little").view(bool)
            before = np.empty(self.size, kind)
            before[np.flatnonzero(~ones)] = values[: self.zeros[level]]
            before[np.flatnonzero(ones)] = values[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            values = before
        return values

    def ones_before(self, level: int, at: int) -> int:
        """Ones of a plane ahead of a position."""
        plane = self.planes[level]
        if self.counts[level] is None:
            each = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), BLOCK // 8), dtype=np.int64) if len(plane) else []
            self.counts[level] = np.concatenate(([0], np.cumsum(each, dtype=np.int64)))
        block = at // BLOCK
        whole = plane[block * BLOCK // 8 : at // 8]
        rest = int(plane[at // 8]) & (1 << at % 8) - 1 if at % 8 else 0
        return int(self.counts[level][block]) + int(np.bitwise_count(whole).sum(dtype=np.int64)) + rest.bit_count()

    def access(self, at: int) -> int:
        """The id at a position."""
        value = 0
        for level in range(self.bits):
            one = int(self.planes[level][at // 8]) >> at % 8 & 1
            value = value << 1 | one
            ones = self.ones_before(level, at)
            at = self.zeros[level] + ones if one else at - ones
        return value

    def rank(self, value: int, at: int) -> int:
        """Occurrences of an id ahead of a position."""
        if not 0 <= value < 1 << self.bits:
            return 0
        start, stop = 0, at
        for level in range(self.bits):
            a, b = self.ones_before(level, start), self.ones_before(level, stop)
            if value >> (self.bits - 1 - level) & 1:
                start, stop = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, stop = start - a, stop - b
        return stop - start

    def count(self, value: int) -> int:
        return self.rank(value, self.size)

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of an id, or -1."""
        if not 0 <= k < self.count(value):
            return -1
        start = 0
        for level in range(self.bits):
            a = self.ones_before(level, start)
            start = self.zeros[level] + a if value >> (self.bits - 1 - level) & 1 else start - a
        at = start + k
        for level in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - level) & 1
            wanted = at - self.zeros[level] if one else at  # the wanted-th one, or zero, of the plane
            low, high = 0, self.size
            while low < high:
                middle = (low + high) // 2
                ones = self.ones_before(level, middle + 1)
                if (ones if one else middle + 1 - ones) > wanted:
                    high = middle
                else:
                    low = middle + 1
            at = low
        return at


#: Marks, without the apostrophe, that are a match of their own between a word and a blank or a new line.
MARKS = r"!-&(-/:-@\[-`{-~"
#: Latin letters in any version of Unicode; a word of them is one match of the library's splitter.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01ba"
PLAIN = re.compile(rf"(\n)?([{LATIN}]+|[{MARKS}]+)([{MARKS}]+)?")
#: The character that stands for each byte in a byte-level vocabulary.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)).difference(SHOWN)))}
BLANK = BYTE_CHARACTERS[32]


class Encoder:
    """Ids of texts by the tokenizers library, as little-endian integers of ``kind``: 16 bits if the vocabulary fits, else 32.

    A text that holds a token added to the vocabulary (such as an end mark) is encoded whole by the library, which cuts it there.
    Other texts go piece by piece. Most pieces are words of Latin letters, with a blank or a new line ahead of them and perhaps
    a mark behind them: their matches are known from their form, and go to the library's model at once.
    """

    def __init__(self, definition: str) -> None:
        self.tokenizer = Tokenizer.from_str(definition)
        size = max(self.tokenizer.get_vocab().values(), default=0)
        self.kind = np.dtype("<u2" if size < 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.table = str.maketrans({chr(b): c for b, c in BYTE_CHARACTERS.items()})
        self.model = self.tokenizer.model.tokenize
        self.line = self.whole("\n")
        self.marks = common.Remembered(self.word, 3, {})
        self.pieces = common.PieceEncoder(self.whole, self.piece, lambda piece: self.whole(" " + piece), lines=True, most=600_000)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.added is None or not any(map(self.added.search, texts)):
            return self.pieces.many(texts)
        return [self.whole(t) if self.added.search(t) else self.pieces(t) for t in texts]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def word(self, word: str, blank: str = "") -> bytes:
        """Ids of one match, given as the model takes it: a character for each byte."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.table)
        return array(self.code, [t.id for t in self.model(blank + shown)]).tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of a piece with its blank, or with the new line it begins with."""
        form = PLAIN.fullmatch(piece)
        if form is not None:
            line, word, mark = form.groups()
            ids = self.line + self.word(word) if line else self.word(word, BLANK)
            return ids + self.marks[mark] if mark else ids
        if piece[:1] == "\n" and common.surely_cut(piece[1:]):
            return self.whole(piece)
        if not common.surely_cut(piece):
            raise common.OddlyCut
        return self.whole(" " + piece)


#: Encoder of this worker process, by the definition's digest.
LOADED: dict[str, Encoder] = {}


def encoder(definition: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in LOADED:
        LOADED.clear()
        LOADED[key] = Encoder(definition)
    return LOADED[key]


def write(docs: DataFrame, definition_path: str, path: str, doc_id: str = "doc_id", text: str = "text", end: int = 0,
          shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode and write all documents, in ascending order of id, as rows of shards below ``path``."""
    with open(definition_path, encoding="utf-8") as file:
        definition = file.read()
    bits = max(1, Tokenizer.from_str(definition).get_vocab_size().bit_length(), end.bit_length())
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # of a vocabulary's size
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
    kind = rows.schema["doc_id"].dataType.simpleString()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        kind, width = own.kind, own.kind.itemsize
        last = np.array([end], kind).tobytes()
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        names: list = []
        ids: list[bytes] = []
        size = 0

        def shard_row() -> pa.RecordBatch:
            found = np.frombuffer(b"".join(ids), kind)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // width
            values = [[part], [shard], [before], [len(found)], [names], [lengths], [WaveletMatrix.build(found, bits).to_bytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.large_binary()]
            return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], list(SHARD))

        for piece in common.slices(batches, "text"):
            id_type = piece.schema.field("doc_id").type
            found = own.encode(common.texts(piece.column("text")))
            for name, encoded in zip(piece.column("doc_id").to_pylist(), found, strict=True):
                names.append(name)
                ids.append(encoded + last)
                size += len(ids[-1]) // width
                if size >= shard_tokens:
                    yield shard_row()
                    shard, before, names, ids, size = shard + 1, before + size, [], [], 0
        if ids:
            yield shard_row()

    SHARD = ("part", "shard", "before", "tokens", "doc_ids", "lengths", "matrix")
    types = ("int", "int", "long", "long", f"array<{kind}>", "array<long>", "binary")
    rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(SHARD, types, strict=True))).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of shards, with ``start``: ids of all documents before the shard's first."""
    shards = spark.read.parquet(path)
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("tokens"))  # one row a partition of the writer
    earlier = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = parts.select("part", earlier.alias("offset"))
    return shards.join(offset, "part").withColumn("start", F.col("offset") + F.col("before")).drop("offset")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, and its ids, from the files."""
    shards = read(spark, path).select("start", "doc_ids", "lengths", "matrix")
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    return shards.mapInArrow(decoded, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            start, names, lengths, matrix = (batch.column(c)[i] for c in ("start", "doc_ids", "lengths", "matrix"))
            ids = memoryview(WaveletMatrix.from_bytes(matrix.as_py()).values().astype("<u4")).cast("B")
            lengths = lengths.values.to_numpy()
            stops = np.cumsum(lengths)
            sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((stops - lengths).tolist(), stops.tolist(), strict=True)]
            columns = [names.values, pa.array(start.as_py() + stops - lengths), pa.array(lengths), pa.array(sums, pa.int64())]
            yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def tokens_of(shards: DataFrame, value: int) -> DataFrame:
    """Occurrences of an id in each shard, counted in the succinct form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [WaveletMatrix.from_bytes(m.as_py()).count(value) for m in batch.column("matrix")]
            yield pa.record_batch([batch.column("start"), pa.array(counts, pa.int64())], ["start", "occurrences"])

    return shards.select("start", "matrix").mapInArrow(run, "start long, occurrences long")
