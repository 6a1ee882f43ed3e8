"""Byte-level BPE, encoding by a hierarchical-bitmap rank queue, and decoding.

The text is split by the tokenizer's pattern; each match is merged on its own. Its bytes form a linked list. Every
neighbouring pair whose concatenation has a rank lies in the bucket of that rank, by position. A bitmap of two levels
marks the buckets in use; find-first-set on it gives the lowest rank, whose bucket hands out its leftmost position.
Entries of pairs that are gone are skipped. Each merge costs two bucket entries, so a match of a million bytes takes time
in proportion to its length (times the logarithm of a bucket) where a scan for the best pair would take its square.

The new matches of some pieces are merged in one queue, by the same order of ranks and then positions; no pair lies across two of them, so
each comes out as if it were alone, and the work on a bucket and on the bitmap is shared.

Texts are cut ahead of the pattern at blanks with no white space behind them: a match always begins there, so
the pieces are encoded as within the text. Pieces and matches recur, so a worker remembers a bounded number of them.

Defined results: null counts as the empty text, which has no ids. Texts of any length are encoded whole; bytes are UTF-8, so
decoding gives back exactly the text. Ids without a token raise an error in decoding.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm import common

REMEMBERED = 800_000
LONG = 64
BIT = [1 << i for i in range(4096)]  # ranks up to a million
#: Pieces whose matches are merged together. More would only make the lists of a queue too large for a processor's near memory.
TOGETHER = 1000
#: Marks of what is no symbol: a place between two matches; a byte without a token.
GAP, ABSENT = -2, -3

#: Tokenizers of this worker process, by name of the file and pattern.
LOADED: dict[tuple[str, str], Tokenizer] = {}


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        size = max(ranks.values(), default=-1) + 1
        self.tokens: list[bytes | None] = [None] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        # the rank queue; it is empty between two matches
        self.bucket: list[list[int] | None] = [None] * size
        self.leaf = [0] * (size // 256 + 1)
        self.of_byte = np.array([ranks.get(bytes([b]), ABSENT) for b in range(256)], np.int32)
        self.of_bytes = np.full(1 << 16, -1, np.int32)  # rank of two bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.of_bytes[token[0] << 8 | token[1]] = rank
        self.merged: dict[bytes, bytes] = {}
        self.encode = common.PieceEncoder(self.ids, self.piece, lambda piece: self.ids(" " + piece), ahead=self.ahead)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        return np.frombuffer(next(self.whole([piece]))[1], "<u4").tolist()

    def merged_together(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of matches of the pattern, as little-endian 32-bit integers. They share the queue and no pair, so each is merged as if alone.

        A pair that a merge makes holds more bytes than its bucket's token. If its rank is lower, the queue is asked again.
        """
        get, bucket, leaf = self.ranks.get, self.bucket, self.leaf
        text = b"\0".join([b"", *pieces, b""])  # a gap before and behind every match
        data = np.frombuffer(text, np.uint8)
        n = len(data)
        gaps = np.append(0, np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1))
        ids = self.of_byte[data]
        pair = np.append(self.of_bytes[data[:-1].astype(np.int32) << 8 | data[1:]], np.int32(-1))  # rank of a symbol with the next, or -1
        ids[gaps], pair[gaps], pair[gaps[1:] - 1] = GAP, GAP, -1
        pair[gaps] = GAP
        order = np.argsort(pair, kind="stable")
        ranked = pair[order]
        cuts = np.append(np.flatnonzero((ranked >= 0) & (np.diff(ranked, prepend=GAP) > 0)), n).tolist()
        places, ids, pair = order.tolist(), ids.tolist(), pair.tolist()
        top = 0  # bit h: leaf h has a bit; bit l of leaf h: bucket 256 h + l has entries
        for a, b in zip(cuts, cuts[1:], strict=False):
            rank = pair[places[a]]
            bucket[rank] = places[a:b]  # ascending, so a heap
            leaf[rank >> 8] |= BIT[rank & 255]
            top |= BIT[rank >> 8]
        after = list(range(1, n + 1))  # start of the next symbol
        before = list(range(-1, n))
        while top:
            high = (top & -top).bit_length() - 1
            bits = leaf[high]
            low = bits & -bits
            rank = lowest = high << 8 | low.bit_length() - 1
            entries = bucket[rank]
            while entries and lowest == rank:
                i = heappop(entries)
                if pair[i] != rank:
                    continue  # stale
                j = after[i]
                k = after[i] = after[j]
                before[k] = i
                ids[i] = rank
                ids[j] = pair[j] = pair[i] = -1
                if ids[k] != GAP:
                    new = get(text[i : after[k]], -1)
                    if new >= 0:
                        pair[i] = new
                        if bucket[new]:
                            heappush(bucket[new], i)
                        else:
                            bucket[new] = [i]
                            leaf[new >> 8] |= BIT[new & 255]
                            top |= BIT[new >> 8]
                        if new < lowest:
                            lowest = new
                left = before[i]
                if ids[left] != GAP:
                    new = pair[left] = get(text[left:k], -1)
                    if new >= 0:
                        if bucket[new]:
                            heappush(bucket[new], left)
                        else:
                            bucket[new] = [left]
                            leaf[new >> 8] |= BIT[new & 255]
                            top |= BIT[new >> 8]
                        if new < lowest:
                            lowest = new
            if not entries:
                bucket[rank] = None
                leaf[high] ^= low
                if not leaf[high]:
                    top ^= BIT[high]
        found = np.array(ids, np.int32)
        if (found == ABSENT).any():
            raise KeyError("a byte without a token")
        kept = found >= 0
        flat = found[kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept)[gaps] * 4).tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def ahead(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Pieces with the ids of each, its blank included. Their new matches are merged many at a time; pieces that ``piece`` refuses are left out.

        No piece holds a blank, and a match begins at each blank that is put between them.
        """
        pieces = list(filter(common.surely_cut, pieces))
        for at in range(0, len(pieces), TOGETHER):
            own = pieces[at : at + TOGETHER]
            found = self.split(" " + " ".join(own))
            matches = list(map(str.encode, found))
            if len(self.merged) + len(matches) > REMEMBERED:
                self.merged.clear()
            self.merged.update(self.whole([m for m in set(matches) if m not in self.merged]))
            ids = list(map(self.merged.__getitem__, matches))
            if len(own) < len(ids):
                starts = [k for k, match in enumerate(found) if match[0] == " "]
                ids = [b"".join(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
            yield from zip(own, ids, strict=True)

    def whole(self, matches: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Matches with their ids: those of matches that are a token, and of the others by merging."""
        ranks = [self.ranks.get(m) for m in matches]
        merged = iter(self.merged_together([m for m, r in zip(matches, ranks, strict=True) if r is None]))
        return ((m, next(merged) if r is None else pack("<I", r)) for m, r in zip(matches, ranks, strict=True))

    def joined(self, matches: list[bytes]) -> bytes:
        """Ids of matches one after the other. Matches recur; a bounded number is remembered."""
        merged, found = self.merged, []
        for match in matches:
            ids = merged.get(match)
            if ids is None:
                ids = next(self.whole([match]))[1]
                if len(match) <= LONG:
                    if len(merged) >= REMEMBERED:
                        merged.clear()
                    merged[match] = ids
            found.append(ids)
        return found[0] if len(found) == 1 else b"".join(found)

    def piece(self, piece: str) -> bytes:
        """Ids of a piece with its blank."""
        if not common.surely_cut(piece):
            raise common.OddlyCut
        return self.ids(" " + piece)

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers, match by match."""
        return self.joined(list(map(str.encode, self.split(text))))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def ranks_of(lines: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: base64 and a number a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


def shared_tokenizer(spark: SparkSession, path: str, pattern: str) -> Callable[[], Tokenizer]:
    """A function that gives the tokenizer inside a task. The file, of a vocabulary's size, is read once, and sent."""
    with open(path, "rb") as file:
        lines = spark.sparkContext.broadcast(file.read())

    def get() -> Tokenizer:
        key = (hashlib.sha256(lines.value).hexdigest(), pattern)
        if key not in LOADED:
            LOADED.clear()
            LOADED[key] = Tokenizer(ranks_of(lines.value), pattern)
        return LOADED[key]

    return get


def with_column(df: DataFrame, name: str) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a binary column of ids as little-endian unsigned 32-bit integers; a column of that name is replaced."""
    docs = docs.drop(ids)
    tokenizer = shared_tokenizer(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer()
        for piece in common.slices(batches, text):
            found = pa.array(own.encode.many(common.texts(piece.column(text))), pa.binary())
            yield pa.record_batch([*piece.columns, found], [*piece.schema.names, ids])

    return docs.mapInArrow(run, with_column(docs, ids))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with a binary column of the bytes of its ids; null ids stay null."""
    encoded = encoded.drop(decoded)
    tokenizer = shared_tokenizer(encoded.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer()
        for piece in common.slices(batches, ids):
            found = pa.array([x if x is None else own.decode(x) for x in piece.column(ids).to_pylist()], pa.binary())
            yield pa.record_batch([*piece.columns, found], [*piece.schema.names, decoded])

    return encoded.mapInArrow(run, with_column(encoded, decoded))


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Number and digest of the ids of each row, the digest of the bytes that decoding them gives, and the ids if asked for.

    Both ways in one pass, so that a task holds one tokenizer.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    tokenizer = shared_tokenizer(docs.sparkSession, path, pattern)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer()
        for piece in common.slices(batches, "text"):
            ids = own.encode.many(common.texts(piece.column("text")))
            back = [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]
            columns = [
                piece.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(back, pa.string()),
            ]
            yield pa.record_batch([*columns, *[pa.array(ids, pa.binary())] * with_ids], names)

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema + ", ids binary" * with_ids)
