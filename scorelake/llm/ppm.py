"""Language-model scores by prediction with partial matching (PPM), trained on a part of the corpus.

The model is a trie of byte contexts of up to ``ORDER`` bytes. Level k holds the strings of k + 1 bytes met in training (k bytes of
context and the byte after them) with their counts; a text is coded byte by byte, with an end mark after it. A byte that the
longest context has seen is coded there; otherwise an escape goes to the context one byte shorter. Escapes are estimated by method
D (half a count for each distinct byte that the context has seen, taken off that byte's own count), and bytes that the longer context offers are excluded from the
shorter one. Below order 0 the bytes left over are equally likely. A context never met is passed without an escape.

Every position of a text depends on its last ORDER + 1 bytes only, so a text's log probability is a sum over its grams of ORDER + 1
bytes. The work is laid out so that neither the trie nor the vocabulary has to fit in one place:

1. Rows are dealt into blocks of a bounded size. A block gives its distinct grams and words, with their counts in training rows.
2. Grams are summed over blocks. A gram's code length needs counts of contexts that share its last two context bytes, so
   the trie's upper levels are dealt by those two bytes; what lies below order 2 is one table of 65,536 pair counts.
3. Words get their training counts (the base score's) by a window over word.
4. Both come back to the blocks that asked, and a block scores its texts from its own small dictionary.

The words of the base score are runs of bytes other than 0x20 and 0x09 to 0x0D, A-Z lower-cased, then one end mark, which counts as
a word; each counts (c + 1) / (N + V + 1) with its training count c, all training words N and distinct ones V.

``adaptive_bits`` gives the code length of texts by a model that starts empty for each text and learns as it goes.

Defined results: null counts as the empty text, which is its end mark. Rows without an id are scored and not learned from. Repeated
rows are each learned from, and scored alike. With nothing to learn from, every byte has a chance of 1 in 256. Other columns aren't
read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm import common

ORDER = 5
BLOCK_BYTES = 24 << 20
LEAST_BLOCKS = 16
GRAM_SLICE = 1 << 20  # bytes of text whose grams, of eight bytes each, are in memory at once
#: Bytes that no UTF-8 text holds: ahead of a text, and its end.
AHEAD, END = 0xFE, 0xFF
ALPHABET = 256

WORD_BYTES = bytes(32 if 9 <= c <= 13 else b for c, b in enumerate(common.ASCII_LOWER))


def framed(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, lower-cased, each with its marks; where the codes of each begin and end in ``grams``."""
    ahead, end = bytes([AHEAD]) * ORDER, bytes([END])
    data = np.frombuffer(b"".join([part for v in values for part in (ahead, v.translate(common.ASCII_LOWER), end)]), np.uint8)
    size = np.fromiter(map(len, values), np.int64, len(values)) + 1
    ends = np.cumsum(size + ORDER) - ORDER
    return data, ends - size, ends


def grams(data: np.ndarray) -> np.ndarray:
    """The ORDER + 1 bytes that end at each byte from the ORDER-th, as one number; those that end in a mark ahead of a text are void."""
    n = max(0, len(data) - ORDER)
    code = np.zeros(n, np.int64)
    for j in range(ORDER + 1):
        code <<= 8
        code |= data[j : j + n]
    return code


def counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and how often each occurs."""
    code = np.sort(code)
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
    return code[first], np.diff(np.append(first, len(code)))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by number."""
    code, n = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
    return (code[first], np.add.reduceat(n, first)) if len(code) else (code, n)


# --- the trie -----------------------------------------------------------------------------------------------------


def pair_table(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Bytes of all texts, and how often each byte follows each in training rows (a table of 256 x 256), in one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, table = 0, np.zeros(1 << 16, np.int64)
        for piece in common.slices(batches, "text"):
            learn = piece.column("learn").to_pylist()
            values = common.text_bytes(piece.column("text"))
            total += sum(map(len, values))
            data, _, _ = framed([v for v, used in zip(values, learn, strict=True) if used])
            pair = data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]
            table += np.bincount(pair[data[1:] != AHEAD], minlength=1 << 16)
        seen = np.flatnonzero(table)
        yield pa.record_batch([pa.array(np.append(seen, -1)), pa.array(np.append(table[seen], total))], ["pair", "n"])

    found = rows.select("text", "learn").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pair, n = found["pair"].to_numpy(), found["n"].to_numpy()
    table = np.zeros(1 << 16, np.int64)
    table[pair[pair >= 0]] = n[pair >= 0]
    return int(n[pair < 0].sum()), table


def log_chances(code: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of the chance of the last byte of each gram after the bytes ahead of it.

    ``code`` holds, sorted, all grams whose last two context bytes are among theirs, ``n`` their training counts (0 for grams to be
    scored that training didn't meet), ``pairs`` the table of order 1.
    """
    chance = np.ones(len(code))
    open_ = np.ones(len(code), bool)  # not coded yet
    # what the context one byte longer offers: how many bytes, and their counts in the present context
    offered = np.zeros(len(code), np.int64)
    offered_in: np.ndarray = np.zeros(len(code), np.int64)
    for k in range(ORDER, -1, -1):
        key = code & (1 << 8 * (k + 1)) - 1
        if k >= 2:
            nodes, counts = merged([(key[n > 0], n[n > 0])])
        else:
            nodes, counts = np.flatnonzero(pairs), pairs[pairs > 0]
            if k == 0:
                nodes, counts = merged([(nodes & 255, counts)])
        contexts, spans = np.unique(nodes >> 8, return_index=True)
        total = np.add.reduceat(counts, spans) if len(nodes) else np.zeros(0, np.int64)
        distinct = np.diff(np.append(spans, len(nodes)))
        at = np.searchsorted(nodes, key)
        own = np.where(at < len(nodes), counts[np.minimum(at, len(nodes) - 1)] * (nodes[np.minimum(at, len(nodes) - 1)] == key), 0) if len(nodes) else 0 * n
        c = np.searchsorted(contexts, key >> 8)
        there = (c < len(contexts)) & (contexts[np.minimum(c, len(contexts) - 1)] == key >> 8) if len(contexts) else np.zeros(len(code), bool)
        c = np.minimum(c, max(0, len(contexts) - 1))
        sum_, kinds = (np.where(there, total[c], 0), np.where(there, distinct[c], 0)) if len(contexts) else (0 * n, 0 * n)
        left, new = sum_ - offered_in, kinds - offered
        hit = open_ & (own > 0)
        chance[hit] *= (own[hit] - 0.5) / left[hit]
        open_ &= ~hit
        miss = open_ & (new > 0)
        chance[miss] *= 0.5 * new[miss] / left[miss]
        offered = kinds
        if k:
            # counts, one level down, of the bytes that each context offers
            below = nodes & (1 << 8 * k) - 1
            if k - 1 >= 2:
                lower, lower_counts = merged([(code[n > 0] & (1 << 8 * k) - 1, n[n > 0])])
                inner = lower_counts[np.searchsorted(lower, below)] if len(lower) else np.zeros(0, np.int64)
            elif k == 2:
                inner = pairs[below]
            else:
                inner = np.bincount(np.arange(1 << 16) & 255, weights=pairs, minlength=256).astype(np.int64)[below]
            in_context = np.add.reduceat(inner, spans) if len(nodes) else np.zeros(0, np.int64)
            offered_in = np.where(there, in_context[c], 0) if len(contexts) else 0 * n
    left = ALPHABET - offered
    chance[open_] /= np.maximum(left, 1)[open_]
    return np.log10(chance)


# --- blocks -------------------------------------------------------------------------------------------------------


def block_words(block: pa.Table) -> pa.Table:
    """Distinct words of a block with their counts in training rows; the end mark is the empty word."""
    counts: Counter[bytes] = Counter()
    for piece in common.slices(block.select(["text", "learn"]).to_batches(), "text"):
        for text, learn in zip(common.text_bytes(piece.column("text")), piece.column("learn").to_pylist(), strict=True):
            words = text.translate(WORD_BYTES).split()
            words.append(b"")
            if learn:
                counts.update(words)
            else:
                for word in words:
                    if word not in counts:
                        counts[word] = 0
    key = pa.array(np.full(len(counts), block.column("block")[0].as_py()), pa.int64())
    return pa.table([key, pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["block", "word", "n"])


def block_grams(block: pa.Table) -> pa.Table:
    """Distinct grams of a block with their counts in training rows."""
    parts: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for piece in common.slices(block.select(["text", "learn"]).to_batches(), "text", GRAM_SLICE):
        learn = piece.column("learn").to_pylist()
        values = common.text_bytes(piece.column("text"))
        for used in (True, False):
            code = grams(framed([v for v, x in zip(values, learn, strict=True) if x == used])[0])
            found, n = counted(code[code & 255 != AHEAD])
            parts.append((found, n if used else 0 * n))
    code, n = merged(parts)
    key = pa.array(np.full(len(code), block.column("block")[0].as_py()), pa.int64())
    return pa.table([key, pa.array(code), pa.array(n)], ["block", "gram", "n"])


def block_scores(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Of each row of a block: words, known words, sum of log10(c + 1), and the sum of log10 chances of its grams."""
    is_word = answers.column("gram").is_null().to_numpy()
    words = answers.column("word").filter(pa.array(is_word)).to_pylist()
    value = dict(zip(words, np.log10(1.0 + answers.column("n").to_numpy()[is_word]).tolist(), strict=True))
    code = answers.column("gram").filter(pa.array(~is_word)).to_numpy()
    order = np.argsort(code)
    code, chance = code[order], answers.column("chance").to_numpy()[~is_word][order].astype(float)
    out = []
    del answers, words, order, is_word
    for piece in common.slices(docs.to_batches(), "text", GRAM_SLICE):
        values = common.text_bytes(piece.column("text"))
        data, starts, ends = framed(values)
        own = np.minimum(np.searchsorted(code, grams(data)), len(code) - 1)
        scores = common.segment_sums(chance[own], starts, ends)
        del own, data
        found = [np.fromiter(map(value.__getitem__, [*v.translate(WORD_BYTES).split(), b""]), float) for v in values]
        columns = [
            piece.column("doc_id"), piece.column("learn"),
            pa.array([len(x) for x in found], pa.int64()), pa.array([int(np.count_nonzero(x)) for x in found], pa.int64()),
            pa.array([float(x.sum()) for x in found], pa.float64()), pa.array(scores),
        ]
        out.append(pa.record_batch(columns, ["doc_id", "learn", "n_tokens", "n_known", "logs", "score"]))
    return pa.Table.from_batches(out)


def scores(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score and score of every row; the model learns from rows where ``learn``."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
        (F.coalesce(learn, F.lit(False)) & F.col(doc_id).isNotNull()).alias("learn"),
    )
    size, table = pair_table(rows)
    count = max(LEAST_BLOCKS, -(-size // block_bytes))
    pairs = docs.sparkSession.sparkContext.broadcast(table)  # 65,536 numbers
    # a row's place in the scan, not its id or text, decides on its block: repeated rows spread
    blocks = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)))
    by_block = blocks.groupBy("block")

    words = by_block.applyInArrow(block_words, "block long, word binary, n long")
    same = Window.partitionBy("word")
    words = words.select("block", "word", "n", F.sum("n").over(same).alias("c"), F.row_number().over(same.orderBy("block")).alias("nth"))

    # both uses below take the same rows and columns, so that Spark shuffles the grams once
    asked = by_block.applyInArrow(block_grams, "block long, gram long, n long").where(F.col("gram").isNotNull()).repartition("gram")
    trie = asked.groupBy("gram").agg(F.sum("n").alias("n"), F.count("block").alias("blocks"))
    trie = trie.repartition(F.shiftright("gram", 8).bitwiseAND(0xFFFF))

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(b.column("gram").to_numpy(), b.column("n").to_numpy()) for b in batches]
        if own:
            code, n = merged(own)
            chance = log_chances(code, n, pairs.value).astype(np.float32)
            yield pa.record_batch([pa.array(code), pa.array(chance)], ["gram", "chance"])

    priced = asked.join(trie.mapInArrow(price, "gram long, chance float"), "gram")
    none = lambda kind: F.lit(None).cast(kind)
    answers = words.select("block", "word", none("long").alias("gram"), F.col("c").alias("n"), none("float").alias("chance")).unionByName(
        priced.select("block", none("binary").alias("word"), "gram", "n", "chance")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = by_block.cogroup(answers.groupBy("block")).applyInArrow(
        block_scores, f"doc_id {kind}, learn boolean, n_tokens long, n_known long, logs double, score double"
    )
    seen = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("N"),
        F.coalesce(F.sum(((F.col("nth") == 1) & (F.col("c") > 0)).cast("long")), F.lit(0)).alias("V"),
    ).select(F.struct("N", "V"))
    return (
        found.withColumn("seen", seen.scalar())
        .withColumn("base_score", F.col("logs") - F.col("n_tokens") * F.log10(F.col("seen.N") + F.col("seen.V") + F.lit(1.0)))
        .select("doc_id", "learn", "n_tokens", "n_known", F.col("seen.N").alias("train_tokens"), "base_score", "score")
    )


# --- learning while coding ----------------------------------------------------------------------------------------


def adaptive_text_bits(text: bytes, order: int = ORDER) -> float:
    """Code length of a text, with its end mark, by a model that starts empty and counts each symbol after coding it."""
    trie: dict[bytes, Counter[int]] = {}
    bits, past = 0.0, b""
    for symbol in [*text, END]:
        excluded: set[int] = set()
        coded = False
        for k in range(min(order, len(past)), -1, -1):
            node = trie.get(past[len(past) - k :])
            if not node:
                continue
            fresh = {s: n for s, n in node.items() if s not in excluded}
            total = sum(fresh.values())
            if symbol in fresh:
                bits -= math.log2((fresh[symbol] - 0.5) / total)
                coded = True
                break
            if fresh:
                bits -= math.log2(0.5 * len(fresh) / total)
            excluded |= node.keys()
        if not coded:
            bits += math.log2(ALPHABET - len(excluded))
        for k in range(min(order, len(past)) + 1):
            trie.setdefault(past[len(past) - k :], Counter())[symbol] += 1
        past = (past + bytes([symbol]))[-order:] if order else b""
    return bits


def adaptive_bits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, n_bytes and bits (adaptive code length) of every row; a row's work grows with its own length only."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.slices(batches, "text"):
            values = common.text_bytes(piece.column("text"))
            bits = [adaptive_text_bits(v, order) for v in values]
            yield pa.record_batch([piece.column("doc_id"), pa.array(list(map(len, values)), pa.int64()), pa.array(bits, pa.float64())], ["doc_id", "n_bytes", "bits"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, bits double")
