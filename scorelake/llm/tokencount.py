"""Unigram token counts by dynamic programming over a trie of pre-tokens.

Blanks become the word mark, one is put ahead of the text, and the text is cut into pre-tokens ahead of the marks of each
word: pieces of the vocabulary hold marks at their front only, so no token reaches across a cut. The distinct pre-tokens of a
slice go into a trie in sorted order; the best score of every prefix (the forward score) is computed once per trie node, however
many pre-tokens share it, and a pre-token's token count is stored at its terminal node. A text's count is the sum over its
pre-tokens.

The score of a piece is the logarithm of its chance under Zipf's law over the vocabulary's order, as rank files and merge
vocabularies are in order of use; nothing is trained. A character that no piece spells costs one token for each UTF-8
byte, each at the score of a byte piece. Among segmentations of the best score the one of fewest tokens counts.

Defined results: null and empty texts have no tokens and score 0. Texts of any length are counted whole. Repeated rows are
counted each; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from scorelake.llm import common

MARK = "▁"
#: A run of marks with what follows up to the next mark or line end, or a line end.
PRETOKEN = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


@dataclass(frozen=True)
class Vocabulary:
    scores: dict[str, float]
    byte: float  # score of one byte of a character that no piece spells
    longest: int


def vocabulary(model: str) -> Vocabulary:
    """Pieces of a SentencePiece model in order of their ids, without control and byte pieces."""
    own = SentencePieceProcessor(model_file=model)
    normal = [i for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))]
    return ranked([own.id_to_piece(i) for i in normal])


def ranked(pieces: list[str]) -> Vocabulary:
    """Scores by Zipf's law for pieces in order of use; pieces with a mark behind another character are left out."""
    norm = math.log(sum(1 / r for r in range(1, len(pieces) + 258)))
    scores: dict[str, float] = {}
    for r, piece in enumerate(pieces, 1):
        if "\n" not in piece and MARK not in piece.lstrip(MARK):
            scores.setdefault(piece, -math.log(r) - norm)
    return Vocabulary(scores, -math.log(len(pieces) + 257) - norm, max(map(len, scores), default=1))


def pretokens(text: str) -> list[str]:
    return PRETOKEN.findall(MARK + text.replace(" ", MARK)) if text else []


def forward(words: list[str], vocab: Vocabulary) -> dict[str, tuple[int, float]]:
    """Token count and best score of each distinct pre-token.

    ``words`` is walked in sorted order, that is, depth-first through their trie: the scores up to the prefix shared with
    the word before are those of its trie nodes and are kept; only new nodes are computed.
    """
    get, longest = vocab.scores.get, vocab.longest
    best, tokens = [0.0], [0]
    before = ""
    out = {}
    for word in sorted(set(words)):
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del best[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            bytes_ = len(word[end - 1].encode())
            top, count = best[end - 1] + bytes_ * vocab.byte, tokens[end - 1] + bytes_
            if get(word[end - 1]) is not None:
                top = -math.inf
            for start in range(max(0, end - longest), end):
                score = get(word[start:end])
                if score is not None:
                    total = best[start] + score
                    if total > top or total == top and tokens[start] + 1 < count:
                        top, count = total, tokens[start] + 1
            best.append(top)
            tokens.append(count)
        out[word] = tokens[-1], best[-1]
        before = word
    return out


#: Counts by pre-token of this worker process, for one vocabulary; emptied at REMEMBERED entries.
KNOWN: dict[str, tuple[int, float]] = {}
OWNER: list[int] = [0]
REMEMBERED = 300_000
#: Longer pre-tokens are forgotten with their slice of text.
LONGEST = 64


def counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens and score (the sum of the best scores) of every row, in one scan."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    vocab = vocabulary(model)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # of a vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        if OWNER[0] != hash(frozenset(own.scores.items())):
            KNOWN.clear()
            OWNER[0] = hash(frozenset(own.scores.items()))
        for piece in common.slices(batches, "text"):
            split = [pretokens(x) for x in common.texts(piece.column("text"))]
            new = {w for words in split for w in words if w not in KNOWN}
            fresh = forward(list(new), own)
            if len(KNOWN) + len(fresh) > REMEMBERED:
                fresh |= {w: KNOWN[w] for words in split for w in words if w in KNOWN}
                KNOWN.clear()
            KNOWN.update(fresh)
            found = [[KNOWN[w] for w in words] for words in split]
            for w in [w for w in fresh if len(w) > LONGEST]:
                del KNOWN[w]
            columns = [
                piece.column("doc_id"),
                pa.array([len(words) for words in split], pa.int64()),
                pa.array([sum(n for n, _ in f) for f in found], pa.int64()),
                pa.array([math.fsum(s for _, s in f) for f in found], pa.float64()),
            ]
            yield pa.record_batch(columns, ["doc_id", "n_pretokens", "n_tokens", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long, score double")
