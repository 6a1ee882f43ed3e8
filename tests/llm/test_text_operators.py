"""Encoding, personal data and token counts against the libraries and plain versions; edge rows of every operator."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scorelake.llm import bpe, common, pii, tokencount, wavelet

RANKS = P.path("byte_bpe_50k.tiktoken")
HARD = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "\n\na", "don't I'LL", "12 345,6", "é è 😀", "\x1c x", "a" * 700, "ab" * 400, " " * 300,
    "x" + "\t" * 50 + "y", "日本語 テキスト", "  a b",
]


def own_tokenizer():
    with open(RANKS, "rb") as file:
        return bpe.Tokenizer(bpe.ranks_of(file.read()), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return own_tokenizer()


def test_bpe_equals_the_library(own, library):
    rng = random.Random(4)
    texts = HARD + ["".join(rng.choice("abetho  \n\t.,'s12é😀") for _ in range(rng.randrange(80))) for _ in range(2000)]
    for text in texts:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


ONE = own_tokenizer()


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])))
def test_bpe_round_trip(text):
    assert ONE.decode(ONE.encode(text)) == text.encode()


def test_bpe_of_a_very_long_match_and_forgetting(own, library):
    rng = random.Random(5)
    piece = "".join(rng.choice("abcdef") for _ in range(60_000))
    assert own.merge(piece.encode()) == library.encode_ordinary(piece)
    assert all(b is None for b in own.bucket) and not any(own.leaf)
    small = common.PieceEncoder(own.ids, own.piece, own.encode.encode_odd, most=3)
    for text in HARD * 2 + ["a b c d e f g h"]:
        assert small(text) == own.encode(text)


def test_bpe_with_ranks_out_of_order():
    """A rank below that of its parts: the merge goes on there first, in every match on its own."""
    ranks = {bytes([c]): 300 + c for c in range(256)} | {b"bc": 20, b"abc": 5, b"ab": 30, b"cb": 40}
    own = bpe.Tokenizer(ranks, r"[\s\S]+")

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(6)
    for _ in range(500):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30)))
        assert own.merge(piece) == plain(piece)


def test_bpe_of_many_matches_in_one_queue(own, library):
    """As if each were alone: across matches no pair, also where a rank is below that of its parts."""
    rng = random.Random(7)
    pieces = ["".join(rng.choice("abetho,s12é😀\n") for _ in range(rng.randrange(1, 40))) for _ in range(3000)] + ["the", "a" * 300, "x"]
    got = own_tokenizer()
    assert dict(got.ahead(pieces)) == {p: own.ids(" " + p) for p in pieces if common.surely_cut(p)}
    assert all(b is None for b in got.bucket) and not any(got.leaf)
    assert np.frombuffer(got.encode(" ".join(pieces)), "<u4").tolist() == library.encode_ordinary(" ".join(pieces))
    odd = bpe.Tokenizer({bytes([c]): 300 + c for c in range(256)} | {b"bc": 20, b"abc": 5, b"ab": 30, b"cb": 40, b"\0a": 1}, r"[\s\S]+")
    words = [bytes(rng.choice(b"abc\0") for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    assert odd.merged_together(words) == [odd.merged_together([w])[0] for w in words]


ROWS = [(1, "a b"), (2, None), (3, ""), (3, ""), (4, "x" * 5000), (None, "né 1")]


def frame(spark, rows=ROWS, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def test_bpe_rows(spark, library):
    docs = frame(spark, ids="clash", n_tokens=7)
    got = list(map(tuple, bpe.digests(docs, RANKS, P.PATTERN).collect()))
    want = []
    for doc_id, text in ROWS:
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        want.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)
    back = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back.collect())
    assert bpe.digests(docs.limit(0), RANKS, P.PATTERN).count() == 0


FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for order, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")))
                or (kind == "card" and 14 <= len(digits) <= 19 and total % 10 == 0)
                or (kind == "phone" and 10 <= len(digits) <= 15)
            ):
                out.append((m.start(), order, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_personal_data_equals_plain_patterns():
    rng = random.Random(2)
    texts = ["".join(rng.choice("a.@-+ 0123456789(%é") for _ in range(rng.randrange(60))) for _ in range(20_000)]
    texts += ["".join(rng.choice("19.") for _ in range(40)) for _ in range(3000)]
    texts += ["4111 1111 1111 1111", "x@y.z@w.v", "+1 (212) 555-0100.", "000000255.1.1.1", "1.2.3.4.5.6.7.8.9", "a@b@c.d", "+1+12 34567890"]
    for text in texts:
        assert [s for s in pii.find(text) if s[0] in pii.BASE] == plain_spans(text), text


def test_added_kinds_and_redaction():
    text = "see https://joe:pw@host.example/x IBAN: GB82 WEST 1234 5698 7654 32, passport no: AB12345 mail a.b@c.de or account closed"
    kinds = {k: text[a:b] for k, a, b in pii.find(text)}
    assert kinds["login"] == "joe:pw" and kinds["account"] == "AB12345"
    assert ("account", text.index("GB82"), text.index("GB82") + 27) in pii.find(text)
    assert pii.redacted("mail a.b@c.de now +1 212 555 0100") == "mail [EMAIL] now [PHONE]"
    assert pii.redacted("nothing here: 12 apples at 5.30") == "nothing here: 12 apples at 5.30"
    assert pii.find("iban GB83 WEST 1234 5698 7654 32") == []  # wrong check digits


def test_personal_data_takes_linear_time():
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "a@" * 100_000, "+1" * 100_000, "://" * 70_000):
        pii.find(text)


def test_personal_data_rows(spark):
    rows = [(1, "a@b.cd +1 212 555 0100"), (2, None), (3, ""), (3, "10.0.0.1"), (None, "x")]
    got = {(r["doc_id"], r["spans"]): r for r in pii.report(frame(spark, rows, spans="clash")).collect()}
    assert got[(1, "email:0:6,phone:7:22")]["n_email"] == 1 and got[(3, "ip:0:8")]["n_ip"] == 1
    assert got[(2, "")]["base_sha256"] == hashlib.sha256(b"").hexdigest() and len(got) == 5
    cut = {r["doc_id"]: r for r in pii.redact(frame(spark, rows, n_chars=99), length="n_chars").where("doc_id < 3").collect()}
    assert cut[1]["text"] == "[EMAIL] [PHONE]" and cut[1]["n_chars"] == 15 and cut[2]["text"] is None and cut[2]["n_chars"] == 99
    assert pii.report(frame(spark, rows).limit(0)).count() == 0


def best_segmentation(word, vocab):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        if word[end - 1] not in vocab.scores:
            n = len(word[end - 1].encode())
            options.append((best[end - 1][0] + n * vocab.byte, -(best[end - 1][1] + n)))
        for start in range(end):
            if word[start:end] in vocab.scores:
                options.append((best[start][0] + vocab.scores[word[start:end]], -(best[start][1] + 1)))
        score, n = max(options)
        best.append((score, -n))
    return best[-1][1], best[-1][0]


def test_token_counts_equal_plain_search():
    rng = random.Random(3)
    pieces = sorted({"".join(rng.choice("abc▁") for _ in range(rng.randrange(1, 5))) for _ in range(60)})
    vocab = tokencount.ranked(pieces)
    words = ["▁" * rng.randrange(3) + "".join(rng.choice("abcdé") for _ in range(rng.randrange(12))) for _ in range(3000)]
    words = [w for w in words if w]
    found = tokencount.forward(words, vocab)
    for word in words:
        n, score = best_segmentation(word, vocab)
        assert found[word][0] == n and abs(found[word][1] - score) < 1e-9, word


def test_cuts_between_pretokens_lose_nothing():
    vocab = tokencount.vocabulary(P.path("piece_bpe_32k.model"))
    text = "The  quick\nbrown fox, n'est-ce pas?   ok 日本\n\n x"
    whole = best_segmentation(tokencount.MARK + text.replace(" ", tokencount.MARK), vocab)
    parts = tokencount.pretokens(text)
    assert "".join(parts) == tokencount.MARK + text.replace(" ", tokencount.MARK)
    found = tokencount.forward(parts, vocab)
    assert abs(sum(found[p][1] for p in parts) - whole[1]) < 1e-9
    assert sum(found[p][0] for p in parts) == whole[0]


def test_token_count_rows(spark):
    model = P.path("piece_bpe_32k.model")
    got = {(r["doc_id"], r["n_pretokens"]): r["n_tokens"] for r in tokencount.counts(frame(spark, score="clash"), model).collect()}
    assert got[(2, 0)] == got[(3, 0)] == 0 and got[(1, 2)] >= 2 and (None, 2) in got
    assert tokencount.counts(frame(spark).limit(0), model).count() == 0


def test_wavelet_matrix_access_rank_select():
    rng = np.random.default_rng(8)
    for n, bits in ((0, 16), (1, 1), (777, 5), (3000, 16), (1025, 20)):
        values = rng.integers(0, min(1 << bits, 40 if bits == 5 else 1 << bits), n)
        values[: n // 3] = values[:1].repeat(n // 3) if n else values[:0]
        matrix = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(values, bits).to_bytes())
        assert (matrix.values() == values).all() and matrix.size == n
        for i in rng.integers(0, max(1, n), 60).tolist() if n else []:
            v = int(values[i])
            assert matrix.access(i) == v and matrix.rank(v, i) == int((values[:i] == v).sum()) and matrix.count(v) == int((values == v).sum())
            assert matrix.select(v, matrix.rank(v, i)) == i
        assert matrix.select(0, matrix.count(0)) == -1 and matrix.count(1 << bits) == 0
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.from_bytes(b"nothing like it")


def test_wavelet_encoder_equals_the_library():
    own, library = wavelet.Encoder(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(12)
    hard = [*HARD, "x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b", "<|endoftext", "über, Straße. ça!", "don't we'll I'm, o'.", "a\nb", "a\n\nb", "a \nb", "a\n b", "\nA", "A\n", "x.\nY,", "\n1", "\n\u00a0z", "\u00a0\nz", "a\tb", "a\n\tb", "ĳ Ǆ ǅa ʼn", "ab.\n", "a,b", "word;", "ß:", "é?!", "..", ".", ""]
    texts = [rng.choice([" ", "  ", "", "\n"]).join(rng.choice(hard) for _ in range(rng.randrange(7))) for _ in range(3000)]
    kind = own.kind
    got = [x for at in range(0, len(texts), 70) for x in own.encode(texts[at : at + 70])]
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, kind).tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert np.frombuffer(own.encode(["x <|endoftext|> y"])[0], kind).tolist().count(50256) == 1


def test_wavelet_shards(spark, tmp_path):
    definition = P.path("byte_bpe_50k.json")
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(HARD) for _ in range(rng.randrange(9)))) for i in range(60)] + [(7, "again"), (None, "first"), (200, None), (201, "")]
    path = str(tmp_path / "w")
    wavelet.write(frame(spark, rows, start="clash").repartition(3), definition, path, end=0, shard_tokens=40)
    library = Tokenizer.from_file(definition)
    got = sorted(wavelet.read_documents(spark, path).collect(), key=lambda r: r["start"])
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, []).append(text)
    place, seen = 0, []
    for r in got:
        ids = {tuple([*library.encode(t or "", add_special_tokens=False).ids, 0]): t for t in texts[r["doc_id"]]}
        sums = {zlib.crc32(np.array(x, "<u4").tobytes()): len(x) for x in ids}
        assert r["start"] == place and sums[r["ids_crc32"]] == r["n_tokens"]
        place += r["n_tokens"]
        seen.append(r["doc_id"])
    assert seen == sorted(seen, key=lambda x: (x is not None, x)) and len(seen) == len(rows)
    assert wavelet.tokens_of(wavelet.read(spark, path), 0).agg(F.sum("occurrences")).first()[0] >= len(rows)
    empty = str(tmp_path / "e")
    wavelet.write(frame(spark, rows).limit(0), definition, empty)
    assert wavelet.read_documents(spark, empty).count() == 0
