"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in the whole text: at-signs, plus signs, digits, "://" of schemes and cues such as
"iban" or "passport". From each anchor a local parser expands to both sides and validates:

    email    [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip       four numbers with dots between, none over 255
    card     14 to 19 digits with single blanks or hyphens between, passing Luhn
    phone    + and 10 to 15 digits, with blanks, dots, brackets and hyphens between
    login    name (and password) before the host of a URL: scheme://name:password@host
    account  what a cue names: an IBAN with right check digits, or after "passport", "ssn" and the like, "no", "number" or
             "id" and a colon, hash or equals sign, a number of 6 to 20 letters and digits with 4 digits at least

The first four are the base kinds. Their spans are the leftmost non-overlapping matches of a kind; a match that fails its
check is dropped and not tried again at another place. The other two are added to them and never change them.

No parser looks at a character more than a fixed number of times. Spans count code points, the end is exclusive.

Defined results: null counts as the empty text and has no spans. Spans of different kinds may overlap; ``redact`` then
replaces their union by the label of the kind that comes first. Repeated rows are treated alike; other columns are kept by
``redact`` and not read by ``report``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "account")
ORDER = {k: i for i, k in enumerate(KINDS)}
#: Found in lower case, capitalized and in upper case.
CUES = ("iban", "passport", "passeport", "reisepass", "pasaporte", "ssn", "social security", "tax id", "account", "kontonummer", "cuenta")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"[0-9]+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
SPACED = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"[0-9][ ().0-9-]*")
USER = re.compile(r"[^\s/?#@]+@")
IBAN = re.compile(r"[\s:#=.]{0,4}(?:(?:no|nr|number)\b[\s:#=.]{1,4})?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
NAMED = re.compile(r"[ \t]*(?:(?:no|nr|number|id)\b\.?[ \t]*)?[:#=][ \t]*([A-Za-z0-9][A-Za-z0-9-]{4,18}[A-Za-z0-9])(?![A-Za-z0-9])", re.IGNORECASE)


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor in ("@", "+", "://", *"0123456789", *CUES):
        for spelled in (anchor, anchor.capitalize(), anchor.upper()):
            found.add_word(spelled, anchor)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start, then by the order of the kinds."""
    spans: list[tuple[str, int, int]] = []
    email_end = ip_end = card_end = phone_end = run_end = 0
    for last, anchor in automaton().iter(text):
        if anchor.isdigit():
            if last >= card_end and (m := SPACED.match(text, last)):
                card_end = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", last, card_end))
            if last >= ip_end and last >= run_end:
                if m := DOTTED.match(text, last):
                    ip_end = m.end()
                    if all(map(small, m.group().split("."))):
                        spans.append(("ip", last, ip_end))
                else:
                    run_end = NUMBER.match(text, last).end()  # no place in this number begins four
        elif anchor == "@":
            start = last
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := DOMAIN.match(text, last + 1)):
                email_end = m.end()
                spans.append(("email", start, email_end))
        elif anchor == "+":
            if last >= phone_end and (m := PHONE.match(text, last + 1)):
                run = m.group().rstrip(" ().-")
                if len(run) >= 3:
                    phone_end = last + 1 + len(run)
                    if 10 <= sum(map(str.isdigit, run)) <= 15:
                        spans.append(("phone", last, phone_end))
        elif anchor == "://":
            if m := USER.match(text, last + 1):
                spans.append(("login", last + 1, m.end() - 1))
        elif last + 1 < len(text) and (last < len(anchor) or not text[last - len(anchor)].isalnum()):
            if anchor == "iban":
                if (m := IBAN.match(text, last + 1)) and iban(m[1]):
                    spans.append(("account", m.start(1), m.end(1)))
            elif (m := NAMED.match(text, last + 1)) and sum(map(str.isdigit, m[1])) >= 4:
                spans.append(("account", m.start(1), m.end(1)))
    spans.sort(key=lambda s: (s[1], ORDER[s[0]]))
    return spans


def render(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans of each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.slices(batches, "text"):
            found = [find(x) for x in common.texts(piece.column("text"))]
            base = [[s for s in spans if s[0] in BASE] for spans in found]
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE]
            digest = [hashlib.sha256(render(spans).encode()).hexdigest() for spans in base]
            yield pa.record_batch(
                [piece.column("doc_id"), *counts, pa.array(digest, pa.string()), pa.array(map(render, found), pa.string())],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string")


def redacted(text: str) -> str:
    """``text`` with a label such as [EMAIL] in the place of each span."""
    out, done = [], 0
    spans = find(text)
    i = 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += text[done:start], f"[{kind.upper()}]"
        done = end
    return "".join([*out, text[done:]]) if out else text


def redact(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with labels in place of personal data in column ``text``; ``length``, if given, is set anew to its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.slices(batches, text):
            new = pa.array([x if x is None else redacted(x) for x in piece.column(text).to_pylist()], piece.schema.field(text).type)
            columns = [new if name == text else piece.column(name) for name in piece.schema.names]
            yield pa.record_batch(columns, piece.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if length is None:
        return out
    return out.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(F.char_length(text)).cast(docs.schema[length].dataType))
