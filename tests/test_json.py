"""The JSON rule against Python's reader, on valid texts and on texts with a character put in, taken out or changed."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from scorelake.functions.json_values import elements, json_value, spelled
from scorelake.operators import judge, replies

STRINGS = ["a", "NaN, b", 'x"y', "é", "[1]", "end of value", "\\", "a: -Infinity]", "'", "", "number NaN"]
NUMBERS = ["0", "-1", "1.50", "1e3", "-0.0", "12345678901", "1E-2", "NaN", "Infinity", "-Infinity"]
JUNK = ['"', "'", ",", "]", "[", "}", "{", ":", "N", "NaN", "-", "0", "1", " ", "\\", "x", "\x01", '"end of value"', "﻿", "\n", "+", ".", "#"]
FIXED = [
    "[1] see [2]", "{'a':1}", "", "  ", "1 2", "nul", "[1,]", '1,"end of value"]', '1,"end of value"] x', '{"a":1}}', "-NaN", "NaNx", '"\\u12"',
    "[01]", "[1.]", "[.5]", "[+1]", '{"a":1,"a":2}', '{"reasoning":"a, NaN, b","x":NaN}', "[" * 200 + "]" * 200, '["' + "x" * 100_000 + '", NaN]',
]


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    gap = lambda: rng.choice(["", "", "", " ", "\n", "\t "])
    if kind == 0:
        return rng.choice(["true", "false", "null"])
    if kind == 1:
        return rng.choice(NUMBERS)
    if kind < 5:
        return json.dumps(rng.choice(STRINGS), ensure_ascii=rng.random() < 0.5)
    if kind == 5:
        return "[" + gap() + ("," + gap()).join(value(rng, depth + 1) for _ in range(rng.randrange(4))) + gap() + "]"
    pairs = [json.dumps(rng.choice("abcab")) + gap() + ":" + gap() + value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return "{" + gap() + ("," + gap()).join(pairs) + gap() + "}"


def texts():
    rng = random.Random(1)
    out = [value(rng) for _ in range(800)]
    for t in list(out):
        at = rng.randrange(len(t) + 1)
        out.append(t[:at] + rng.choice(JUNK) + t[at + rng.randrange(2) :])
    return out + FIXED


def finite(v):
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, list):
        return [finite(x) for x in v]
    return {k: finite(x) for k, x in v.items()} if isinstance(v, dict) else v


def loaded(text):
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


def test_values_and_elements_equal_pythons_reader(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "i long, t string")
    rows = df.select("t", F.to_json(json_value("t")).alias("v"), F.transform(elements(F.col("t")), spelled).alias("e")).collect()
    valid = 0
    for r in rows:
        ok, want = loaded(r["t"])
        assert (r["v"] is not None) == ok, r["t"][:200]
        assert (r["e"] is not None) == (ok and isinstance(want, list)), r["t"][:200]
        valid += ok
        if ok:
            assert json.loads(r["v"]) == finite(want), r["t"][:200]
        if r["e"] is not None:
            assert len(r["e"]) == len(want)
            for got, one in zip(r["e"], want, strict=True):
                if isinstance(one, dict | list):
                    assert repr(json.loads(got)) == repr(one)
                elif isinstance(one, str):
                    assert got == one
                elif isinstance(one, float) and not math.isfinite(one):
                    assert got == json.dumps(one)
    assert 800 < valid < len(rows) - 200


@pytest.mark.parametrize("fence", ["", "```json\n"])
def test_a_reply_gives_cases_or_an_error(spark, fence):
    bodies = texts() + ['[{"input": {"q": NaN, "w": 1.0}, "expected": {"b": 1, "a": "NaN"}}] ', '[{"input": {"q": 1}, "expected": {}}] see [1]']
    bodies += ["[{'input': {'q': 1}, 'expected': {}}]", '[{"input": -Infinity, "expected": "x", "description": NaN, "tags": ["NaN", NaN]}, 5, "{", NaN]']
    df = spark.createDataFrame([(i, f"{fence}{t}\n```" if fence else t) for i, t in enumerate(bodies)], "i long, raw_text string")
    cases = {}
    for r in replies.parse_generated(df).collect():
        cases.setdefault(r["i"], []).append(r)
    errors = {r["i"] for r in replies.reply_errors(df).collect()}
    assert errors.isdisjoint(cases)
    assert errors == {i for i, t in enumerate(bodies) if not loaded(t)[0]}
    n = len(bodies)
    assert cases[n - 4][0]["input"] == '{"q":NaN,"w":1.0}' and cases[n - 4][0]["expected"] == '{"b":1,"a":"NaN"}'
    last = cases[n - 1][0]
    assert (last["input"], last["expected"], last["description"], last["tags"]) == ("-Infinity", "x", "NaN", ["NaN", "NaN"])


def test_a_judge_reply_keeps_what_its_strings_say(spark):
    raw = ['{"reasoning": "a, NaN, b", "x": NaN, "answer": "None"}', '{"answer": "all"} thanks', "{'answer': 'all'}"]
    df = spark.createDataFrame([(i, "faithfulness", t) for i, t in enumerate(raw)], "i int, metric string, raw_text string")
    got = {r["i"]: r["reason"] for r in judge.parse_replies(df).collect()}
    assert got[0] == "a, NaN, b"
    assert got[1] == got[2] == "Could not parse judge response: not a JSON object"
