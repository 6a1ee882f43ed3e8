import hashlib
import json
from pyspark.sql import functions as F

from scorelake.functions import keys, text

SAMPLES = [
    "  plain  ", "\x1c\x1fz\x85", "", "　", "a\x1fb\x0b\\u001F\\\x1f", "é\U0001F600'x\"", "it's", "line\nq\\", 'say "hi"',
    "tab\there", "  ", "x​y", "per mille ‰", "\x00nul",
]


def test_strip_quote_and_repr_match_python(spark):
    rows = spark.createDataFrame([(s,) for s in SAMPLES], "s string").select(
        "s",
        text.strip("s").alias("strip"),
        text.json_quote(F.col("s")).alias("quote"),
        text.ascii_json(text.json_quote(F.col("s"))).alias("ascii"),
        text.py_repr(F.col("s")).alias("repr"),
    ).collect()
    for r in rows:
        assert r["strip"] == r["s"].strip()
        assert r["quote"] == json.dumps(r["s"], ensure_ascii=False)
        assert r["ascii"] == json.dumps(r["s"])
        assert r["repr"] == repr(r["s"])


def test_number_texts_round_like_python(spark):
    numbers = [0.0625, 0.125, 2.675, 0.5, 1.0, 0.0, -0.25, 123456.789, 1e-7, 0.674, 0.15, 2.5, 3.5, 0.00005, 99.995, 0.05, 0.0005, -0.005, 0.055, 0.005, 0.9995, 1 / 3, 2 / 3]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select(
        "x", text.percent(F.col("x")).alias("p"), text.fixed(F.col("x"), 2).alias("f"),
        text.fixed(F.col("x"), 0).alias("z"), text.py_round(F.col("x"), 4).alias("r"),
    ).collect()
    for r in rows:
        x = r["x"]
        assert (r["p"], r["f"], r["z"], r["r"]) == (f"{x:.1%}", f"{x:.2f}", f"{x:.0f}", round(x, 4))


def test_icontains_edges(spark):
    cases = [("Hello World", "WORLD", True), ("", "", True), ("abc", "", True), (None, "a", False), (None, "", True), ("STRASSE", "stra", True)]
    rows = spark.createDataFrame(cases, "hay string, needle string, want boolean")
    assert rows.filter(text.icontains("hay", "needle") != F.col("want")).count() == 0


def test_fences(spark):
    given = [
        ('```json\n{"a": 1}\n```  ', '{"a": 1}', '{"a": 1}'),
        ("```\nabc", "abc", "abc"),
        ("no fence", "no fence", "no fence"),
        ("```a\nb\nc\n``` x", "b\nc\n``` x", "b\nc\n``` x"),
        ("```\nx```", "x", "x```"),
    ]
    rows = spark.createDataFrame(given, "s string, a string, b string").select(
        "a", "b", text.strip_fence("s").alias("ga"), text.strip_fence_lines("s").alias("gb")
    ).collect()
    assert all(r["a"] == r["ga"] and r["b"] == r["gb"] for r in rows)


def test_keys_ignore_key_order_and_match_python(spark):
    def expected(pairs):
        return hashlib.sha256(json.dumps(pairs, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]

    maps = [{"b": s, "a": "z"} for s in SAMPLES] + [{"a": "z", "b": SAMPLES[0]}, {}]
    rows = spark.createDataFrame([(m,) for m in maps], "m map<string,string>").select(
        "m", keys.vars_key(F.col("m")).alias("k")
    ).collect()
    assert all(r["k"] == expected(r["m"]) for r in rows)


def test_canonical_json_of_any_values(spark):
    texts = ['{"b":"x","a":"y"}', '{"a":1,"b":[1,2.0],"c":{"z":null, "d": true}}', "{}", '{"q":"1"}', '{"é": "ü", "a": "\\n"}', '{"n": null, "t": true, "i": -5, "big": 123456789012345678901, "f": 1.50, "e": 1e5}']
    rows = keys.with_canonical_json(spark.createDataFrame([(t,) for t in texts], "t string"), "c", F.col("t"))
    for r in rows.collect():
        assert r["c"] == json.dumps(json.loads(r["t"]), sort_keys=True, ensure_ascii=False)


def test_split_list(spark):
    row = spark.range(1).select(
        text.split_list(F.lit(" a, ,b,")).alias("x"), text.split_list(F.lit(" a, ,b"), False).alias("y")
    ).first()
    assert row["x"] == ["a", "b"] and row["y"] == ["a", "", "b"]
