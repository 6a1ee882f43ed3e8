import random

import pytest
from pyspark.sql import functions as F

from scorelake.operators import display, fold, regress, summary
from scorelake.operators.thresholds import attach_thresholds, threshold_struct
from scorelake.schemas import LLM_THRESHOLDS, RAG_THRESHOLDS

RAW = "run_id string, dataset string, key string, ord long, provider string, success boolean, score double, latency_ms int, cost_usd double"
CASES = "run_id string, dataset string, key string, ord long, passed boolean, score double, latency_ms int, cost_usd double"


def raw(spark, rows):
    return spark.createDataFrame([("r", "d", *r) for r in rows], RAW)


def test_fold_is_strict_on_pass_low_on_score_mean_on_latency_sum_on_cost(spark):
    rows = raw(spark, [("k", 0, "p", True, 0.9, 200, 0.1), ("k", 1, "q", False, 0.6, 405, 0.2), ("m", 2, "p", True, 1.0, 7, 0.0)])
    got = {r["key"]: r for r in fold.fold_providers(rows).collect()}
    assert (got["k"]["passed"], got["k"]["score"], got["k"]["latency_ms"]) == (False, 0.6, 302)
    assert got["k"]["cost_usd"] == pytest.approx(0.3)
    assert got["k"]["ord"] == 0 and got["m"]["passed"] is True


def test_fold_does_not_depend_on_row_order(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(9)}", i, "p", rng.random() < 0.7, rng.randrange(10) / 10, rng.randrange(900), 0.5) for i in range(200)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    a, b = (sorted(map(tuple, fold.fold_providers(raw(spark, r)).collect())) for r in (rows, shuffled))
    assert a == b


def test_last_row_of_a_provider_wins(spark):
    rows = raw(spark, [("k", 0, "p", True, 1.0, 1, 0.0), ("k", 5, "p", False, 0.2, 9, 0.5), ("k", 3, "p", True, 0.7, 4, 0.1)])
    got = fold.provider_cases(rows).collect()
    assert len(got) == 1 and (got[0]["passed"], got[0]["score"], got[0]["latency_ms"]) == (False, 0.2, 9)


def test_matrix_has_nulls_for_missing_cases_and_needs_two_providers(spark):
    rows = raw(spark, [("k", 0, "p", True, 1.0, 1, 0.0), ("m", 1, "q", False, 0.0, 2, 0.0)])
    got = {r["key"]: r for r in fold.provider_matrix(rows, ["p", "q"]).collect()}
    assert got["k"]["p_passed"] is True and got["k"]["q_passed"] is None and got["m"]["q_latency_ms"] == 2
    assert fold.provider_matrix(rows, ["p"]).count() == 0
    assert fold.list_providers(rows) == ["p", "q"]
    many = raw(spark, [("k", i, f"p{i:03d}", True, 1.0, 1, 0.0) for i in range(300)])
    assert fold.list_providers(many) == [f"p{i:03d}" for i in range(300)]
    assert fold.provider_cases(many).count() == 300


def test_percentiles_are_nearest_rank(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for n in (1, 2, 3, 19, 20, 21, 40, 100, 101, 333):
        values = [rng.randrange(50) * 7 for _ in range(n)]
        ranked = sorted(values)
        want[f"r{n}"] = (float(ranked[n // 2]), float(ranked[min(int(n * 0.95), n - 1)]))
        rows += [(f"r{n}", "d", str(i), i, True, 1.0, v, 0.0) for i, v in enumerate(values)]
    got = summary.percentiles(spark.createDataFrame(rows, CASES)).collect()
    assert {r["run_id"]: (r["p50_latency_ms"], r["p95_latency_ms"]) for r in got} == want


def test_summary_counts_rates_and_rounding(spark):
    rows = [("r", "d", str(i), i, i < 2, 1.0, latency, 0.0000004) for i, latency in enumerate((200, 180, 221))]
    runs = summary.summarize_runs(spark.createDataFrame(rows, CASES), means=("score",))
    exact, shown = runs.first(), summary.rounded(runs).first()
    assert (exact["total"], exact["passed"], exact["failed"]) == (3, 2, 1)
    assert exact["pass_rate"] == 2 / 3 and shown["pass_rate"] == 0.6667
    assert shown["avg_latency_ms"] == 200.3 and shown["total_cost_usd"] == 0.000001 and shown["avg_score"] == 1.0


def test_bands(spark):
    rows = spark.createDataFrame([(1.0,), (0.99,), (0.8,), (0.79,)], "pass_rate double")
    assert [r["band"] for r in summary.with_rate_band(rows).orderBy(F.col("pass_rate").desc()).collect()] == ["green", "yellow", "yellow", "red"]


def gated(spark, thresholds, **values):
    base = {"pass_rate": 1.0, "total_cost_usd": 0.0, "p95_latency_ms": 100.0, "baseline_pass_rate": 1.0, "regressions": 0}
    row = {**base, **values}
    df = spark.createDataFrame([row], "pass_rate double, total_cost_usd double, p95_latency_ms double, baseline_pass_rate double, regressions long")
    return regress.apply_gates(df.withColumn("thresholds", thresholds)).first()


@pytest.mark.parametrize(
    "limits, values, reason",
    [
        ({}, {"regressions": 2}, "2 previously-passing case(s) now fail"),
        ({"pass_rate": 0.9}, {"pass_rate": 0.5}, "Pass rate 50.0% is below required threshold 90.0%"),
        ({"pass_rate": 0.0, "max_score_drop": 0.05}, {"pass_rate": 0.8}, "Pass rate dropped 20.0%, exceeds max allowed drop of 5.0%"),
        ({"max_cost_usd": 0.01}, {"total_cost_usd": 0.0123}, "Total cost $0.0123 exceeds threshold $0.0100"),
        ({"max_p95_latency_ms": 99}, {}, "p95 latency 100ms exceeds threshold 99ms"),
        ({"fail_on_regression": False}, {"regressions": 2}, None),
        ({"max_cost_usd": 0.02}, {"total_cost_usd": 0.02}, None),
    ],
)
def test_each_gate(spark, limits, values, reason):
    got = gated(spark, threshold_struct(LLM_THRESHOLDS, **limits), **values)
    assert got["failure_reasons"] == ([reason] if reason else [])
    assert got["gate_passed"] is (reason is None)


def test_no_baseline_gives_no_verdict_and_retrieval_has_no_drop_gate(spark):
    got = gated(spark, threshold_struct(LLM_THRESHOLDS), pass_rate=0.0, baseline_pass_rate=None)
    assert got["gate_passed"] is None and got["failure_reasons"] is None
    got = gated(spark, threshold_struct(RAG_THRESHOLDS, pass_rate=0.0), pass_rate=0.0)
    assert got["gate_passed"] is True


def test_regressions_use_the_last_baseline_row_and_ignore_new_cases(spark):
    base = spark.createDataFrame([("b", "d", "k", 0, False, 0.1, 1, 0.0), ("b", "d", "k", 1, True, 0.9, 1, 0.0), ("b", "d", "z", 2, False, 0.0, 1, 0.0)], CASES)
    now = spark.createDataFrame([("r", "d", "k", 0, False, 0.3, 1, 0.0), ("r", "d", "k", 1, False, 0.2, 1, 0.0), ("r", "d", "new", 2, False, 0.0, 1, 0.0), ("r", "d", "z", 3, False, 0.0, 1, 0.0)], CASES)
    rows = regress.baseline_cases(base)
    found = regress.find_regressions(now, rows).collect()
    assert sorted((r["key"], r["score"], r["baseline_score"]) for r in found) == [("k", 0.2, 0.9), ("k", 0.3, 0.9)]
    flagged = regress.flag_regressions(now, rows)
    assert flagged.count() == 4 and flagged.filter("regressed").count() == 2


def test_chain_of_runs_skips_gaps(spark):
    rows = [(1, "k", True, 1.0), (2, "k", False, 0.5), (4, "k", False, 0.1), (1, "m", False, 0.0), (2, "m", False, 0.0)]
    df = spark.createDataFrame(rows, "run_no int, key string, passed boolean, score double").withColumn("dataset", F.lit("d"))
    hits = regress.flag_against_previous(df).filter("regressed").collect()
    assert [(r["run_no"], r["key"], r["baseline_score"]) for r in hits] == [(2, "k", 1.0)]
    runs = spark.createDataFrame([(1, 0.5), (2, 1 / 3), (4, 1.0)], "run_no int, pass_rate double").withColumn("dataset", F.lit("d"))
    rates = {r["run_no"]: r["baseline_pass_rate"] for r in regress.previous_rates(runs).collect()}
    assert rates == {1: None, 2: 0.5, 4: None}


def test_sweep_gate_modes(spark):
    rows = [("a", 1.0, True), ("b", 0.5, None), ("c", 1.0, True)]
    df = spark.createDataFrame(rows, "dataset string, pass_rate double, gate_passed boolean")
    assert regress.sweep_gate(df, compare=True).first()[0] is True
    assert regress.sweep_gate(df, compare=False).first()[0] is False
    assert regress.sweep_gate(df.withColumn("error", F.when(F.col("dataset") == "c", "boom")), compare=True).first()[0] is False


def test_attach_thresholds_defaults(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "dataset string")
    catalog = spark.createDataFrame([("a",)], "dataset string").withColumn("thresholds", threshold_struct(LLM_THRESHOLDS, pass_rate=0.25))
    got = {r["dataset"]: r["thresholds"]["pass_rate"] for r in attach_thresholds(cases, catalog, LLM_THRESHOLDS).collect()}
    assert got == {"a": 0.25, "b": 1.0}
    with pytest.raises(ValueError):
        threshold_struct(LLM_THRESHOLDS, no_such=1)


def test_failed_cases_cap_and_rest(spark):
    rows = [("r", "d", str(i), i, i % 2 == 0, 1.0, 1, 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, CASES)
    got = display.failed_cases(df, 3).orderBy("ord").collect()
    assert [r["ord"] for r in got] == [1, 3, 5] and {r["more"] for r in got} == {7}
    assert display.failed_cases(df).count() == 10


def test_provider_names_and_labels(spark):
    ids = spark.createDataFrame(
        [("bedrock:us.anthropic.model-x-v1:0",), ("anthropic:model-y",), ("plain",), ("bedrock:eu.meta.m" + "x" * 40,)], "p string"
    ).select(display.short_provider(F.col("p")).alias("s"))
    assert [r["s"] for r in ids.collect()] == ["model-x-v1:0", "model-y", "plain", "m" + "x" * 27]
    fields = spark.createDataFrame([("",), ('{"id": "a:b"}',), ('{"x": 1}',), ("p",)], "p string").select(display.provider_id(F.col("p")).alias("s"))
    assert [r["s"] for r in fields.collect()] == ["unknown", "a:b", "unknown", "p"]
    maps = [{"query": "Context\nQuestion: why\nnow? "}, {"text": "x" * 70}, {"other": "it's"}, {"query": "", "text": "t"}]
    labels = spark.createDataFrame([(m,) for m in maps], "m map<string,string>").select(display.case_label(F.col("m")).alias("s"))
    assert [r["s"] for r in labels.collect()] == ["why now?", "x" * 60 + "…", "{'other': \"it's\"}", "t"]
