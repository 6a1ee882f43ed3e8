"""Whole runs on small fixtures: from case lines to a gated report."""

import json

from pyspark.sql import functions as F

from scorelake.operators import agent, fold, judge, prompts, rag, regress, summary
from scorelake.operators.batch import run_batch
from scorelake.operators.thresholds import attach_thresholds, threshold_struct
from scorelake.schemas import AGENT_THRESHOLDS, LLM_THRESHOLDS, RAG_THRESHOLDS
from scorelake.sources import cases, history, results


def case_lines(spark, kind, *items):
    rows = [("d", kind, json.dumps(i)) for i in items]
    return cases.validate_cases(spark.createDataFrame(rows, "dataset string, type string, line string")).filter("valid")


def test_agent_run(spark, tmp_path):
    lines = case_lines(
        spark, "agent",
        {"id": "a", "input": {"task": "where is x"}, "expected": {"answer": "us-west-2", "must_call": ["find"], "must_call_with": [{"tool": "find", "args": {"name": "x"}}], "max_steps": 4}},
        {"id": "b", "input": {"task": "drop y"}, "expected": {"answer": "no", "must_not_call": ["drop"]}},
        {"id": "c", "input": {"task": "crash"}},
    )
    table = cases.parse_cases(lines).select(
        "dataset", "case_id", F.col("input.task").alias("task"), cases.agent_expected(F.col("expected")).alias("expected")
    )

    def act(case):
        if case["task"] == "crash":
            raise RuntimeError("no way")
        name = case["task"].split()[-1]
        tool = "find" if case["task"].startswith("where") else "drop"
        call = {"name": tool, "arguments": {"name": json.dumps(name)}, "result_json": "null", "error": None, "latency_ms": 0}
        step = {"type": "tool_call", "content": "", "tool_call": call, "latency_ms": 0, "tokens": 0, "cost_usd": 0.0}
        return {"steps": [step], "final_answer": "It is US-WEST-2", "total_latency_ms": 40, "total_cost_usd": 0.5}

    out = run_batch(table.select("dataset", "case_id", "task"), act, "dataset string, case_id string")
    joined = table.join(out, ["dataset", "case_id"]).withColumns(
        {"thresholds": threshold_struct(AGENT_THRESHOLDS), "cost_usd": F.col("total_cost_usd"), "run_id": F.lit("r1")}
    )
    scored = agent.score_agent(joined)
    got = {r["case_id"]: r for r in scored.collect()}
    assert got["a"]["passed"] and got["a"]["composite_score"] == 1.0
    assert got["b"]["failure_reasons"] == ["Answer score 0.00 below threshold 0.80", "Forbidden tool was called: 'drop'"]
    assert got["c"]["failure_reasons"] == ["Agent error: no way"]
    runs = summary.summarize_runs(scored, means=("composite_score", "tool_score"))
    details = results.agent_case_details(scored)
    assert {r["case_id"]: r["step_count"] for r in details.collect()} == {"a": 1, "b": 1, "c": 0}
    path = str(tmp_path / "h")
    rows = scored.withColumns({"ord": F.ascii("case_id").cast("long"), "vars_json": F.lit("{}")})
    history.record_runs(
        history.history_runs(runs, "agent", F.lit('["m:Agent"]'), F.lit("2024-01-01T00:00:00")),
        history.history_cases(rows, "case_id", "composite_score"), path,
    )
    stored, kept = history.load_history(spark, path)
    assert stored.first()["pass_rate"] == 0.333333 and stored.first()["run_type"] == "agent"
    assert [r["vars_key"] for r in kept.orderBy("id").collect()] == ["a", "b", "c"]


def test_retrieval_run_with_judge(spark):
    lines = case_lines(
        spark, "rag",
        {"id": "a", "input": {"query": "q", "retrieved_contexts": ["c1", "c2"]}, "expected": {"ground_truth": "Paris"}},
        {"id": "b", "input": {"query": "r"}, "expected": {"ground_truth": "Rome"}},
    )
    table = cases.parse_cases(lines).select(
        "dataset", "case_id", F.col("input.query").alias("query"), F.col("input.retrieved_contexts").alias("contexts"),
        F.col("expected.ground_truth").alias("ground_truth"),
    )
    answers = spark.createDataFrame([("d", "a", "paris!", None, 5), ("d", "b", "Rome", None, 6)], "dataset string, case_id string, answer string, error string, latency_ms int")
    asked = prompts.rag_judge_prompts(rag.join_responses(table, answers)).select("dataset", "case_id", "metric", "prompt")
    assert asked.count() == 4 and asked.filter(F.contains("prompt", F.lit("(no contexts provided)"))).count() == 1
    said = {("a", "faithfulness"): "most", ("a", "answer_correctness"): "correct", ("b", "faithfulness"): "none", ("b", "answer_correctness"): "partially correct"}
    replies = spark.createDataFrame(
        [("d", c, m, json.dumps({"answer": a, "reasoning": f"{c} {m}"})) for (c, m), a in said.items()],
        "dataset string, case_id string, metric string, raw_text string",
    )
    judged = judge.pivot_metrics(judge.parse_replies(replies), judge.RAG_METRICS, ("dataset", "case_id"))
    catalog = spark.createDataFrame([("d",)], "dataset string").withColumn("thresholds", threshold_struct(RAG_THRESHOLDS, min_faithfulness_score=0.5))
    full = attach_thresholds(rag.join_judge(rag.join_responses(table, answers), judged), catalog, RAG_THRESHOLDS)
    got = {r["case_id"]: r for r in rag.score_rag(full.withColumn("cost_usd", F.lit(0.0))).collect()}
    assert got["a"]["passed"] and got["a"]["composite_score"] == 0.875
    assert got["b"]["failure_reasons"] == ["Faithfulness score 0.00 below threshold 0.50: b faithfulness"]


def test_plain_run_against_a_stored_baseline(spark, tmp_path):
    def output(*passed):
        items = [{"vars": {"q": str(i)}, "success": ok, "latencyMs": 10 * i, "cost": 0.001, "provider": p} for p in ("x", "y") for i, ok in enumerate(passed)]
        return json.dumps({"results": {"results": items, "stats": {"tokenUsage": {"total": 7}}}})

    def run(run_id, text):
        raw = results.parse_results(spark.createDataFrame([(run_id, "d", text)], "run_id string, dataset string, json string"))
        return fold.fold_providers(raw, carry=["vars_json"])

    path = str(tmp_path / "b")
    first = run("r1", output(True, True, False))
    history.save_baselines(summary.summarize_runs(first), first, path)
    base_runs, base_cases = history.load_baselines(spark, path)
    flagged = regress.flag_regressions(run("r2", output(True, False, True)), regress.baseline_cases(base_cases))
    runs = summary.summarize_runs(flagged, flags={"regressed": "regressions"})
    report = regress.gate_runs(runs.withColumn("thresholds", threshold_struct(LLM_THRESHOLDS, pass_rate=0.5, max_cost_usd=0.001)), base_runs).first()
    assert report["regressions"] == 1 and report["gate_passed"] is False
    assert report["failure_reasons"] == ["1 previously-passing case(s) now fail", "Total cost $0.0060 exceeds threshold $0.0010"]
    assert [json.loads(r["vars_json"]) for r in flagged.filter("regressed").collect()] == [{"q": "1"}]
