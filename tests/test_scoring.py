import json
import random

import pytest
from pyspark.sql import functions as F

from scorelake.functions.keys import canonical_args
from scorelake.functions.scales import METRIC_SCALES
from scorelake.operators import agent, assertions, judge, prompts, rag
from scorelake.operators.thresholds import threshold_struct
from scorelake.schemas import AGENT_THRESHOLDS, EXPECTED, MOCKS, RAG_THRESHOLDS, STEPS

TRAJECTORY = f"case_id int, steps {STEPS}, final_answer string, error string, expected {EXPECTED}"


def call(name, error=None, result="null", **arguments):
    args = {k: None if v is None else json.dumps(v) for k, v in arguments.items()}
    tool = {"name": name, "arguments": args, "result_json": result, "error": error, "latency_ms": 0}
    return {"type": "tool_call", "content": "", "tool_call": tool, "latency_ms": 0, "tokens": 0, "cost_usd": 0.0}


def say(kind, text):
    return {"type": kind, "content": text, "tool_call": None, "latency_ms": 0, "tokens": 0, "cost_usd": 0.0}


def want(**kw):
    base = dict(answer=None, answer_match="contains", rubric=None, must_call=[], must_not_call=[], must_call_with=[], max_steps=None, max_tool_calls=None)
    return {**base, **kw}


def score(spark, cases, enforce=False, **limits):
    rows = [(i, steps, final, error, expected) for i, (steps, final, error, expected) in enumerate(cases)]
    df = spark.createDataFrame(rows, TRAJECTORY).withColumn("thresholds", threshold_struct(AGENT_THRESHOLDS, **limits))
    return agent.score_agent(df, enforce).orderBy("case_id").collect()


def test_answer_modes(spark):
    got = score(spark, [
        ([], " us-west-2\n", None, want(answer="us-west-2", answer_match="exact")),
        ([], "US-WEST-2", None, want(answer="us-west-2", answer_match="exact")),
        ([], "It is US-West-2.", None, want(answer="us-west-2")),
        ([], "id 42", None, want(answer=r"\d{2}", answer_match="regex")),
        ([], None, None, want(answer="x")),
        ([], None, None, want(answer="")),
        ([], None, None, want()),
        ([], "yes sir", None, want(answer="YES", answer_match="llm_judge")),
    ])
    assert [r["answer_score"] for r in got] == [1.0, 0.0, 1.0, 1.0, 0.0, 1.0, 1.0, 1.0]
    assert got[1]["failure_reasons"] == ["Answer score 0.00 below threshold 0.80"]
    assert got[7]["answer_reason"].startswith("llm_judge requested but no --judge-model configured")


def test_tool_checks_keep_order_and_duplicates(spark):
    steps = [call("search", q="a"), say("thought", "t"), call("drop", id=1)]
    got = score(spark, [
        (steps, "x", None, want(must_call=["get", "search", "get"], must_not_call=["drop", "rm"])),
        (steps, "x", None, want(must_call_with=[
            {"tool": "search", "args": {"q": '"a"'}}, {"tool": "search", "args": {"q": '"b"', "n": "1"}},
            {"tool": "none", "args": {}}, {"tool": "drop", "args": {}}, {"tool": "drop", "args": {"gone": None}},
        ])),
    ])
    assert got[0]["missing_tools"] == ["get", "get"] and got[0]["forbidden_tools_found"] == ["drop"]
    assert got[0]["tool_score"] == pytest.approx(1 - 3 / 5)
    assert got[0]["failure_reasons"] == ["Required tool not called: 'get'"] * 2 + ["Forbidden tool was called: 'drop'"]
    assert got[1]["missing_args"] == ["search(q='b', n=1)", "none(not called)"]
    assert got[1]["failure_reasons"][1] == "Tool 'none' required by must_call_with but was never called"
    assert got[1]["tool_score"] == pytest.approx(1 - 2 / 5)


def test_call_requirements_agree_with_brute_force(spark):
    rng = random.Random(3)
    values = [None, 1, 2, "a", True]

    def some():
        return {k: rng.choice(values) for k in rng.sample("abc", rng.randrange(4))}

    cases, expected = [], []
    for _ in range(120):
        calls = [(rng.choice("st"), some()) for _ in range(rng.randrange(4))]
        tool, args = rng.choice("st"), some()
        same = [a for n, a in calls if n == tool]
        expected.append(any(all(a.get(k) == v and type(a.get(k)) is type(v) for k, v in args.items()) for a in same))
        needed = {k: None if v is None else json.dumps(v) for k, v in args.items()}
        cases.append(([call(n, **a) for n, a in calls], "x", None, want(must_call_with=[{"tool": tool, "args": needed}])))
    got = score(spark, cases)
    assert [not r["missing_args"] for r in got] == expected


def test_limits_efficiency_and_crash(spark):
    four = [say("thought", "a"), call("t"), call("t"), say("answer", "b")]
    got = score(spark, [
        (four, "b", None, want(max_steps=3, max_tool_calls=1)),
        (four, "b", None, want(max_steps=7)),
        (four, "b", None, want(max_steps=1)),
        (four, "b", "boom", want(answer="b", must_call=["z"])),
    ])
    assert got[0]["failure_reasons"] == ["Step count 4 exceeds max 3", "Tool call count 2 exceeds max 1"]
    assert [r["efficiency_score"] for r in got] == [0.0, 0.5, 1.0, 1.0]
    crash = got[3]
    assert (crash["answer_score"], crash["tool_score"], crash["composite_score"], crash["passed"]) == (0.0, 0.0, 0.0, False)
    assert crash["failure_reasons"] == ["Agent error: boom"] and (crash["step_count"], crash["tool_call_count"]) == (4, 2)


def test_composite_drops_reasoning_weight_and_tool_minimum_is_optional(spark):
    case = ([call("a")], "x", None, want(answer="x", must_call=["a", "b"]))
    got = score(spark, [case])[0]
    assert got["composite_score"] == pytest.approx((0.4 + 0.5 * 0.4 + 0.05) / 0.85)
    assert len(got["failure_reasons"]) == 1
    assert "Tool score 0.50 below threshold 1.00" in score(spark, [case], enforce=True)[0]["failure_reasons"]
    zero = score(spark, [case], answer_weight=0.0, tool_weight=0.0, reasoning_weight=0.0, efficiency_weight=0.0)[0]
    assert zero["composite_score"] == 0.0


def test_mock_lookup(spark):
    mocks = '{"ok": {"response_json": "{\\"r\\": 1}"}, "bad": {"error": "denied"}}'
    df = spark.createDataFrame([([call("ok"), call("bad"), call("it's"), say("thought", "t")], mocks)], f"steps {STEPS}, mocks string")
    df = df.withColumn("tools", F.from_json("mocks", MOCKS))
    steps = df.select(agent.resolve_tool_calls(F.col("steps"), F.col("tools")).alias("s")).first()["s"]
    assert steps[0]["tool_call"]["result_json"] == '{"r": 1}' and steps[0]["tool_call"]["error"] is None
    assert steps[1]["tool_call"]["error"] == "denied" and steps[1]["tool_call"]["result_json"] is None
    assert steps[2]["tool_call"]["error"] == "Tool 'it's' is not defined in this test case. Available: ['ok', 'bad']"
    assert steps[3]["tool_call"] is None


def test_canonical_arguments(spark):
    df = spark.createDataFrame([('{"b": 1.0, "a": "x", "n": null, "o": {"z": 1, "y": [1, 2]}}',)], "j string")
    assert df.select(canonical_args(F.col("j")).alias("m")).first()["m"] == {"a": '"x"', "b": "1", "n": None, "o": '{"y":[1,2],"z":1}'}


def position(label, scale):
    """The rule in plain Python: exact, else the first label that overlaps, else the middle."""
    if label in scale:
        return scale.index(label)
    return next((i for i, known in enumerate(scale) if known in label or label in known), len(scale) // 2)


def test_every_label_on_every_scale(spark):
    labels = ["correct", "not correct", "", "banana", "ALL ", "partially", "yes!", "half", "helpful", "neutral", "None", "most of it"]
    rows = [(m, lab, json.dumps({"reasoning": "why", "answer": lab})) for m in METRIC_SCALES for lab in labels]
    got = judge.parse_replies(spark.createDataFrame(rows, "metric string, lab string, raw_text string")).collect()
    for r in got:
        scale = METRIC_SCALES[r["metric"]]
        at = position(r["lab"].strip().lower(), scale)
        assert (r["raw"], r["label"], r["max_raw"]) == (at, scale[at], len(scale) - 1)
        assert r["normalized"] == at / (len(scale) - 1)


@pytest.mark.parametrize(
    "text, raw, reason",
    [
        ('```json\n{"answer": "Correct", "reasoning": "ok"}\n```', 2, "ok"),
        ("not json", 1, "Could not parse judge response: not a JSON object"),
        ('[{"answer": "correct"}]', 1, "Could not parse judge response: not a JSON object"),
        ('{"answer": "banana"}', 1, "Could not parse label 'banana' — defaulted to 'partially correct'"),
        ('{"reasoning": "x"}', 0, "x"),
        ('{"answer": true}', 1, "Could not parse label 'true' — defaulted to 'partially correct'"),
    ],
)
def test_reply_forms(spark, text, raw, reason):
    df = spark.createDataFrame([("correctness", text)], "metric string, raw_text string")
    got = judge.parse_replies(df).first()
    assert (got["raw"], got["reason"]) == (raw, reason)


def test_null_answer_reads_as_none(spark):
    df = spark.createDataFrame([("faithfulness", '{"answer": null, "reasoning": null}')], "metric string, raw_text string")
    got = judge.parse_replies(df).first()
    assert (got["label"], got["reason"]) == ("none", "None")


def test_pivot_needs_all_metrics(spark):
    rows = [(1, "correctness", "correct"), (1, "completeness", "yes"), (1, "helpfulness", "helpful"), (2, "correctness", "correct")]
    df = spark.createDataFrame([(c, m, json.dumps({"answer": a, "reasoning": m[0]})) for c, m, a in rows], "case_id int, metric string, raw_text string")
    got = judge.pivot_metrics(judge.parse_replies(df), judge.ANSWER_METRICS, ("case_id",)).collect()
    assert len(got) == 1 and got[0]["judge_score"] == 0.9167
    assert got[0]["judge_reason"] == "Correctness: c | Completeness: c | Helpfulness: h"


def rag_case(spark, limits=None, judged=None, error=None, answer="It is us-west-2", truth="us-west-2"):
    df = spark.createDataFrame([(truth, answer, error)], "ground_truth string, answer string, error string")
    df = df.withColumn("thresholds", threshold_struct(RAG_THRESHOLDS, **(limits or {})))
    if judged:
        block = lambda v, why: F.struct(F.lit(1).alias("raw"), F.lit("x").alias("label"), F.lit(v).alias("normalized"), F.lit(why).alias("reason"))
        df = df.withColumns({"faithfulness": block(judged[0], "f why"), "answer_correctness": block(judged[1], "c why")})
    return rag.score_rag(df).first()


def test_rag_without_judge(spark):
    got = rag_case(spark)
    assert (got["contains_score"], got["faithfulness_score"], got["composite_score"], got["passed"]) == (1.0, 1.0, 1.0, True)
    got = rag_case(spark, answer="no idea")
    assert got["failure_reasons"] == [
        "Answer does not contain expected ground truth: 'us-west-2'",
        "Answer correctness score 0.00 below threshold 0.50 (no judge configured; using contains match)",
    ]
    assert len(rag_case(spark, {"require_contains": False}, answer="no")["failure_reasons"]) == 1


def test_rag_with_judge(spark):
    got = rag_case(spark, {"min_faithfulness_score": 0.8}, (0.75, 0.0))
    assert got["composite_score"] == 0.375
    assert got["failure_reasons"] == [
        "Faithfulness score 0.75 below threshold 0.80: f why", "Answer correctness score 0.00 below threshold 0.50: c why",
    ]
    assert rag_case(spark, None, (0.0, 1.0))["passed"] is True


def test_rag_failed_call_comes_first_and_is_not_judged(spark):
    got = rag_case(spark, None, (1.0, 1.0), error="timeout")
    assert got["failure_reasons"][0] == "Model call failed: timeout" and got["passed"] is False
    assert got["answer_correctness_score"] == 0.0
    got = rag_case(spark, None, None, error="timeout", truth="")
    assert got["failure_reasons"] == ["Model call failed: timeout"] and got["passed"] is False


def test_cases_without_response_fail(spark):
    cases = spark.createDataFrame([("d", 1, "x"), ("d", 2, "x")], "dataset string, case_id int, ground_truth string").withColumn("thresholds", threshold_struct(RAG_THRESHOLDS))
    answers = spark.createDataFrame([("d", 1, "x", None)], "dataset string, case_id int, answer string, error string")
    got = {r["case_id"]: r for r in rag.score_rag(rag.join_responses(cases, answers)).collect()}
    assert got[1]["passed"] is True and got[2]["failure_reasons"][0] == "Model call failed: no response"


def test_every_run_is_held_to_every_case(spark):
    cases = spark.createDataFrame([("d", 1, "x"), ("d", 2, "x")], "dataset string, case_id int, ground_truth string").withColumn("thresholds", threshold_struct(RAG_THRESHOLDS))
    runs = spark.createDataFrame([("r1", "d"), ("r2", "d")], "run_id string, dataset string")
    answers = spark.createDataFrame([("r1", "d", 1, "x", None), ("r1", "d", 2, "x", None), ("r2", "d", 2, "y", None)], "run_id string, dataset string, case_id int, answer string, error string")
    got = {(r["run_id"], r["case_id"]): r["passed"] for r in rag.score_rag(rag.join_responses(cases, answers, runs=runs)).collect()}
    assert got == {("r1", 1): True, ("r1", 2): True, ("r2", 1): False, ("r2", 2): False}


def test_assertions(spark):
    schema = (
        "type string, input struct<query:string,text:string,instruction:string,document:string>, "
        "expected struct<ground_truth:string,label:string,rubric:string>, answer string"
    )
    rows = [
        ("qa", ("q", None, None, None), ("256 KB", None, None), "limit 256 kb"),
        ("classification", (None, "t", None, None), (None, "Net", None), "storage"),
        ("instruction", (None, None, "do", ""), (None, None, "three bullets"), "x"),
        ("instruction", (None, None, "do", "doc"), (None, None, "r"), "x"),
    ]
    built = assertions.check_assertions(assertions.build_assertions(spark.createDataFrame(rows, schema)))
    got = built.select("vars", "assertions", assertions.score_checks(F.col("checks")).alias("s"), assertions.all_passed(F.col("checks")).alias("ok")).collect()
    assert [r["vars"] for r in got] == [{"query": "q"}, {"text": "t"}, {"instruction": "do"}, {"instruction": "do", "document": "doc"}]
    assert got[0]["assertions"][1]["value"] == "The answer must correctly address the following: 256 KB"
    assert [(r["s"], r["ok"]) for r in got] == [(1.0, True), (0.0, False), (1.0, True), (1.0, True)]


def test_trajectory_text(spark):
    steps = [say("thought", "hm"), call("get", result='{"é": 1}', key="ü"), call("rm", error="denied"), say("answer", "done")]
    df = spark.createDataFrame([(steps,), ([],)], f"steps {STEPS}")
    got = [r["t"] for r in df.select(prompts.trajectory_text(F.col("steps")).alias("t")).collect()]
    assert got[0].split("\n") == [
        "Step 1 [thought] hm", 'Step 2 [tool_call] get({"key": "\\u00fc"})', '  → {"\\u00e9": 1}', "Step 3 [tool_call] rm({})",
        "  → ERROR: denied", "Step 4 [answer] done",
    ]
    assert got[1] == "(no steps)"


def test_templates_do_not_scan_values(spark):
    df = spark.range(1).select(prompts.rag_prompt(F.lit("{contexts}?"), F.array(F.lit("{query}"), F.lit("b"))).alias("p"))
    text = df.first()["p"]
    assert text.endswith("Context documents:\n[1] {query}\n\n[2] b\n\nQuestion: {contexts}?")
    own = spark.range(1).select(prompts.rag_prompt(F.lit("q"), F.array().cast("array<string>"), "{query}|{contexts}").alias("p"))
    assert own.first()["p"] == "q|(no context documents provided)"


def test_case_mix_rounds_down(spark):
    text = spark.range(1).select(prompts.mix_lines(F.lit(10)).alias("m")).first()["m"]
    assert text.split("\n")[:3] == ["  - factual: ~4 cases (40%)", "  - multi_hop: ~2 cases (20%)", "  - negation: ~1 cases (15%)"]


def test_tool_catalog(spark):
    schema = "tools array<struct<name:string,description:string,parameters_json:string>>"
    df = spark.createDataFrame([([("s", "find", '{"a": 1}'), ("g", "get", "{}")],), ([],)], schema)
    got = [r["t"] for r in df.select(prompts.tool_catalog_text(F.col("tools")).alias("t")).collect()]
    assert got[0] == 'Tool: s\n  Description: find\n  Parameters: {"a": 1}\n\n  Tool: g\n  Description: get'
    assert got[1] == prompts.NO_TOOLS


def test_unsafe_patterns_are_listed(spark):
    patterns = [r"(?P<x>a)(?P=x)", "ok", "[", None]
    rows = [(i, [], "baab", None, want(answer=p, answer_match="regex")) for i, p in enumerate(patterns)]
    cases = spark.createDataFrame(rows, TRAJECTORY).withColumn("thresholds", threshold_struct(AGENT_THRESHOLDS))
    assert [(r["case_id"], r["pattern_error"]) for r in agent.bad_patterns(cases).collect()] == [(2, "unterminated character set at position 0")]
    got = {r["case_id"]: r for r in agent.score_agent(cases).collect()}
    assert [got[i]["answer_score"] for i in range(4)] == [1.0, 0.0, 0.0, 1.0]
    assert got[2]["failure_reasons"] == ["Answer score 0.00 below threshold 0.80: Invalid regex pattern: unterminated character set at position 0"]


def test_compact_trajectories_score_the_same(spark):
    from scorelake.operators.transcripts import compact

    rng = random.Random(6)
    rows, steps = [], []
    for i in range(40):
        path = [call(rng.choice("abc"), n=rng.randrange(2), m=None) if rng.random() < 0.7 else say("thought", "t") for _ in range(rng.randrange(1, 12))]
        need = want(must_call=["a", "z"], must_not_call=["b"], must_call_with=[{"tool": "c", "args": {"n": "1", "m": None}}], max_steps=6, max_tool_calls=4)
        rows.append((i, path, "x", None, need))
        steps += [(i, j, 0, s) for j, s in enumerate(path)]
    full = spark.createDataFrame(rows, TRAJECTORY).withColumn("thresholds", threshold_struct(AGENT_THRESHOLDS))
    short = compact(spark.createDataFrame(steps, f"case_id int, turn int, pos int, step {STEPS[6:-1]}")).join(full.drop("steps"), "case_id")
    kept = ("case_id", "step_count", "tool_call_count", "tool_score", "composite_score", "failure_reasons", "passed")
    a, b = (agent.score_agent(d).select(*kept).orderBy("case_id").collect() for d in (full, short))
    assert a == b
