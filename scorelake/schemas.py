"""Declared schemas of the tables the operators read and write, as DDL text. Nothing is ever inferred."""

from __future__ import annotations

TOOL_CALL = "struct<name:string,arguments:map<string,string>,result_json:string,error:string,latency_ms:int>"
STEP = f"struct<type:string,content:string,tool_call:{TOOL_CALL},latency_ms:int,tokens:int,cost_usd:double>"
STEPS = f"array<{STEP}>"
MOCK = "struct<response_json:string,latency_ms:int,error:string>"
MOCKS = f"map<string,{MOCK}>"
CALL_REQUIREMENT = "struct<tool:string,args:map<string,string>>"

EXPECTED = (
    "struct<answer:string,answer_match:string,rubric:string,must_call:array<string>,must_not_call:array<string>,"
    f"must_call_with:array<{CALL_REQUIREMENT}>,max_steps:int,max_tool_calls:int>"
)

RUNS = (
    "run_id string, dataset string, ran_at string, providers string, total_cases int, passed int, failed int, "
    "pass_rate double, total_cost_usd double, total_tokens long, prompt_tokens long, completion_tokens long, "
    "avg_latency_ms double, p50_latency_ms double, p95_latency_ms double, run_type string"
)

CASE_RESULTS = (
    "id long, run_id string, dataset string, vars_key string, vars_json string, passed boolean, score double, "
    "latency_ms int, cost_usd double"
)

DOCUMENTS = "content string, filename string, source string"

# Threshold defaults. A null threshold switches its gate off.
LLM_THRESHOLDS = {
    "pass_rate": 1.0,
    "fail_on_regression": True,
    "max_score_drop": None,
    "max_cost_usd": None,
    "max_p95_latency_ms": None,
}
RAG_THRESHOLDS = {
    "pass_rate": 1.0,
    "fail_on_regression": True,
    "require_contains": True,
    "min_faithfulness_score": None,
    "min_answer_correctness_score": 0.5,
    "max_cost_usd": None,
    "max_p95_latency_ms": None,
    "faithfulness_weight": 0.5,
    "answer_correctness_weight": 0.5,
}
AGENT_THRESHOLDS = {
    "pass_rate": 1.0,
    "min_answer_score": 0.8,
    "min_tool_score": 1.0,
    "min_reasoning_score": None,
    "fail_on_regression": True,
    "max_cost_usd": None,
    "max_p95_latency_ms": None,
    "answer_weight": 0.40,
    "tool_weight": 0.40,
    "reasoning_weight": 0.15,
    "efficiency_weight": 0.05,
}
THRESHOLD_TYPES = {
    "fail_on_regression": "boolean",
    "require_contains": "boolean",
    "max_p95_latency_ms": "int",
}
