"""Turn execution traces and generated agent cases into test cases. Row-wise expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective_calls(steps: Column) -> Column:
    """Tool-call steps that name a tool."""
    return F.filter(steps, lambda s: (s["type"] == "tool_call") & (s["tool"] != ""))


def must_call(steps: Column) -> Column:
    return F.array_distinct(F.transform(effective_calls(steps), lambda s: s["tool"]))


def mock_tools(steps: Column) -> Column:
    """Per called tool the result of its last call."""
    calls = effective_calls(steps)

    def mock(name: Column) -> Column:
        last = F.element_at(F.filter(calls, lambda s: s["tool"] == name), -1)
        return F.struct(
            last["result_json"].alias("response_json"),
            F.lit(0).alias("latency_ms"),
            F.lit(None).cast("string").alias("error"),
        )

    names = must_call(steps)
    return F.map_from_arrays(names, F.transform(names, mock))


def inferred_answer(final_answer: Column, steps: Column) -> Column:
    """The final answer (an empty one too), else the last answer step with text, else null."""
    answers = F.filter(steps, lambda s: (s["type"] == "answer") & (s["content"] != ""))
    return F.coalesce(final_answer, F.try_element_at(answers, F.lit(-1))["content"])


def step_limit(steps: Column) -> Column:
    return F.greatest(F.lit(3), F.ceil(F.size(steps) * F.lit(1.5)).cast("int"))


def call_limit(steps: Column) -> Column:
    return F.greatest(F.lit(1), F.size(effective_calls(steps)) + 1)


def trace_to_case(traces: DataFrame) -> DataFrame:
    """One test case per trace. Input: ``task``, ``steps``, ``final_answer`` and ``metadata`` as the trace scan gives."""
    steps, meta = F.col("steps"), F.col("metadata")
    no_requirement = F.array().cast("array<struct<tool:string,args:map<string,string>>>")
    names = F.array().cast("array<string>")
    return traces.withColumns(
        {
            "description": F.coalesce(meta["description"], F.lit("")),
            "tags": F.coalesce(meta["tags"], names),
            "difficulty": meta["difficulty"],
            "tools": mock_tools(steps),
            "expected": F.struct(
                inferred_answer(F.col("final_answer"), steps).alias("answer"),
                F.lit("contains").alias("answer_match"),
                F.lit(None).cast("string").alias("rubric"),
                must_call(steps).alias("must_call"),
                names.alias("must_not_call"),
                no_requirement.alias("must_call_with"),
                step_limit(steps).alias("max_steps"),
                call_limit(steps).alias("max_tool_calls"),
            ),
        }
    ).drop("steps", "final_answer", "metadata")


def generated_to_case(generated: DataFrame) -> DataFrame:
    """Test cases from parsed agent replies; call requirements without a tool are dropped, mocks stay empty."""
    names = F.array().cast("array<string>")
    requirements = F.transform(
        F.filter("must_call_with", lambda m: m["tool"].isNotNull()),
        lambda m: F.struct(
            m["tool"].alias("tool"),
            F.coalesce(m["args"], F.create_map().cast("map<string,string>")).alias("args"),
        ),
    )
    return generated.withColumns(
        {
            "tools": F.create_map().cast("map<string,struct<response_json:string,latency_ms:int,error:string>>"),
            "expected": F.struct(
                F.col("expected_answer").alias("answer"),
                F.lit("contains").alias("answer_match"),
                F.lit(None).cast("string").alias("rubric"),
                F.col("must_call"),
                names.alias("must_not_call"),
                requirements.alias("must_call_with"),
                F.col("max_steps"),
                F.lit(None).cast("int").alias("max_tool_calls"),
            ),
        }
    ).drop("expected_answer", "must_call", "must_call_with", "max_steps", "source_excerpt")
