"""Score agent trajectories: answer, tool calls, limits, efficiency, reasoning and the composite.

A case row carries its trajectory as an array of steps. Checks are higher-order array expressions on that row, so scoring
needs no explode and no shuffle; only regex expectations go through Python, whose dialect they are in.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import bounded_regex
from scorelake.functions.text import fixed, icontains, py_repr, repr_list, strip


def tool_calls(steps: Column) -> Column:
    """The tool calls of a trajectory in order."""
    return F.transform(F.filter(steps, lambda s: s["tool_call"].isNotNull()), lambda s: s["tool_call"])


def called_tools(steps: Column) -> Column:
    """Distinct names of called tools."""
    return F.array_distinct(F.transform(tool_calls(steps), lambda c: c["name"]))


def search_pattern(pattern: Column, text: Column) -> Column:
    """hit and error of a pattern in Python's dialect searched in a text; nulls for a null pattern.

    Patterns are written for Python and Java reads some of them otherwise, or refuses them and ends the job; so this is an
    Arrow function, which gets texts of rows with a pattern only. A pattern that Python refuses, or that no bounded search
    brings to an end, is no hit, with the reason in ``error``.
    """

    @F.pandas_udf("hit boolean, error string")
    def search(patterns: pd.Series, texts: pd.Series) -> pd.DataFrame:
        found = [(None, None) if p is None else bounded_regex.search(p, t or "") for p, t in zip(patterns, texts, strict=True)]
        return pd.DataFrame(found, columns=["hit", "error"])

    return search(pattern, F.when(pattern.isNotNull(), text))


def match_answer(expected: Column, match: Column, answer: Column, searched: Column | None = None) -> Column:
    """Score of the deterministic match modes. No expectation counts in full; a judged answer falls to contains.

    ``searched`` is what ``search_pattern`` gave for the rows of the regex mode; without it the pattern is searched here.
    """
    text = F.coalesce(answer, F.lit(""))
    if searched is None:
        searched = search_pattern(F.when(match == "regex", expected), text)
    hit = (
        F.when(match == "exact", strip(text) == strip(expected))
        .when(match == "regex", searched["hit"])
        .otherwise(icontains(text, expected))
    )
    return F.when(expected.isNull(), 1.0).otherwise(hit.cast("double"))


def missing_tools(must_call: Column, called: Column) -> Column:
    """Required tools that were not called; order and duplicates are kept."""
    return F.filter(must_call, lambda t: ~F.array_contains(called, t))


def forbidden_tools(must_not_call: Column, called: Column) -> Column:
    return F.filter(must_not_call, lambda t: F.array_contains(called, t))


def _args_match(required: Column, given: Column) -> Column:
    return F.forall(
        F.map_entries(required), lambda e: F.try_element_at(given, e["key"]).eqNullSafe(e["value"])
    )


def check_calls(requirements: Column, calls: Column) -> Column:
    """For each required call: tool, args, was the tool called, did one call carry the args.

    Argument values are canonical JSON text (see ``canonical_args``), an absent key equals a required null.
    """

    def check(req: Column) -> Column:
        same = F.filter(calls, lambda c: c["name"] == req["tool"])
        return F.struct(
            req["tool"].alias("tool"),
            req["args"].alias("args"),
            (F.size(same) > 0).alias("called"),
            F.exists(same, lambda c: _args_match(req["args"], c["arguments"])).alias("matched"),
        )

    return F.transform(requirements, check)


def _arg_text(value: Column) -> Column:
    text = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0]
    return (
        F.when(value.isNull(), "None")
        .when(value == "true", "True")
        .when(value == "false", "False")
        .when(F.startswith(value, F.lit('"')), py_repr(text))
        .otherwise(value)
    )


def _args_text(args: Column) -> Column:
    return F.array_join(
        F.transform(F.map_entries(args), lambda e: F.concat(e["key"], F.lit("="), _arg_text(e["value"]))), ", "
    )


def missing_args(checks: Column) -> Column:
    """Unmet call requirements as ``tool(args)`` or ``tool(not called)``."""
    return F.transform(
        F.filter(checks, lambda c: ~c["matched"]),
        lambda c: F.concat(
            c["tool"], F.lit("("), F.when(c["called"], _args_text(c["args"])).otherwise("not called"), F.lit(")")
        ),
    )


def _quoted(prefix: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(prefix), F.lit("'"), n, F.lit("'")))


def _call_reasons(checks: Column) -> Column:
    return F.transform(
        F.filter(checks, lambda c: ~c["matched"]),
        lambda c: F.when(
            c["called"],
            F.concat(
                F.lit("Tool '"), c["tool"], F.lit("' called but never with required args: "), _args_text(c["args"])
            ),
        ).otherwise(
            F.concat(F.lit("Tool '"), c["tool"], F.lit("' required by must_call_with but was never called"))
        ),
    )


def efficiency(step_count: Column, max_steps: Column) -> Column:
    """1 for a single step, falling to 0 at the step limit; 1 without a limit above one."""
    over = F.greatest(F.lit(0), step_count - 1)
    return F.when(
        max_steps > 1, F.greatest(F.lit(0.0), F.lit(1.0) - over / (max_steps - 1))
    ).otherwise(1.0)


def _score_or_reason(score: Column, limit: Column, name: str, why: Column) -> Column:
    return F.when(
        score < limit,
        F.concat(F.lit(f"{name} score "), fixed(score, 2), F.lit(" below threshold "), fixed(limit, 2), why),
    )


def score_agent(cases: DataFrame, enforce_tool_score: bool = False) -> DataFrame:
    """Add scores, details and failure reasons of each trajectory.

    Input: ``expected`` (see ``schemas.EXPECTED``), ``final_answer``, ``error``, ``thresholds`` and either ``steps`` or
    the compact form of a trajectory (``calls``, ``step_count``, ``tool_call_count``; see ``transcripts.compact``). When
    ``answer_judge`` or ``reasoning_judge`` structs (judge_score, judge_reason) are present, judged answers and
    reasoning use them. The minimum tool score fails a case only with ``enforce_tool_score``.
    """
    e, t = F.col("expected"), F.col("thresholds")
    crashed = F.coalesce(F.col("error") != "", F.lit(False))
    empty = F.array().cast("array<string>")
    has_answer_judge = "answer_judge" in cases.columns
    has_reasoning_judge = "reasoning_judge" in cases.columns

    match = F.coalesce(e["answer_match"], F.lit("contains"))
    cases = cases.withColumn("_searched", search_pattern(F.when(match == "regex", e["answer"]), F.col("final_answer")))
    searched = F.col("_searched")
    plain = match_answer(e["answer"], match, F.col("final_answer"), searched)
    bad_pattern = F.concat(F.lit("Invalid regex pattern: "), searched["error"])
    wants_judge = (match == "llm_judge") & e["answer"].isNotNull()
    no_judge_note = F.lit("llm_judge requested but no --judge-model configured; fell back to contains match")
    if has_answer_judge:
        ja = F.col("answer_judge")
        answer_score = F.when(wants_judge & ja.isNotNull(), ja["judge_score"]).otherwise(plain)
        answer_reason = F.when(wants_judge, F.coalesce(ja["judge_reason"], no_judge_note)).otherwise(F.coalesce(bad_pattern, F.lit("")))
    else:
        answer_score = plain
        answer_reason = F.when(wants_judge, no_judge_note).otherwise(F.coalesce(bad_pattern, F.lit("")))

    if has_reasoning_judge:
        jr = F.col("reasoning_judge")
        judged = t["min_reasoning_score"].isNotNull() & jr.isNotNull()
        reasoning_score = F.when(judged, jr["judge_score"])
        reasoning_reason = F.when(judged, jr["judge_reason"])
    else:
        reasoning_score = F.lit(None).cast("double")
        reasoning_reason = F.lit(None).cast("string")

    if "steps" in cases.columns:
        steps = F.coalesce("steps", F.array().cast(cases.schema["steps"].dataType))
        cases = cases.withColumns({"step_count": F.size(steps), "calls": tool_calls(steps)}).withColumn(
            "tool_call_count", F.size("calls")
        )
    requirement_type = cases.schema["expected"].dataType["must_call_with"].dataType
    df = cases.withColumns(
        {
            "_must": F.coalesce(e["must_call"], empty),
            "_must_not": F.coalesce(e["must_not_call"], empty),
            "_called": F.array_distinct(F.transform("calls", lambda c: c["name"])),
            "_checks": check_calls(
                F.coalesce(e["must_call_with"], F.array().cast(requirement_type)), F.col("calls")
            ),
        }
    )
    df = df.withColumns(
        {
            "missing_tools": missing_tools(F.col("_must"), F.col("_called")),
            "forbidden_tools_found": forbidden_tools(F.col("_must_not"), F.col("_called")),
            "missing_args": missing_args(F.col("_checks")),
            "answer_score": answer_score,
            "answer_reason": answer_reason,
            "reasoning_score": reasoning_score,
            "reasoning_reason": reasoning_reason,
            "efficiency_score": efficiency(F.col("step_count"), e["max_steps"]),
        }
    )
    total_checks = F.size("_must") + F.size("_must_not") + F.size("_checks")
    unmet = F.size("missing_tools") + F.size("forbidden_tools_found") + F.size("missing_args")
    df = df.withColumn(
        "tool_score",
        F.when(total_checks == 0, 1.0).otherwise(
            F.greatest(F.lit(0.0), F.lit(1.0) - unmet / F.nullif(total_checks, F.lit(0)))
        ),
    )
    answer_why = F.when(F.col("answer_reason") != "", F.concat(F.lit(": "), "answer_reason")).otherwise("")
    # The wording of failure reasons.
    reasons = F.concat(
        F.array_compact(F.array(_score_or_reason(F.col("answer_score"), t["min_answer_score"], "Answer", answer_why))),
        _quoted("Required tool not called: ", F.col("missing_tools")),
        _quoted("Forbidden tool was called: ", F.col("forbidden_tools_found")),
        _call_reasons(F.col("_checks")),
        F.array_compact(
            F.array(
                F.when(
                    F.lit(enforce_tool_score) & (F.col("tool_score") < t["min_tool_score"]),
                    F.concat(
                        F.lit("Tool score "), fixed(F.col("tool_score"), 2),
                        F.lit(" below threshold "), fixed(t["min_tool_score"], 2),
                    ),
                ),
                F.when(
                    F.col("step_count") > e["max_steps"],
                    F.concat(
                        F.lit("Step count "), F.col("step_count").cast("string"),
                        F.lit(" exceeds max "), e["max_steps"].cast("string"),
                    ),
                ),
                F.when(
                    F.col("tool_call_count") > e["max_tool_calls"],
                    F.concat(
                        F.lit("Tool call count "), F.col("tool_call_count").cast("string"),
                        F.lit(" exceeds max "), e["max_tool_calls"].cast("string"),
                    ),
                ),
                _score_or_reason(
                    F.col("reasoning_score"), t["min_reasoning_score"], "Reasoning",
                    F.concat(F.lit(": "), "reasoning_reason"),
                ),
            )
        ),
    )
    rs = F.col("reasoning_score")
    rw = F.when(rs.isNull(), 0.0).otherwise(t["reasoning_weight"])
    weights = t["answer_weight"] + t["tool_weight"] + rw + t["efficiency_weight"]
    weighted = (
        F.col("answer_score") * t["answer_weight"]
        + F.col("tool_score") * t["tool_weight"]
        + F.coalesce(rs, F.lit(0.0)) * rw
        + F.col("efficiency_score") * t["efficiency_weight"]
    )
    df = df.withColumns(
        {
            "composite_score": F.when(weights > 0, weighted / F.nullif(weights, F.lit(0.0))).otherwise(0.0),
            "failure_reasons": reasons,
        }
    )

    # A crashed agent keeps its counts; everything else is fixed.
    def unless_crashed(name: str, value: Column) -> Column:
        return F.when(crashed, value).otherwise(F.col(name))

    df = df.withColumns(
        {
            **{n: unless_crashed(n, F.lit(0.0)) for n in ("answer_score", "tool_score", "composite_score")},
            "efficiency_score": unless_crashed("efficiency_score", F.lit(1.0)),
            "reasoning_score": F.when(~crashed, F.col("reasoning_score")),
            "answer_reason": unless_crashed("answer_reason", F.lit("")),
            **{n: unless_crashed(n, empty) for n in ("missing_tools", "forbidden_tools_found", "missing_args")},
            "failure_reasons": unless_crashed(
                "failure_reasons", F.array(F.concat(F.lit("Agent error: "), "error"))
            ),
        }
    )
    return df.withColumn("passed", F.size("failure_reasons") == 0).drop(
        "calls", "_called", "_checks", "_must", "_must_not", "_searched"
    )


def case_latency(total_latency: Column, elapsed: Column) -> Column:
    """Latency the trajectory reports, else the measured one."""
    return F.coalesce(F.nullif(total_latency, F.lit(0)), elapsed, F.lit(0))


def bad_patterns(cases: DataFrame) -> DataFrame:
    """Cases whose regex expectation is no pattern, with the reason in ``pattern_error``. Scoring fails them one by one."""
    e = F.col("expected")
    found = cases.withColumn("_searched", search_pattern(F.when(e["answer_match"] == "regex", e["answer"]), F.lit("")))
    return found.withColumn("pattern_error", F.col("_searched.error")).drop("_searched").filter(F.col("pattern_error").isNotNull())


def resolve_tool_calls(steps: Column, mocks: Column) -> Column:
    """Fill result or error of each call from the mocks of its case.

    A mock with an error gives that error, a known tool its response, an unknown tool the list of available ones.
    """
    names = F.map_keys(mocks)

    def answer(step: Column) -> Column:
        call = step["tool_call"]
        mock = F.try_element_at(mocks, call["name"])
        known = F.array_contains(names, call["name"])
        error = (
            F.when(
                ~known,
                F.concat(
                    F.lit("Tool '"), call["name"], F.lit("' is not defined in this test case. Available: "),
                    repr_list(names),
                ),
            )
            .when(mock["error"] != "", mock["error"])
        )
        filled = call.withField("error", error).withField(
            "result_json", F.when(error.isNull(), F.coalesce(mock["response_json"], F.lit("null")))
        )
        return F.when(call.isNull(), step).otherwise(step.withField("tool_call", filled))

    return F.transform(steps, answer)
