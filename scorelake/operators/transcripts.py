"""Turn model transcripts and agent event logs into trajectory steps.

Steps come out as rows, one per step, so a transcript of any length spreads over tasks. ``assemble`` gathers them into
the one-row-per-case form that scoring takes, where a trajectory is a single value by definition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.json_values import json_value
from scorelake.functions.staging import stage
from scorelake.functions.text import strip
from scorelake.operators.agent import resolve_tool_calls
from scorelake.schemas import STEP, TOOL_CALL


# Wording of steps made from transcripts and event logs.
CALLING, INVOKING, ERROR = "Calling ", "Invoking ", "Error: "
BAD_CALL = "[parse error in tool call: not a JSON object]"
NO_ANSWER = "Reached max iterations ({n}) without producing an answer"


def _tagged(text: Column, tag: str) -> Column:
    """Content of the first ``<tag>`` block, stripped; null without one."""
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(F.rlike(text, F.lit(pattern)), strip(F.regexp_extract(text, pattern, 1)))


def argument_map(text: Column) -> Column:
    """Tool arguments given as text: a JSON object as canonical values, anything else under ``input``."""
    parsed = json_value(text)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))
    values = F.transform_values(
        F.when(is_object, parsed).cast("map<string,variant>"), lambda _, v: F.nullif(F.to_json(v), F.lit("null"))
    )
    as_text = F.to_json(F.array(text))
    return F.when(is_object, values).otherwise(
        F.create_map(F.lit("input"), F.substring(as_text, F.lit(2), F.length(as_text) - 2))
    )


def _step(kind: str, content: Column, call: Column | None = None, latency: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        content.alias("content"),
        (F.lit(None) if call is None else call).cast(TOOL_CALL).alias("tool_call"),
        (F.lit(0) if latency is None else latency).cast("int").alias("latency_ms"),
        F.lit(0).alias("tokens"),
        F.lit(0.0).alias("cost_usd"),
    ).cast(STEP)


def transcript_steps(turns: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Steps of tagged model turns up to and including the first answer.

    Input: the keys, ``turn``, ``text``, ``latency_ms`` and ``tools`` (the mocks of the case). Output: the keys,
    ``turn``, ``pos`` and ``step``. The first answering turn is a minimum per case, joined back; no case is gathered.
    """
    first = (
        turns.filter(F.rlike("text", F.lit("(?s)<answer>.*?</answer>")))
        .groupBy(*keys)
        .agg(F.min("turn").alias("_stop"))
    )
    kept = turns.join(first, list(keys), "left").filter(F.col("_stop").isNull() | (F.col("turn") <= F.col("_stop")))
    text, latency = F.col("text"), F.col("latency_ms")
    thought, call_text, answer = (_tagged(text, t) for t in ("thought", "tool_call", "answer"))
    kept = stage(stage(kept, "_call_text", call_text), "_call", json_value("_call_text"))
    parsed = F.col("_call")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))
    name = F.coalesce(F.try_variant_get(parsed, "$.name", "string"), F.lit(""))
    arguments = F.transform_values(
        F.try_variant_get(parsed, "$.arguments", "map<string,variant>"),
        lambda _, v: F.nullif(F.to_json(v), F.lit("null")),
    )
    bare_call = F.struct(
        name.alias("name"),
        F.coalesce(arguments, F.create_map().cast("map<string,string>")).alias("arguments"),
        F.lit(None).cast("string").alias("result_json"),
        F.lit(None).cast("string").alias("error"),
        F.lit(0).alias("latency_ms"),
    )
    staged = kept.withColumns({"_thought": thought, "_answer": answer, "_ok": is_object})
    staged = stage(
        staged,
        "_called",
        F.when(
            F.col("_ok"),
            resolve_tool_calls(F.array(_step("tool_call", F.concat(F.lit(CALLING), name), bare_call)), F.col("tools"))[0],
        ),
    )
    called = F.col("_called")
    failed = called["tool_call"]["error"].isNotNull()
    seen = F.when(failed, F.concat(F.lit(ERROR), called["tool_call"]["error"])).otherwise(
        called["tool_call"]["result_json"]
    )
    steps = F.array_compact(
        F.array(
            F.when(F.col("_thought").isNotNull(), _step("thought", F.col("_thought"), latency=latency)),
            called,
            F.when(called.isNotNull(), _step("observation", seen)),
            F.when(
                F.col("_call_text").isNotNull() & ~F.col("_ok"),
                _step("thought", F.lit(BAD_CALL)),
            ),
            F.when(F.col("_answer").isNotNull(), _step("answer", F.col("_answer"), latency=latency)),
        )
    )
    rows = stage(staged, "_steps", steps)
    return rows.select(*keys, "turn", F.posexplode("_steps").alias("pos", "step"))


def transcript_outcomes(turns: DataFrame, max_iterations: int, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Final answer or error, and total latency, of each transcript."""
    answered = turns.withColumn("_answer", _tagged(F.col("text"), "answer"))
    first = answered.filter(F.col("_answer").isNotNull()).groupBy(*keys).agg(
        F.min(F.struct("turn", "_answer")).alias("_first")
    )
    joined = answered.select(*keys, "turn", "latency_ms").join(first, list(keys), "left")
    upto = F.col("_first").isNull() | (F.col("turn") <= F.col("_first.turn"))
    return (
        joined.filter(upto)
        .groupBy(*keys)
        .agg(F.first("_first").alias("_first"), F.sum("latency_ms").alias("total_latency_ms"))
        .select(
            *keys,
            F.col("_first._answer").alias("final_answer"),
            "total_latency_ms",
            F.when(
                F.col("_first").isNull(),
                F.lit(NO_ANSWER.replace("{n}", str(max_iterations))),
            ).alias("error"),
        )
    )


def event_log_steps(events: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Steps of agent events given as JSON text in ``event``; ``ord`` orders them.

    A rationale is a thought, an action input a tool call, an action output an observation; one event can hold all
    three, in that order.
    """
    trace = F.try_variant_get(json_value("event"), "$.trace.trace.orchestrationTrace", "variant")
    staged = stage(events.select(*keys, F.col("ord").alias("turn"), "event"), "_trace", trace)

    def at(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("_trace", f"$.{path}", kind)

    def filled(shape: Column) -> Column:
        return F.coalesce(F.startswith(shape, F.lit("OBJECT")) & (shape != "OBJECT<>"), F.lit(False))

    action, output = "invocationInput.actionGroupInvocationInput", "observation.actionGroupInvocationOutput"
    name = F.coalesce(at(f"{action}.actionGroupName"), F.lit(""))
    arguments = F.transform_values(
        at(f"{action}.requestBody.content", "map<string,variant>"),
        lambda _, v: F.nullif(F.to_json(v), F.lit("null")),
    )
    call = F.struct(
        name.alias("name"),
        F.coalesce(arguments, F.create_map().cast("map<string,string>")).alias("arguments"),
        F.lit(None).cast("string").alias("result_json"),
        F.lit(None).cast("string").alias("error"),
        F.lit(0).alias("latency_ms"),
    )
    steps = F.array_compact(
        F.array(
            F.when(
                at("rationale", "variant").isNotNull(),
                _step("thought", F.coalesce(at("rationale.text"), F.lit(""))),
            ),
            F.when(
                filled(F.schema_of_variant(at(action, "variant"))),
                _step("tool_call", F.concat(F.lit(INVOKING), name), call),
            ),
            F.when(
                filled(F.schema_of_variant(at(output, "variant"))),
                _step("observation", F.coalesce(at(f"{output}.text"), F.lit(""))),
            ),
        )
    )
    rows = stage(staged.filter(F.col("_trace").isNotNull()), "_steps", steps)
    return rows.select(*keys, "turn", F.posexplode("_steps").alias("pos", "step"))


def event_log_answers(events: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Final answer per case: its text chunks joined in order, null when they are empty. One aggregation."""
    chunks = stage(
        events.select(*keys, "ord", "event"),
        "_chunk",
        F.try_variant_get(json_value("event"), "$.chunk.bytes", "string"),
    )
    parts = F.array_sort(F.collect_list(F.when(F.col("_chunk") != "", F.struct("ord", "_chunk"))))
    text = F.array_join(F.transform(parts, lambda p: p["_chunk"]), "")
    return chunks.groupBy(*keys).agg(F.nullif(text, F.lit("")).alias("final_answer"))


def with_answer_steps(steps: DataFrame, answers: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Append the final answer of each case as its last step."""
    last = answers.filter(F.col("final_answer").isNotNull()).select(
        *keys, F.lit(2**62).alias("turn"), F.lit(0).alias("pos"), _step("answer", F.col("final_answer")).alias("step")
    )
    return steps.unionByName(last)


def compact(steps: DataFrame, keys: Sequence[str] = ("case_id",), *more: Column) -> DataFrame:
    """What scoring needs of each trajectory, without gathering its steps; ``more`` aggregates join the same pass.

    Counts of steps and calls, and the distinct calls (name and arguments): repeated calls cannot change a check. All
    three combine on the map side, so a trajectory of any length costs its distinct calls.
    """
    call = F.col("step.tool_call")
    distinct = F.collect_set(
        F.when(
            call.isNotNull(),
            F.struct(call["name"].alias("name"), F.array_sort(F.map_entries(call["arguments"])).alias("entries")),
        )
    )
    return steps.groupBy(*keys).agg(
        F.count("*").cast("int").alias("step_count"),
        F.count(call["name"]).cast("int").alias("tool_call_count"),
        F.transform(
            distinct,
            lambda c: F.struct(c["name"].alias("name"), F.map_from_entries(c["entries"]).alias("arguments")),
        ).alias("calls"),
        *more,
    )


def assemble(steps: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """One row per case with the ordered ``steps`` array."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "pos", "step")), _by_position)
    return steps.groupBy(*keys).agg(F.transform(ordered, lambda s: s["step"]).alias("steps"))


def _by_position(a: Column, b: Column) -> Column:
    return (
        F.when(a["turn"] < b["turn"], -1)
        .when(a["turn"] > b["turn"], 1)
        .when(a["pos"] < b["pos"], -1)
        .when(a["pos"] > b["pos"], 1)
        .otherwise(0)
    )
