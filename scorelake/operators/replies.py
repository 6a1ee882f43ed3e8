"""Parse generated test cases out of model replies, and bring staged cases into importable form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.json_values import elements, json_value, spelled
from scorelake.functions.staging import stage
from scorelake.functions.text import strip_fence_lines
from scorelake.schemas import CALL_REQUIREMENT

_ITEM = (
    "struct<description:string,input:string,expected:string,tags:array<string>,difficulty:string,"
    "case_type:string,source_excerpt:string>"
)
_AGENT_ITEM = (
    "struct<task:string,description:string,expected_answer:string,must_call:array<string>,"
    f"must_call_with:array<{CALL_REQUIREMENT}>,max_steps:string,difficulty:string,tags:array<string>,"
    "source_excerpt:string>"
)


def _explode(replies: DataFrame, item: str) -> DataFrame:
    """One row per element that is an object, with ``item_no`` and the parsed struct ``_item``.

    Elements are cut out as text, so that nested values keep their spelling and the order of their keys.
    """
    staged = stage(replies, "_elements", elements(strip_fence_lines("raw_text")))
    kept = [c for c in replies.columns if c != "raw_text"]
    rows = staged.select(*kept, F.posexplode("_elements").alias("item_no", "_element"))
    objects = rows.filter(F.startswith("_element", F.lit("{")))
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    return stage(objects, "_item", F.from_json("_element", item, strict)).drop("_element").filter(F.col("_item").isNotNull())


def reply_errors(replies: DataFrame) -> DataFrame:
    """Replies that are no JSON, with the first 500 characters of their text."""
    staged = stage(replies, "_doc", json_value(strip_fence_lines("raw_text")))
    return staged.filter(F.col("_doc").isNull()).select(
        *[c for c in replies.columns if c != "raw_text"],
        F.concat(
            F.lit("Generator returned invalid JSON\n\nRaw output (first 500 chars):\n"), F.substring("raw_text", 1, 500)
        ).alias("error"),
    )


def parse_generated(replies: DataFrame) -> DataFrame:
    """Generated cases, one row each. Elements without ``input`` or ``expected`` are skipped, gaps get defaults.

    ``input`` and ``expected`` stay JSON text, NaN and infinities in them included. Replies that are no JSON give no rows;
    ``reply_errors`` lists exactly those.
    """
    rows = _explode(replies, _ITEM)
    item = F.col("_item")
    return rows.filter(item["input"].isNotNull() & item["expected"].isNotNull()).select(
        *[c for c in rows.columns if c != "_item"],
        F.coalesce(spelled(item["description"]), F.lit("")).alias("description"),
        spelled(item["input"]).alias("input"),
        spelled(item["expected"]).alias("expected"),
        F.coalesce(F.transform(item["tags"], spelled), F.array().cast("array<string>")).alias("tags"),
        F.coalesce(spelled(item["difficulty"]), F.lit("medium")).alias("difficulty"),
        F.coalesce(spelled(item["case_type"]), F.lit("factual")).alias("case_type"),
        F.coalesce(spelled(item["source_excerpt"]), F.lit("")).alias("source_excerpt"),
    )


def parse_generated_agent(replies: DataFrame) -> DataFrame:
    """Generated agent tasks, one row each. A reply that is no JSON array gives no rows, elements need a task."""
    rows = _explode(replies, _AGENT_ITEM)
    item = F.col("_item")
    steps = F.coalesce(item["max_steps"].try_cast("double").cast("int"), F.lit(6))
    return rows.filter(item["task"].isNotNull()).select(
        *[c for c in rows.columns if c != "_item"],
        spelled(item["task"]).alias("task"),
        F.coalesce(spelled(item["description"]), F.lit("")).alias("description"),
        spelled(item["expected_answer"]).alias("expected_answer"),
        F.coalesce(item["must_call"], F.array().cast("array<string>")).alias("must_call"),
        F.coalesce(item["must_call_with"], F.array().cast(f"array<{CALL_REQUIREMENT}>")).alias("must_call_with"),
        steps.alias("max_steps"),
        F.coalesce(item["difficulty"], F.lit("medium")).alias("difficulty"),
        F.coalesce(item["tags"], F.array().cast("array<string>")).alias("tags"),
        F.coalesce(item["source_excerpt"], F.lit("")).alias("source_excerpt"),
    )


def importable(staged: DataFrame) -> DataFrame:
    """Staged cases without the columns that only help the review."""
    return staged.drop("case_type", "source_excerpt")
