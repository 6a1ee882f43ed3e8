"""Render prompts and readable texts from case columns.

The short default prompts and the stand-in texts are fixed values. The long judge and generation prompts are this
project's own wording around the same inputs, labels and reply format; each takes a ``template`` to use another.
Placeholders are written ``{name}``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.keys import json_map_text
from scorelake.functions.scales import METRIC_SCALES
from scorelake.functions.text import ascii_json

# Default prompts of the three plain dataset types and of retrieval cases.
QA_PROMPT = "Answer the following question accurately and concisely.\n\nQuestion: {query}"
CLASSIFICATION_PROMPT = (
    "Classify the following text into exactly one of these categories: {labels}.\n"
    "Respond with only the category name, nothing else.\n\nText: {text}"
)
INSTRUCTION_PROMPT = "{instruction}{document_block}"
RAG_PROMPT = (
    "Answer the question using ONLY the provided context documents.\n"
    "If the answer cannot be found in the context, say \"I don't know.\"\n\n"
    "Context documents:\n{contexts}\n\nQuestion: {query}"
)
# Texts that stand in for something empty.
NO_LABELS = "unknown"
NO_CONTEXTS_PROMPT = "(no context documents provided)"
NO_CONTEXTS_JUDGE = "(no contexts provided)"
NO_ANSWER = "(no answer given)"
NO_STEPS = "(no steps)"
NO_TOOLS = "  (no tools defined — all tasks will use generic tool usage)"
NO_LABEL_LIST = "(not specified)"

_REPLY = 'Reply with one JSON object and nothing else: {"reasoning": "<short>", "answer": "<%s>"}'


def _judge_template(question: str, metric: str, *sections: str) -> str:
    parts = [question, *sections, _REPLY % "|".join(METRIC_SCALES[metric])]
    return "\n\n".join(parts)


RAG_JUDGE_TEMPLATES = {
    "faithfulness": _judge_template(
        "Rate how far the answer rests on the context documents and on nothing else.",
        "faithfulness",
        "Question:\n{query}",
        "Context documents:\n{contexts}",
        "Answer:\n{answer}",
    ),
    "answer_correctness": _judge_template(
        "Rate whether the answer agrees with the expected one.",
        "answer_correctness",
        "Question:\n{query}",
        "Expected answer:\n{ground_truth}",
        "Answer:\n{answer}",
    ),
}
AGENT_JUDGE_TEMPLATES = {
    "correctness": _judge_template(
        "Rate whether the final answer of the agent is right.",
        "correctness",
        "Task:\n{task}",
        "Final answer:\n{final_answer}{expected_section}{rubric_section}",
    ),
    "completeness": _judge_template(
        "Rate whether the final answer covers all the task asks for.",
        "completeness",
        "Task:\n{task}",
        "Final answer:\n{final_answer}{expected_section}",
    ),
    "helpfulness": _judge_template(
        "Rate how much the final answer helps the user with the task.",
        "helpfulness",
        "Task:\n{task}",
        "Final answer:\n{final_answer}{expected_section}",
    ),
    "faithfulness": _judge_template(
        "Rate how far the final answer rests on what the tools returned.",
        "faithfulness",
        "Task:\n{task}",
        "Trajectory:\n{trajectory}",
        "Final answer:\n{final_answer}",
    ),
    "logical_coherence": _judge_template(
        "Rate whether every step follows from the ones before it.",
        "logical_coherence",
        "Task:\n{task}",
        "Trajectory:\n{trajectory}",
    ),
}
_CASE_FORMAT = (
    "Return a JSON array. Each element has description, input ({inputs}), expected ({expected}), tags, "
    "difficulty (easy|medium|hard), case_type ({case_types}) and source_excerpt (a quote of at most 200 characters)."
)


def _generation_template(kind: str, inputs: str, expected: str, case_types: str, extra: str = "") -> str:
    form = _CASE_FORMAT.replace("{inputs}", inputs).replace("{expected}", expected).replace("{case_types}", case_types)
    return f"Write {{count}} {kind} test cases from the document.{extra}\n\n{form}\n\nDocument {{filename}}:\n{{document}}"


GENERATION_TEMPLATES = {
    "qa": _generation_template(
        "question-answer", "query", "ground_truth", "factual|multi_hop|negation|out_of_scope|ambiguous",
        "\nMix of case types:\n{mix}",
    ),
    "classification": _generation_template(
        "classification", "text", "label", "clear|ambiguous|edge_case", "\nValid labels: {labels}"
    ),
    "instruction": _generation_template(
        "instruction-following", "instruction, document", "rubric",
        "summarization|extraction|formatting|analysis|comparison",
    ),
    "rag": _generation_template(
        "retrieval", "query, retrieved_contexts", "ground_truth", "direct|inference|multi_hop"
    ),
}
AGENT_GENERATION_TEMPLATE = (
    "Write {count} tasks for an agent with these tools, answerable from the document.\n\nTools:\n{tools}\n\n"
    "Return a JSON array. Each element has task, description, expected_answer, must_call, must_call_with "
    "(tool, args), max_steps, difficulty (easy|medium|hard), tags and source_excerpt.\n\n"
    "Document {filename}:\n{document}"
)

# Share of each case type in a generated question-answer set.
CASE_MIX = {"factual": 0.40, "multi_hop": 0.20, "negation": 0.15, "out_of_scope": 0.15, "ambiguous": 0.10}


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """Concatenate the template's text with column values. Values are never scanned for placeholders."""
    parts = re.split(r"\{(" + "|".join(map(re.escape, values)) + r")\}", template)
    pieces = [F.lit(p) if i % 2 == 0 else F.coalesce(values[p], F.lit("")) for i, p in enumerate(parts) if p]
    return F.concat(*pieces)


def default_prompt(kind: Column, input_: Column, labels: Column, template: Column | None = None) -> Column:
    """Prompt of a plain case. ``template`` is a column with a custom one, used where it is not null."""
    document = input_["document"]
    block = F.when(document != "", F.concat(F.lit("\n\n---\n"), document)).otherwise("")
    label_text = F.when(F.size(labels) > 0, F.array_join(labels, ", ")).otherwise(NO_LABELS)
    built = (
        F.when(kind == "qa", fill(QA_PROMPT, {"query": input_["query"]}))
        .when(kind == "classification", fill(CLASSIFICATION_PROMPT, {"labels": label_text, "text": input_["text"]}))
        .when(
            kind == "instruction",
            fill(INSTRUCTION_PROMPT, {"instruction": input_["instruction"], "document_block": block}),
        )
    )
    return built if template is None else F.coalesce(template, built)


def numbered_contexts(contexts: Column, empty: str = NO_CONTEXTS_PROMPT) -> Column:
    lines = F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c))
    return F.when(F.size(contexts) > 0, F.array_join(lines, "\n\n")).otherwise(empty)


def rag_prompt(query: Column, contexts: Column, template: str = RAG_PROMPT) -> Column:
    return fill(template, {"query": query, "contexts": numbered_contexts(contexts)})


def _one_row_per_metric(df: DataFrame, prompts: Mapping[str, Column]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), p.alias("prompt")) for m, p in prompts.items()])
    return df.withColumn("_p", F.explode(pairs)).withColumns({"metric": F.col("_p.metric"), "prompt": F.col("_p.prompt")}).drop("_p")


def rag_judge_prompts(cases: DataFrame, templates: Mapping[str, str] = RAG_JUDGE_TEMPLATES) -> DataFrame:
    """Two rows per case with ``metric`` and ``prompt``."""
    values = {
        "query": F.col("query"),
        "contexts": numbered_contexts(F.col("contexts"), NO_CONTEXTS_JUDGE),
        "answer": F.col("answer"),
        "ground_truth": F.col("ground_truth"),
    }
    return _one_row_per_metric(cases, {m: fill(t, values) for m, t in templates.items()})


def trajectory_text(steps: Column) -> Column:
    """Numbered lines of a trajectory; a tool call shows its arguments and its result or error."""

    def line(step: Column, i: Column) -> Column:
        call = step["tool_call"]
        head = F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(" ["))
        outcome = F.when(call["error"] != "", F.concat(F.lit("ERROR: "), call["error"])).otherwise(
            ascii_json(F.coalesce(call["result_json"], F.lit("null")))
        )
        with_call = F.concat(
            head, F.lit("tool_call] "), call["name"], F.lit("("), ascii_json(json_map_text(call["arguments"])),
            F.lit(")\n  → "), outcome,
        )
        plain = F.concat(head, step["type"], F.lit("] "), F.coalesce(step["content"], F.lit("")))
        return F.when(call.isNotNull(), with_call).otherwise(plain)

    return F.when(F.size(steps) > 0, F.array_join(F.transform(steps, line), "\n")).otherwise(NO_STEPS)


def agent_judge_prompts(
    cases: DataFrame, reasoning: bool = True, templates: Mapping[str, str] = AGENT_JUDGE_TEMPLATES
) -> DataFrame:
    """Rows per case with ``metric`` and ``prompt``: three for the answer and, if wanted, two for the reasoning."""

    def section(title: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"\n\n{title}:\n"), value)).otherwise("")

    e = F.col("expected")
    values = {
        "task": F.col("task"),
        "final_answer": F.coalesce(F.nullif("final_answer", F.lit("")), F.lit(NO_ANSWER)),
        "expected_section": section("Expected answer", e["answer"]),
        "rubric_section": section("Rubric", e["rubric"]),
        "trajectory": trajectory_text(F.col("steps")),
    }
    wanted = templates if reasoning else {
        m: t for m, t in templates.items() if m in ("correctness", "completeness", "helpfulness")
    }
    return _one_row_per_metric(cases, {m: fill(t, values) for m, t in wanted.items()})


def case_mix(count: Column, mix: Mapping[str, float] = CASE_MIX) -> Column:
    """Number of cases per type, rounded down, as an array in the order of the mix."""
    return F.array(
        *[
            F.struct(
                F.lit(k).alias("case_type"),
                F.floor(F.lit(v) * count.cast("double")).cast("int").alias("cases"),
                F.lit(int(v * 100)).alias("percent"),
            )
            for k, v in mix.items()
        ]
    )


def mix_lines(count: Column, mix: Mapping[str, float] = CASE_MIX) -> Column:
    return F.array_join(
        F.transform(
            case_mix(count, mix),
            lambda m: F.concat(
                F.lit("  - "), m["case_type"], F.lit(": ~"), m["cases"].cast("string"), F.lit(" cases ("),
                m["percent"].cast("string"), F.lit("%)"),
            ),
        ),
        "\n",
    )


def generation_prompt(
    kind: Column, document: Column, filename: Column, count: Column, labels: Column,
    templates: Mapping[str, str] = GENERATION_TEMPLATES,
) -> Column:
    """Prompt that asks for test cases from a document; unknown kinds get the question-answer form."""
    values = {
        "document": document,
        "filename": filename,
        "count": count.cast("string"),
        "labels": F.when(F.size(labels) > 0, F.array_join(labels, ", ")).otherwise(NO_LABEL_LIST),
        "mix": mix_lines(count),
    }
    special = [F.when(kind == k, fill(t, values)) for k, t in templates.items() if k != "qa"]
    return F.coalesce(*special, fill(templates["qa"], values))


def tool_catalog_text(tools: Column) -> Column:
    """Readable list of tools (name, description, parameters_json)."""
    block = F.transform(
        tools,
        lambda t: F.concat(
            F.lit("  Tool: "), t["name"], F.lit("\n  Description: "), t["description"],
            F.when(
                F.coalesce(~t["parameters_json"].isin("", "{}"), F.lit(False)),
                F.concat(F.lit("\n  Parameters: "), ascii_json(t["parameters_json"])),
            ).otherwise(""),
            F.lit("\n"),
        ),
    )
    return F.when(F.size(tools) > 0, F.trim(F.btrim(F.array_join(block, "\n"), F.lit(" \n")))).otherwise(NO_TOOLS)


def agent_generation_prompt(
    document: Column, filename: Column, count: Column, tools: Column, template: str = AGENT_GENERATION_TEMPLATE
) -> Column:
    return fill(
        template,
        {"document": document, "filename": filename, "count": count.cast("string"), "tools": tool_catalog_text(tools)},
    )


def explode_mix(df: DataFrame, count: str, mix: Mapping[str, float] = CASE_MIX) -> DataFrame:
    """One row per input row and case type with its share of ``count``."""
    rows: Sequence[Column] = [c for c in map(F.col, df.columns)]
    exploded = df.select(*rows, F.explode(case_mix(F.col(count), mix)).alias("_m"))
    return exploded.select(*rows, F.col("_m.case_type").alias("case_type"), F.col("_m.cases").alias("cases"))
