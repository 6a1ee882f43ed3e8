"""Read raw runner output and traces, write run results."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.json_values import json_value
from scorelake.functions.keys import short_hash, with_canonical_json
from scorelake.functions.staging import let, stage
from scorelake.functions.text import lstrip, py_round, strip
from scorelake.operators.display import provider_id
from scorelake.operators.summary import RESULT_DIGITS, rounded
from scorelake.session import materialize
from scorelake.sources import commits
from scorelake.sources.json_splits import BROADCAST_SPLITS, split_documents

_ITEM = "struct<vars:string,success:string,score:double,latencyMs:double,cost:double,provider:string>"
_STATS = "struct<total:long,prompt:long,completion:long>"


def parse_results(outputs: DataFrame) -> DataFrame:
    """Raw result rows from runner output in ``json``, one document per run.

    Accepts ``{results: {results: [..]}}``, ``{results: [..]}`` and a bare list. Missing fields get their defaults: not
    passed, score 1 or 0 by success, no latency, no cost.
    """
    text = F.when(F.startswith(lstrip("json"), F.lit("[")), F.col("json")).otherwise(
        F.coalesce(F.get_json_object("json", "$.results.results"), F.get_json_object("json", "$.results"))
    )
    keys = [c for c in outputs.columns if c != "json"]
    # An object in place of the list holds no results; from_json would take it for a list of one.
    listed = let(lstrip(text), lambda t: F.when(F.startswith(t, F.lit("[")), t))
    staged = stage(outputs, "_items", F.from_json(listed, f"array<{_ITEM}>"))
    return _typed_results(staged.select(*keys, F.posexplode("_items").alias("ord", "_i")), keys)


def _typed_results(rows: DataFrame, keys: list[str]) -> DataFrame:
    rows = rows.filter(F.col("_i").isNotNull())
    success = F.coalesce(F.col("_i.success"), F.lit("false")) == "true"
    rows = with_canonical_json(rows, "_vars", F.coalesce(F.col("_i.vars"), F.lit("{}")))
    return rows.select(
        *keys,
        F.col("ord").cast("long").alias("ord"),
        provider_id(F.coalesce("_i.provider", F.lit(""))).alias("provider"),
        F.col("_vars").alias("vars_json"),
        short_hash(F.col("_vars")).alias("key"),
        success.alias("success"),
        F.coalesce("_i.score", F.when(success, 1.0).otherwise(0.0)).alias("score"),
        F.coalesce(F.col("_i.latencyMs").cast("int"), F.lit(0)).alias("latency_ms"),
        F.coalesce("_i.cost", F.lit(0.0)).alias("cost_usd"),
    )


def load_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Raw result rows and token counts of all runner output below a path, however large its files.

    As ``parse_results`` and ``parse_token_stats`` of ``read_outputs``, but a file is read by as many tasks as it has splits. A file that is
    no JSON, in any of its parts, gives no rows and no counts.
    """
    elements, shells = split_documents(spark, path)
    elements = materialize(stage(elements, "_known", json_value("element").isNotNull()))
    checked = elements.groupBy("file_path").agg(F.bool_and("_known").alias("_whole"))
    shells = shells.join(checked, "file_path", "left")
    fine = F.coalesce(F.col("_whole"), F.lit(True)) & json_value("shell").isNotNull()
    shells = materialize(shells.select("file_path", "shell", fine.alias("_fine")))
    broken = shells.filter(~F.col("_fine")).select("file_path")
    count = broken.count()
    if count:
        elements = elements.join(F.broadcast(broken) if count <= BROADCAST_SPLITS else broken, "file_path", "left_anti")
    objects = elements.filter(F.startswith(lstrip("element"), F.lit("{")))
    rows = stage(objects.select(*_run_of("file_path"), "ord", "element"), "_i", F.from_json("element", _ITEM))
    stats = shells.filter("_fine").select(*_run_of("file_path"), F.col("shell").alias("json"))
    return _typed_results(rows, ["run_id", "dataset"]), parse_token_stats(stats)


def parse_token_stats(outputs: DataFrame) -> DataFrame:
    """Token counts of each runner output, zero where absent."""
    usage = F.from_json(F.get_json_object("json", "$.results.stats.tokenUsage"), _STATS)
    keys = [c for c in outputs.columns if c != "json"]
    return outputs.select(
        *keys,
        F.coalesce(usage["total"], F.lit(0)).alias("total_tokens"),
        F.coalesce(usage["prompt"], F.lit(0)).alias("prompt_tokens"),
        F.coalesce(usage["completion"], F.lit(0)).alias("completion_tokens"),
    )


_TRACE_STEP = "struct<type:string,content:string,tool:string,arguments:string,result:string>"
_TRACE = (
    f"struct<task:string,steps:array<{_TRACE_STEP}>,final_answer:string,"
    "metadata:struct<description:string,difficulty:string,tags:array<string>>>"
)
# Step types of a trace.
STEP_TYPES = ("thought", "tool_call", "observation", "answer")


def validate_traces(lines: DataFrame) -> DataFrame:
    """Add ``error`` to trace lines: null for a valid one."""
    staged = stage(lines, "_v", json_value("line"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("_v", f"$.{path}", "variant"))
    part = lambda s, path: F.schema_of_variant(F.try_variant_get(s, f"$.{path}", "variant"))
    steps = F.try_variant_get("_v", "$.steps", "array<variant>")
    known = F.forall(
        steps,
        lambda s: F.coalesce(F.try_variant_get(s, "$.type", "string").isin(*STEP_TYPES), F.lit(False))
        & (F.coalesce(part(s, "content"), F.lit("STRING")) == "STRING"),
    )
    called = F.forall(
        steps,
        lambda s: F.coalesce(part(s, "tool"), F.lit("VOID")).isin("STRING", "VOID")
        & (F.coalesce(part(s, "arguments"), F.lit("VOID")).isin("VOID") | F.startswith(part(s, "arguments"), F.lit("OBJECT"))),
    )
    error = (
        F.when(~F.coalesce(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), F.lit(False)), "not a JSON object")
        .when(F.coalesce(kind("task"), F.lit("")) != "STRING", "task: not a string")
        .when(steps.isNull(), "steps: not a list")
        .when(~known, "steps: unknown step type or content")
        .when(~F.coalesce(called, F.lit(True)), "steps: tool not a string or arguments not an object")
        .when(~F.coalesce(kind("final_answer"), F.lit("VOID")).isin("STRING", "VOID"), "final_answer: not a string")
        .when(kind("metadata").isNotNull() & (kind("metadata") != "VOID") & ~F.startswith(kind("metadata"), F.lit("OBJECT")), "metadata: not an object")
    )
    return staged.withColumn("error", error).drop("_v")


def parse_traces(lines: DataFrame) -> DataFrame:
    """Typed traces from valid lines. Tool results stay JSON text; an absent result is null."""
    lines = stage(lines, "_raw", F.try_variant_get(json_value("line"), "$.steps", "array<variant>"))
    steps = F.transform(
        "_raw",
        lambda s: F.struct(
            F.try_variant_get(s, "$.type", "string").alias("type"),
            F.coalesce(F.try_variant_get(s, "$.content", "string"), F.lit("")).alias("content"),
            F.try_variant_get(s, "$.tool", "string").alias("tool"),
            F.nullif(F.to_json(F.try_variant_get(s, "$.result", "variant")), F.lit("null")).alias("result_json"),
        ),
    )
    staged = stage(lines, "_t", F.from_json("line", _TRACE)).withColumn("steps", steps)
    return staged.select(
        *[c for c in lines.columns if c not in ("line", "error", "_raw")],
        F.col("_t.task").alias("task"),
        "steps",
        F.col("_t.final_answer").alias("final_answer"),
        F.col("_t.metadata").alias("metadata"),
    )


def read_traces(lines: DataFrame) -> DataFrame:
    """Traces from lines, refusing the whole input when one is invalid. The first bad line is named, by ``line_no`` if it is there."""
    checked = validate_traces(lines.filter(strip("line") != ""))
    order = [c for c in ("file_path", "line_no") if c in lines.columns]
    first = checked.filter(F.col("error").isNotNull()).orderBy(*order, "line").limit(1).collect()
    if first:
        place = f" on line {first[0]['line_no']}" if "line_no" in order else ""
        raise ValueError(f"invalid trace{place}: {first[0]['error']}: {first[0]['line'][:200]}")
    return parse_traces(checked)


def rag_case_details(scored: DataFrame) -> DataFrame:
    """Result columns of retrieval cases; judge blocks are null unless the case was judged."""
    block = lambda name: F.when(
        F.col(f"{name}.label") != "",
        F.struct(
            F.col(f"{name}.raw").alias("raw"), F.col(f"{name}.label").alias("label"),
            F.col(f"{name}_reason").alias("reason"),
        ),
    ).alias(name)
    judge = [block(n) for n in ("faithfulness", "answer_correctness") if n in scored.columns]
    scores = ("composite_score", "contains_score", "answer_correctness_score", "faithfulness_score")
    keep = [c for c in ("run_id", "dataset", "case_id", "ord", "description", "answer", "passed") if c in scored.columns]
    return scored.select(
        *keep, *[py_round(F.col(s), 4).alias(s) for s in scores], "failure_reasons", "latency_ms", "cost_usd", *judge
    )


def agent_case_details(scored: DataFrame) -> DataFrame:
    """Result columns of agent cases; judge blocks are null unless the metric was judged."""
    blocks = []
    sources = {"answer_judge": ("correctness", "completeness", "helpfulness"), "reasoning_judge": ("faithfulness", "logical_coherence")}
    for source, metrics in sources.items():
        if source in scored.columns:
            used = F.col("reasoning_score").isNotNull() if source == "reasoning_judge" else (
                (F.col("expected.answer_match") == "llm_judge") & F.col("expected.answer").isNotNull()
            )
            for m in metrics:
                value = F.struct(F.col(f"{source}.{m}.raw").alias("raw"), F.col(f"{source}.{m}.label").alias("label"))
                blocks.append(F.when(used & (F.col(f"{source}.{m}.label") != ""), value).alias(m))
    scores = ("composite_score", "answer_score", "tool_score", "efficiency_score", "reasoning_score")
    keep = [c for c in ("run_id", "dataset", "case_id", "ord", "description", "passed") if c in scored.columns]
    return scored.select(
        *keep, *[py_round(F.col(s), 4).alias(s) for s in scores],
        "failure_reasons", "step_count", "tool_call_count", "latency_ms", "cost_usd", *blocks,
    )


def write_results(runs: DataFrame, cases: DataFrame, path: str) -> None:
    """Write run summaries and case rows as JSON lines below ``path``, by dataset and run.

    A run's cases stay rows beside its summary instead of one nested document: a run may hold any number of them. Writing a
    run again replaces it; other runs of its dataset stay. The rebalance hint splits a large run over files. Each run is a folder that
    other programs can read by itself; where runs are many, ``write_result_table`` keeps them together.
    """
    for rows, name in ((cases, "cases"), (rounded(runs, RESULT_DIGITS), "runs")):
        write = rows.hint("rebalance", "dataset", "run_id").write.mode("overwrite")
        write.option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "run_id").json(f"{path}/{name}")


def write_result_table(runs: DataFrame, cases: DataFrame, path: str) -> None:
    """Add runs and their case rows to a table of results, for any number of runs; a run written again is replaced.

    Rows are clustered by dataset and run: a call leaves as many files as it has tasks, each with a range of runs (see ``commits``).
    """
    commits.write_commit(path, {"cases": cases, "runs": rounded(runs, RESULT_DIGITS)})


def read_result_table(spark: SparkSession, path: str, runs_schema: str, cases_schema: str, runs: Collection[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Run summaries and case rows as last written, of all runs or of the given ones.

    Of given runs only the commits that may hold one are opened, and of those the row groups whose statistics hold one.
    """
    parts = []
    for name, schema in (("runs", runs_schema), ("cases", cases_schema)):
        found = commits.read_commits(spark, path, name, schema, runs)
        parts.append(spark.createDataFrame([], f"{schema}, commit string") if found is None else found)
    every, rows = parts
    last = every.groupBy("run_id").agg(F.max_by(F.struct(*every.columns), "commit").alias("r")).select("r.*")
    return last.drop("commit"), rows.join(last.select("run_id", "commit"), ["run_id", "commit"], "left_semi").drop("commit")


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Write staged cases or an assertion table as JSON lines; null fields are left out."""
    rows.write.mode("overwrite").json(path)


def _run_of(file_path: str) -> list[Column]:
    """Run and dataset of a runner output file."""
    parts = F.split(file_path, "/")
    return [F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("run_id"), F.element_at(parts, -2).alias("dataset")]


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Runner output files, one per run: ``run_id`` from the file name, ``dataset`` from the folder, ``json``.

    A file is one text in one task; ``load_results`` reads large ones.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return raw.select(*_run_of("_metadata.file_path"), F.col("value").alias("json"))
