"""Read, validate and append test cases and dataset metadata kept as JSON lines.

Validation looks at the raw JSON types, because a typed parse would turn a number into text and hide the error. Lines
that fail are rows with their reasons, never lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.functions.json_values import json_value
from scorelake.functions.keys import canonical_args
from scorelake.functions.staging import stage
from scorelake.functions.text import strip
from scorelake.schemas import EXPECTED, MOCKS
from scorelake.session import materialize

# Allowed words of enumerated fields.
DIFFICULTIES = ("easy", "medium", "hard")
ANSWER_MATCHES = ("exact", "contains", "regex", "llm_judge")
KINDS = ("qa", "classification", "instruction", "rag", "agent")

# Required text fields of each kind of case.
REQUIRED_TEXT = {
    "qa": ("input.query", "expected.ground_truth"),
    "classification": ("input.text", "expected.label"),
    "instruction": ("input.instruction", "expected.rubric"),
    "rag": ("input.query", "expected.ground_truth"),
    "agent": ("input.task",),
}
# Start of an id made for a case without one.
ID_PREFIX = {"qa": "tc", "classification": "tc", "instruction": "tc", "rag": "rtc", "agent": "atc"}

_INPUT = (
    "struct<query:string,text:string,instruction:string,document:string,task:string,"
    "retrieved_contexts:array<string>,context:string>"
)
_RAW_EXPECTED = (
    "struct<ground_truth:string,label:string,rubric:string,answer:string,answer_match:string,"
    "must_call:array<string>,must_not_call:array<string>,must_call_with:array<struct<tool:string,args:string>>,"
    "max_steps:int,max_tool_calls:int>"
)
_RAW_MOCK = "struct<response:string,latency_ms:int,error:string>"
_CASE = (
    f"struct<id:string,description:string,tags:array<string>,difficulty:string,metadata:string,input:{_INPUT},"
    f"expected:{_RAW_EXPECTED},tools:map<string,{_RAW_MOCK}>>"
)


def read_lines(spark: SparkSession, path: str, dataset: Column | None = None) -> DataFrame:
    """Non-blank lines of a JSON-lines file or folder: ``dataset``, ``file_path`` and ``line``.

    Without a ``dataset`` expression its name is the folder the file lies in.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    name = F.element_at(F.split("_metadata.file_path", "/"), -2) if dataset is None else dataset
    lines = raw.select(name.alias("dataset"), F.col("_metadata.file_path").alias("file_path"), strip("value").alias("line"))
    return lines.filter(F.col("line") != "")


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_lines`` with ``line_no``, counted including blanks, and ``item_no``, counted without them.

    A large file is read as many splits. A task counts the lines of its splits, and what earlier splits of the file hold, a row a
    split by byte offset, is added to that.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    where = [F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("split")]
    split = ["file_path", "split"]
    held = raw.select(*where, (strip("value") != "").alias("full")).groupBy(*split)
    held = held.agg(F.count("*").alias("lines"), F.count_if("full").alias("items"))
    earlier = Window.partitionBy("file_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(*split, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("lines", "items")])
    return _with_offsets(count_in_splits(raw.select(*where, strip("value").alias("line"))), before).select(
        F.element_at(F.split("file_path", "/"), -2).alias("dataset"),
        "file_path",
        (F.col("line_at") + F.col("lines")).alias("line_no"),
        (F.col("item_at") + F.col("items")).alias("item_no"),
        "line",
    )


#: Splits whose offsets are sent to every task: some 50 MB. Offsets of more splits are joined by a shuffle.
BROADCAST_SPLITS = 500_000


def _with_offsets(rows: DataFrame, before: DataFrame) -> DataFrame:
    """Rows with what lies before their split."""
    before = materialize(before)
    side = F.broadcast(before) if before.count() <= BROADCAST_SPLITS else before
    return rows.join(side, ["file_path", "split"])


def count_in_splits(rows: DataFrame) -> DataFrame:
    """Non-blank lines of a scan (file_path, split, line) with ``line_at`` and ``item_at``, counted from 1 within their split.

    A task reads its splits one after the other and each in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lines, items = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            full = pc.not_equal(batch.column("line"), "").to_numpy(zero_copy_only=False)
            paths, starts = batch.column("file_path").dictionary_encode(), batch.column("split").to_numpy()
            codes = paths.indices.to_numpy()
            cuts = np.flatnonzero((starts[1:] != starts[:-1]) | (codes[1:] != codes[:-1])) + 1
            begins = np.append(0, cuts)
            sizes = np.diff(np.append(begins, len(starts)))
            line_at = np.arange(1, len(starts) + 1) - np.repeat(begins, sizes)
            total = np.cumsum(full)
            item_at = total - np.repeat(total[begins] - full[begins], sizes)
            if (paths.dictionary[int(codes[0])].as_py(), int(starts[0])) == last:
                line_at[: sizes[0]] += lines
                item_at[: sizes[0]] += items
            last, lines, items = (paths.dictionary[int(codes[-1])].as_py(), int(starts[-1])), int(line_at[-1]), int(item_at[-1])
            kept = batch.append_column("line_at", pa.array(line_at)).append_column("item_at", pa.array(item_at))
            yield kept.filter(pa.array(full))

    return rows.mapInArrow(run, "file_path string, split long, line string, line_at long, item_at long")


def _kind_of(doc: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(doc, f"$.{path}", "variant"))


def _text_error(doc: Column, path: str, required: bool, nullable: bool = False) -> Column:
    kind = _kind_of(doc, path)
    absent = F.lit(f"{path}: field required") if required else F.lit(None).cast("string")
    bad = (kind != "STRING") & ~((kind == "VOID") & F.lit(nullable))
    return F.when(kind.isNull(), absent).when(bad, F.lit(f"{path}: not a string"))


def _int_error(doc: Column, path: str, nullable: bool = True) -> Column:
    kind = _kind_of(doc, path)
    value = F.try_variant_get(doc, f"$.{path}", "double")
    whole = F.coalesce(value == F.floor(value), F.lit(False))
    bad = ~whole & ~((kind == "VOID") & F.lit(nullable))
    return F.when(kind.isNotNull() & bad, F.lit(f"{path}: not a whole number"))


def _list_error(doc: Column, path: str) -> Column:
    kind = _kind_of(doc, path)
    return F.when(kind.isNotNull() & ~kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~_empty_list(doc, path), F.lit(f"{path}: not a list of strings"))


def _empty_list(doc: Column, path: str) -> Column:
    return F.coalesce(F.to_json(F.try_variant_get(doc, f"$.{path}", "variant")) == "[]", F.lit(False))


def _object_error(doc: Column, path: str, required: bool = False) -> Column:
    kind = _kind_of(doc, path)
    absent = F.lit(f"{path}: field required") if required else F.lit(None).cast("string")
    return F.when(kind.isNull(), absent).when(~F.startswith(kind, F.lit("OBJECT")), F.lit(f"{path}: not an object"))


def _enum_error(doc: Column, path: str, allowed: tuple[str, ...], nullable: bool) -> Column:
    kind, value = _kind_of(doc, path), F.try_variant_get(doc, f"$.{path}", "string")
    wrong = F.when(kind == "VOID", F.lit(not nullable)).otherwise((kind != "STRING") | ~value.isin(*allowed))
    return F.when(kind.isNotNull() & wrong, F.lit(f"{path}: not one of {', '.join(allowed)}"))


def _calls_error(doc: Column, path: str) -> Column:
    """Call requirements are objects with a tool name and, if given, arguments as an object."""
    items = F.try_variant_get(doc, f"$.{path}", "array<variant>")

    def fine(item: Column) -> Column:
        kind = lambda p: F.schema_of_variant(F.try_variant_get(item, f"$.{p}", "variant"))
        named = F.coalesce(kind("tool") == "STRING", F.lit(False))
        return named & F.startswith(F.coalesce(kind("args"), F.lit("OBJECT")), F.lit("OBJECT"))

    good = F.coalesce(F.forall(items, fine), F.lit(False))
    return F.when(_kind_of(doc, path).isNotNull() & ~good, F.lit(f"{path}: not a list of tool calls"))


def _mocks_error(doc: Column, path: str) -> Column:
    """Mocks map tool names to objects whose error, if any, is a text and whose latency, if any, is a whole number."""
    mocks = F.map_values(F.try_variant_get(doc, f"$.{path}", "map<string,variant>"))

    def fine(mock: Column) -> Column:
        error = F.schema_of_variant(F.try_variant_get(mock, "$.error", "variant"))
        is_object = F.startswith(F.schema_of_variant(mock), F.lit("OBJECT"))
        latency = F.try_variant_get(mock, "$.latency_ms", "double")
        timed = F.schema_of_variant(F.try_variant_get(mock, "$.latency_ms", "variant")).isNull() | F.coalesce(latency == F.floor(latency), F.lit(False))
        return is_object & timed & F.coalesce(error, F.lit("VOID")).isin("STRING", "VOID")

    kind = _kind_of(doc, path)
    good = F.startswith(kind, F.lit("OBJECT")) & F.coalesce(F.forall(mocks, fine), F.lit(False))
    return F.when(kind.isNotNull() & ~good, F.lit(f"{path}: not an object of mock responses"))


def case_errors(doc: Column, kind: Column) -> Column:
    """What is wrong with a case, as a list of texts; empty for a valid one. ``doc`` is a parsed variant."""
    common = [
        _text_error(doc, "id", False),
        _text_error(doc, "description", False),
        _list_error(doc, "tags"),
        _enum_error(doc, "difficulty", DIFFICULTIES, True),
        _object_error(doc, "metadata"),
        _object_error(doc, "input", True),
    ]
    per_kind = []
    for name, paths in REQUIRED_TEXT.items():
        checks = [_text_error(doc, p, True) for p in paths]
        if name != "agent":
            checks.append(_object_error(doc, "expected", True))
        if name == "instruction":
            checks.append(_text_error(doc, "input.document", False, True))
        if name == "rag":
            checks.append(_list_error(doc, "input.retrieved_contexts"))
        if name == "agent":
            checks += [
                _object_error(doc, "expected"),
                _mocks_error(doc, "tools"),
                _calls_error(doc, "expected.must_call_with"),
                _object_error(doc, "input.context"),
                _text_error(doc, "expected.answer", False, True),
                _text_error(doc, "expected.rubric", False, True),
                _enum_error(doc, "expected.answer_match", ANSWER_MATCHES, False),
                _list_error(doc, "expected.must_call"),
                _list_error(doc, "expected.must_not_call"),
                _int_error(doc, "expected.max_steps"),
                _int_error(doc, "expected.max_tool_calls"),
            ]
        per_kind.append(F.when(kind == name, F.array(*checks)))
    not_object = ~F.coalesce(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), F.lit(False))
    unknown = F.array(F.lit(f"type: not one of {', '.join(REQUIRED_TEXT)}"))
    return F.when(not_object, F.array(F.lit("not a JSON object"))).otherwise(
        F.array_compact(F.concat(F.array(*common), F.coalesce(*per_kind, unknown)))
    )


def validate_cases(lines: DataFrame, kind: Column | str = "type") -> DataFrame:
    """Add ``errors`` and ``valid`` to lines. Row-wise, no shuffle."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    staged = stage(lines, "_doc", json_value("line"))
    return staged.withColumn("errors", case_errors(F.col("_doc"), kind)).drop("_doc").withColumn(
        "valid", F.size("errors") == 0
    )


def parse_cases(valid_lines: DataFrame, kind: Column | str = "type") -> DataFrame:
    """Typed cases with their defaults from valid lines. A case without an id gets one derived from its line."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    staged = stage(valid_lines, "_c", F.from_json("line", _CASE))
    prefix = F.coalesce(*[F.when(kind == k, F.lit(p)) for k, p in ID_PREFIX.items()], F.lit("tc"))
    names = F.array().cast("array<string>")
    e = F.col("_c.expected")
    requirements = F.transform(
        e["must_call_with"],
        lambda r: F.struct(
            r["tool"].alias("tool"),
            F.coalesce(canonical_args(r["args"]), F.create_map().cast("map<string,string>")).alias("args"),
        ),
    )
    mocks = F.transform_values(
        "_c.tools",
        lambda _, m: F.struct(
            m["response"].alias("response_json"),
            F.coalesce(m["latency_ms"], F.lit(0)).alias("latency_ms"),
            m["error"].alias("error"),
        ),
    )
    expected = F.struct(
        e["ground_truth"].alias("ground_truth"),
        e["label"].alias("label"),
        e["rubric"].alias("rubric"),
        e["answer"].alias("answer"),
        F.coalesce(e["answer_match"], F.lit("contains")).alias("answer_match"),
        F.coalesce(e["must_call"], names).alias("must_call"),
        F.coalesce(e["must_not_call"], names).alias("must_not_call"),
        F.coalesce(requirements, F.array().cast("array<struct<tool:string,args:map<string,string>>>")).alias("must_call_with"),
        e["max_steps"].alias("max_steps"),
        e["max_tool_calls"].alias("max_tool_calls"),
    )
    made_id = F.concat(prefix, F.lit("_"), F.substring(F.sha2("line", 256), 1, 8))
    return staged.select(
        *[c for c in valid_lines.columns if c not in ("errors", "valid")],
        F.coalesce("_c.id", made_id).alias("case_id"),
        F.coalesce("_c.description", F.lit("")).alias("description"),
        F.coalesce("_c.tags", names).alias("tags"),
        F.col("_c.difficulty").alias("difficulty"),
        F.coalesce("_c.metadata", F.lit("{}")).alias("metadata_json"),
        F.col("_c.input").alias("input"),
        expected.alias("expected"),
        F.coalesce(mocks, F.create_map().cast(MOCKS)).alias("tools"),
    )


def agent_expected(expected: Column) -> Column:
    """The expectation fields of an agent case."""
    names = ("answer", "answer_match", "rubric", "must_call", "must_not_call", "must_call_with", "max_steps", "max_tool_calls")
    return F.struct(*[expected[n].alias(n) for n in names]).cast(EXPECTED)


class InvalidCases(ValueError):
    """Raised by a strict append or load; ``errors`` is the table of failing lines."""

    def __init__(self, errors: DataFrame, count: int):
        super().__init__(f"{count} validation error(s)")
        self.errors = errors


def load_cases(spark: SparkSession, path: str, kind: str, first_only: bool = False) -> DataFrame:
    """Typed cases of hand-kept files, refusing invalid ones by line number. A missing path is an empty set.

    ``first_only`` stops at the first bad line, as for the plain kinds; otherwise the error carries all of them, as for
    retrieval and agent cases. Lines are checked once, into a checkpoint.
    """
    empty = "dataset string, file_path string, line_no long, item_no long, line string"
    try:
        numbered = read_numbered_lines(spark, path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        numbered = spark.createDataFrame([], empty)
    checked = materialize(validate_cases(numbered, F.lit(kind)))
    bad = checked.filter(~F.col("valid")).drop("valid")
    first = bad.orderBy("file_path", "line_no").limit(1).collect()
    if first and first_only:
        raise ValueError(f"invalid case on line {first[0]['line_no']} of {first[0]['file_path']}: {'; '.join(first[0]['errors'])}")
    if first:
        raise InvalidCases(bad, bad.count())
    return parse_cases(checked, F.lit(kind))


def append_cases(lines: DataFrame, path: str, kind: Column | str = "type", on_error: str = "fail") -> DataFrame:
    """Append lines to the case table at ``path`` and return the written and skipped counts per dataset.

    ``fail`` adds nothing when any line is bad; ``skip`` adds the valid ones and fails only when there are none. The lines are
    checked once, into a checkpoint that the counts, the written rows and the errors are taken from.
    """
    checked = materialize(validate_cases(lines, kind))
    counts = checked.groupBy("dataset").agg(
        F.count_if("valid").alias("added"), F.count_if(~F.col("valid")).alias("skipped")
    )
    totals = counts.agg(F.sum("added").alias("added"), F.sum("skipped").alias("skipped")).first()
    bad, good = totals["skipped"] or 0, totals["added"] or 0
    if bad and (on_error == "fail" or not good):
        raise InvalidCases(checked.filter(~F.col("valid")).drop("valid"), bad)
    checked.filter("valid").drop("errors", "valid").write.mode("append").partitionBy("dataset").parquet(path)
    return counts


def read_catalog(spark: SparkSession, glob: str) -> DataFrame:
    """Dataset metadata files found by a glob such as ``root/*/dataset.json``; unreadable ones are left out."""
    raw = spark.read.text(glob, wholetext=True)
    return parse_catalog(raw.select(F.col("value").alias("meta")))


_META = (
    "struct<name:string,type:string,description:string,tags:array<string>,labels:array<string>,"
    "tools:array<struct<name:string,description:string,parameters:string>>,thresholds:struct<pass_rate:double,"
    "max_score_drop:double,fail_on_regression:boolean,max_cost_usd:double,max_p95_latency_ms:int,"
    "require_contains:boolean,min_faithfulness_score:double,min_answer_correctness_score:double,"
    "faithfulness_weight:double,answer_correctness_weight:double,min_answer_score:double,min_tool_score:double,"
    "min_reasoning_score:double,answer_weight:double,tool_weight:double,reasoning_weight:double,"
    "efficiency_weight:double>,created_at:string,updated_at:string,author:string>"
)


def parse_catalog(metas: DataFrame) -> DataFrame:
    """Typed dataset rows from metadata JSON in ``meta``, sorted by name."""
    staged = stage(stage(metas, "_m", F.from_json("meta", _META)), "_v", json_value("meta"))
    ok = F.coalesce(_kind_of(F.col("_v"), "name") == "STRING", F.lit(False))
    named_kind = _kind_of(F.col("_v"), "type").isNull() | F.col("_m.type").isin(*KINDS)
    rest = [c for c in metas.columns if c != "meta"]
    text = lambda c: F.coalesce(f"_m.{c}", F.lit("")).alias(c)
    return (
        staged.filter(ok & named_kind)
        .select(
            *rest,
            "_m.name",
            "_m.type",
            text("description"),
            F.coalesce("_m.tags", F.array().cast("array<string>")).alias("tags"),
            "_m.labels",
            "_m.tools",
            "_m.thresholds",
            "_m.created_at",
            "_m.updated_at",
            text("author"),
        )
        .orderBy("name")
    )
