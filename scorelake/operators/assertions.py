"""Assertions of test cases: build them, check the deterministic ones, score the set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.text import icontains

# Fixed value: opening of the rubric of a question-answer case.
QA_RUBRIC = "The answer must correctly address the following: "


def _assertion(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"))


def build_assertions(cases: DataFrame) -> DataFrame:
    """Add ``vars`` and ``assertions`` by dataset ``type``. Input: ``type``, ``input`` and ``expected`` structs."""
    i, e, kind = F.col("input"), F.col("expected"), F.col("type")
    instruction_vars = F.map_filter(
        F.create_map(F.lit("instruction"), i["instruction"], F.lit("document"), i["document"]),
        lambda k, v: (k != "document") | F.coalesce(v != "", F.lit(False)),
    )
    return cases.withColumns(
        {
            "vars": F.when(kind == "qa", F.create_map(F.lit("query"), i["query"]))
            .when(kind == "classification", F.create_map(F.lit("text"), i["text"]))
            .when(kind == "instruction", instruction_vars),
            "assertions": F.when(
                kind == "qa",
                F.array(
                    _assertion("icontains", e["ground_truth"]),
                    _assertion("llm-rubric", F.concat(F.lit(QA_RUBRIC), e["ground_truth"])),
                ),
            )
            .when(kind == "classification", F.array(_assertion("icontains", e["label"])))
            .when(kind == "instruction", F.array(_assertion("llm-rubric", e["rubric"]))),
        }
    )


def check_assertions(cases: DataFrame, rubric: str | None = None) -> DataFrame:
    """Add ``checks``: one boolean per assertion against ``answer``.

    ``rubric`` names a column with the judge's verdict; without one, rubric assertions stay null.
    """
    verdict = F.col(rubric) if rubric else F.lit(None).cast("boolean")
    return cases.withColumn(
        "checks",
        F.transform(
            "assertions",
            lambda a: F.when(a["type"] == "icontains", icontains(F.col("answer"), a["value"])).otherwise(verdict),
        ),
    )


def score_checks(checks: Column) -> Column:
    """Share of assertions that passed; assertions without a verdict are left out, none at all counts in full."""
    known = F.filter(checks, lambda c: c.isNotNull())
    ok = F.filter(known, lambda c: c)
    return F.when(F.size(known) == 0, 1.0).otherwise(F.size(ok) / F.nullif(F.size(known), F.lit(0)))


def all_passed(checks: Column) -> Column:
    return F.forall(checks, lambda c: F.coalesce(c, F.lit(True)))
