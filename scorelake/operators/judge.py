"""Judge replies: from raw text to an ordinal value per metric, and their combination per case."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.json_values import json_value
from scorelake.functions.scales import METRIC_SCALES, Scale
from scorelake.functions.staging import stage
from scorelake.functions.text import py_round, strip, strip_fence

# The metrics of each judge, in the order of the combined reason, with their names there.
RAG_METRICS = {"faithfulness": "Faithfulness", "answer_correctness": "Answer Correctness"}
ANSWER_METRICS = {"correctness": "Correctness", "completeness": "Completeness", "helpfulness": "Helpfulness"}
REASONING_METRICS = {"faithfulness": "Faithfulness", "logical_coherence": "Coherence"}


def _field(obj: Column, name: str) -> Column:
    """Text of a JSON field as Python's str() shows it: absent is empty, null is None."""
    kind = F.schema_of_variant(F.try_variant_get(obj, f"$.{name}", "variant"))
    value = F.try_variant_get(obj, f"$.{name}", "string")
    return (
        F.when(kind.isNull(), "")
        .when(kind == "VOID", "None")
        .when(kind == "BOOLEAN", F.initcap(value))
        .otherwise(F.coalesce(value, F.lit("")))
    )


def parse_replies(replies: DataFrame, scales: Mapping[str, Sequence[str]] = METRIC_SCALES) -> DataFrame:
    """Add raw value, label, normalised score and reason to rows with ``metric`` and ``raw_text``.

    A reply that is no JSON object, or whose label fits nothing, gets the middle of the scale. Rows of unknown metrics
    get nulls. Only row-wise expressions: no shuffle.
    """
    staged = stage(replies, "_obj", json_value(strip_fence("raw_text"))).withColumn(
        "_is_obj", F.coalesce(F.startswith(F.schema_of_variant("_obj"), F.lit("OBJECT")), F.lit(False))
    )
    staged = staged.withColumn(
        "_label", F.when(F.col("_is_obj"), F.lower(strip(_field(F.col("_obj"), "answer"))))
    ).withColumn("_why", _field(F.col("_obj"), "reasoning"))

    def per_metric(build) -> Column:
        return F.coalesce(*[F.when(F.col("metric") == m, build(Scale(tuple(ls)))) for m, ls in scales.items()])

    staged = staged.withColumn("_pos", per_metric(lambda s: s.position(F.col("_label")))).withColumn(
        "raw", F.coalesce("_pos", per_metric(lambda s: F.lit(s.middle)))
    )
    label = per_metric(lambda s: s.label_at(F.col("raw")))
    return (
        staged.withColumn("label", label)
        .withColumn("normalized", per_metric(lambda s: s.score_at(F.col("raw"))))
        .withColumn("max_raw", per_metric(lambda s: F.lit(len(s.labels) - 1)))
        .withColumn(
            "reason",
            F.when(~F.col("_is_obj"), "Could not parse judge response: not a JSON object")
            .when(F.col("_pos").isNotNull(), F.col("_why"))
            .otherwise(
                F.concat(
                    F.lit("Could not parse label '"), "_label", F.lit("' — defaulted to '"), "label", F.lit("'")
                )
            ),
        )
        .drop("_obj", "_is_obj", "_label", "_why", "_pos")
    )


def pivot_metrics(parsed: DataFrame, metrics: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    """One row per case with a struct column per metric, their mean and the combined reason.

    Cases join this once however many metrics there are. A case that lacks one of the metrics is left out, as it was
    not judged. Of repeated replies the last counts, if there is a column ``ord`` to tell, else the one that sorts highest.
    """
    wanted = parsed.filter(F.col("metric").isin(list(metrics)))
    value = F.struct("raw", "label", "normalized", "reason")
    order = F.struct("ord", value) if "ord" in parsed.columns else value
    pick = lambda m: F.max_by(F.when(F.col("metric") == m, value), F.when(F.col("metric") == m, order)).alias(m)
    wide = wanted.groupBy(*keys).agg(*map(pick, metrics))
    complete = wide.dropna(subset=list(metrics))
    total = sum((F.col(m)["normalized"] for m in metrics), F.lit(0.0))
    reason = F.concat_ws(" | ", *[F.concat(F.lit(f"{title}: "), F.col(m)["reason"]) for m, title in metrics.items()])
    return complete.withColumns({"judge_score": py_round(total / len(metrics), 4), "judge_reason": reason})
