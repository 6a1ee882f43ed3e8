"""Score retrieval-augmented answers, with or without judge results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.text import fixed, icontains, py_repr

CASE_KEYS = ("dataset", "case_id")


def join_responses(
    cases: DataFrame, responses: DataFrame, on: Sequence[str] = CASE_KEYS, runs: DataFrame | None = None
) -> DataFrame:
    """Every case with its answer. A case nobody answered is a failed call with the error ``no response``.

    For answers of many runs at once, ``runs`` lists them (``run_id``, ``dataset``): each run is then held to every case
    of its dataset.
    """
    if runs is not None:
        cases = cases.join(runs.select("run_id", "dataset"), "dataset")
        on = ("run_id", *on)
    answered = responses.withColumn("_answered", F.lit(True))
    joined = cases.join(answered, list(on), "left")
    missing = F.col("_answered").isNull()
    return joined.withColumn("error", F.when(missing, "no response").otherwise(F.col("error"))).drop("_answered")


def join_judge(cases: DataFrame, judged: DataFrame, on: Sequence[str] = CASE_KEYS) -> DataFrame:
    """Attach pivoted judge metrics; cases without a judgement keep nulls."""
    return cases.join(judged, list(on), "left")


def _below(score: Column, limit: Column, name: str, why: Column) -> Column:
    return F.when(
        score < limit,
        F.concat(F.lit(f"{name} score "), fixed(score, 2), F.lit(" below threshold "), fixed(limit, 2), why),
    )


def score_rag(cases: DataFrame) -> DataFrame:
    """Add the scores and failure reasons of each case.

    Input: ``ground_truth``, ``answer``, ``error`` and ``thresholds``; with judge results also ``faithfulness`` and
    ``answer_correctness`` structs (see ``pivot_metrics``). A failed call is scored on the empty answer without judge.
    """
    has_judge = {"faithfulness", "answer_correctness"} <= set(cases.columns)
    t = F.col("thresholds")
    failed_call = F.col("error").isNotNull()
    answer = F.when(failed_call, "").otherwise(F.coalesce("answer", F.lit("")))
    df = cases.withColumns({"answer": answer, "contains_score": icontains(answer, "ground_truth").cast("double")})

    if has_judge:
        df = df.withColumns(
            {m: F.when(~failed_call, F.col(m)) for m in ("faithfulness", "answer_correctness")}
        )
        judged = F.col("faithfulness").isNotNull() & F.col("answer_correctness").isNotNull()
        faith, correct = F.col("faithfulness"), F.col("answer_correctness")
        both = F.concat(
            F.lit("Faithfulness: "), faith["reason"], F.lit(" | Answer Correctness: "), correct["reason"]
        )
        df = df.withColumns(
            {
                "_judged": judged,
                "faithfulness_reason": F.when(
                    judged, F.replace(F.substring_index(both, " | ", 1), F.lit("Faithfulness: "), F.lit(""))
                ),
                "answer_correctness_reason": F.when(
                    judged, F.substring_index(both, " | Answer Correctness: ", -1)
                ),
                "faithfulness_score": F.when(judged, faith["normalized"]).otherwise(1.0),
                "answer_correctness_score": F.when(judged, correct["normalized"]).otherwise(F.col("contains_score")),
            }
        )
    else:
        df = df.withColumns(
            {
                "_judged": F.lit(False),
                "faithfulness_reason": F.lit(None).cast("string"),
                "answer_correctness_reason": F.lit(None).cast("string"),
                "faithfulness_score": F.lit(1.0),
                "answer_correctness_score": F.col("contains_score"),
            }
        )

    judged = F.col("_judged")
    fw, cw = t["faithfulness_weight"], t["answer_correctness_weight"]
    weighted = F.when(
        fw + cw > 0, (F.col("faithfulness_score") * fw + F.col("answer_correctness_score") * cw) / (fw + cw)
    ).otherwise(0.0)
    # The wording of failure reasons.
    reasons = F.array_compact(
        F.array(
            F.when(failed_call, F.concat(F.lit("Model call failed: "), "error")),
            F.when(
                t["require_contains"] & (F.col("contains_score") == 0.0),
                F.concat(F.lit("Answer does not contain expected ground truth: "), py_repr(F.col("ground_truth"))),
            ),
            F.when(
                judged,
                _below(
                    F.col("faithfulness_score"),
                    t["min_faithfulness_score"],
                    "Faithfulness",
                    F.concat(F.lit(": "), "faithfulness_reason"),
                ),
            ),
            _below(
                F.col("answer_correctness_score"),
                t["min_answer_correctness_score"],
                "Answer correctness",
                F.when(judged, F.concat(F.lit(": "), "answer_correctness_reason")).otherwise(
                    F.lit(" (no judge configured; using contains match)")
                ),
            ),
        )
    )
    return df.withColumns(
        {
            "composite_score": F.when(judged, weighted).otherwise(F.col("answer_correctness_score")),
            "failure_reasons": reasons,
            "passed": F.size(reasons) == 0,
        }
    ).drop("_judged")
