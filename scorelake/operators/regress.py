"""Compare runs with their baselines and apply the run gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.functions.text import fixed, percent, py_round


def baseline_cases(cases: DataFrame, on: Sequence[str] = ("dataset", "key")) -> DataFrame:
    """Baseline rows by key; of a repeated key the last row counts."""
    return cases.groupBy(*on).agg(
        F.max_by("passed", "ord").alias("baseline_passed"),
        F.max_by("score", "ord").alias("baseline_score"),
    )


def find_regressions(
    current: DataFrame, baseline: DataFrame, on: Sequence[str] = ("dataset", "key")
) -> DataFrame:
    """Current cases that fail now and passed in the baseline.

    Both sides are filtered before the join. ``baseline`` comes from ``baseline_cases``, so its key is unique and a
    case that the current run repeats is reported each time; AQE splits such a key if it is large.
    """
    return current.filter(~F.col("passed")).join(
        baseline.filter(F.col("baseline_passed")).select(*on, "baseline_score"), list(on), "inner"
    )


def flag_regressions(
    current: DataFrame, baseline: DataFrame, on: Sequence[str] = ("dataset", "key")
) -> DataFrame:
    """All current cases with ``regressed`` and ``baseline_score``.

    Summaries count the flag in the pass that computes everything else, so the cases are read and folded once.
    """
    joined = current.join(baseline.select(*on, "baseline_passed", "baseline_score"), list(on), "left")
    return joined.withColumn("regressed", ~F.col("passed") & F.coalesce("baseline_passed", F.lit(False)))


def flag_against_previous(
    cases: DataFrame, run_no: str = "run_no", on: Sequence[str] = ("dataset", "key")
) -> DataFrame:
    """The same flag when each run is the baseline of the next one, as in compare-then-update on every run.

    ``run_no`` numbers the runs of a dataset without gaps; after a missing run there is no baseline. Cases must be
    folded: a key then has one row per run, and the window sees at most as many rows as there are runs. One scan and
    one shuffle replace a self-join.
    """
    before = W.partitionBy(*on).orderBy(run_no)
    last = F.lag(F.struct(F.col(run_no).alias("no"), F.col("passed").alias("passed"), F.col("score").alias("score")))
    staged = cases.withColumn("_last", last.over(before))
    known = F.col("_last.no") == F.col(run_no) - 1
    return staged.withColumns(
        {
            "baseline_score": F.when(known, F.col("_last.score")),
            "regressed": ~F.col("passed") & F.coalesce(known & F.col("_last.passed"), F.lit(False)),
        }
    ).drop("_last")


def previous_rates(summary: DataFrame, run_no: str = "run_no", by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Add ``baseline_pass_rate``, the stored rate of the run before."""
    before = W.partitionBy(*by).orderBy(run_no)
    known = F.lag(run_no).over(before) == F.col(run_no) - 1
    return summary.withColumn("baseline_pass_rate", F.when(known, py_round(F.lag("pass_rate").over(before), 4)))


def _reason(condition: Column, text: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), text)


def apply_gates(runs: DataFrame) -> DataFrame:
    """Gate every run. Input: summary columns, ``regressions``, ``baseline_pass_rate``, ``thresholds``.

    A run without a baseline has ``baseline_pass_rate`` null and gets a null verdict.
    """
    t = F.col("thresholds")
    rate, delta = F.col("pass_rate"), F.col("pass_rate") - F.col("baseline_pass_rate")
    has_drop_gate = "max_score_drop" in runs.schema["thresholds"].dataType.fieldNames()
    max_drop = t["max_score_drop"] if has_drop_gate else F.lit(None).cast("double")
    # The wording of gate messages.
    reasons = F.array_compact(
        F.array(
            _reason(
                t["fail_on_regression"] & (F.col("regressions") > 0),
                F.concat(F.col("regressions").cast("string"), F.lit(" previously-passing case(s) now fail")),
            ),
            _reason(
                rate < t["pass_rate"],
                F.concat(
                    F.lit("Pass rate "), percent(rate), F.lit(" is below required threshold "), percent(t["pass_rate"])
                ),
            ),
            _reason(
                delta < -max_drop,
                F.concat(
                    F.lit("Pass rate dropped "),
                    percent(F.abs(delta)),
                    F.lit(", exceeds max allowed drop of "),
                    percent(max_drop),
                ),
            ),
            _reason(
                F.col("total_cost_usd") > t["max_cost_usd"],
                F.concat(
                    F.lit("Total cost $"),
                    # Summation order moves the last bits; six digits are what a result keeps.
                    fixed(py_round(F.col("total_cost_usd"), 6), 4),
                    F.lit(" exceeds threshold $"),
                    fixed(t["max_cost_usd"], 4),
                ),
            ),
            _reason(
                F.col("p95_latency_ms") > t["max_p95_latency_ms"],
                F.concat(
                    F.lit("p95 latency "),
                    fixed(F.col("p95_latency_ms"), 0),
                    F.lit("ms exceeds threshold "),
                    t["max_p95_latency_ms"].cast("string"),
                    F.lit("ms"),
                ),
            ),
        )
    )
    known = F.col("baseline_pass_rate").isNotNull()
    return runs.withColumns(
        {
            "pass_rate_delta": delta,
            "failure_reasons": F.when(known, reasons),
            "gate_passed": F.when(known, F.size(reasons) == 0),
        }
    )


def gate_runs(summary: DataFrame, baseline_rates: DataFrame, on: Sequence[str] = ("dataset",)) -> DataFrame:
    """Gate run summaries against the stored rates of their baselines.

    ``summary`` carries ``thresholds`` and a ``regressions`` count; ``baseline_rates`` has an unrounded ``pass_rate``
    per baseline, which is rounded to four digits before it is compared.
    """
    rates = baseline_rates.select(*on, py_round(F.col("pass_rate"), 4).alias("baseline_pass_rate"))
    return apply_gates(summary.join(rates, list(on), "left"))


def sweep_gate(runs: DataFrame, compare: bool, keys: Sequence[str] = ()) -> DataFrame:
    """Do all datasets pass? One row, or one per sweep when ``keys`` name several. A run with an error fails.

    With ``compare`` only a failed verdict counts (no baseline is no failure), without it any rate below one.
    """
    judged = F.coalesce(F.col("gate_passed"), F.lit(True)) if compare else F.col("pass_rate") >= 1.0
    no_error = F.col("error").isNull() if "error" in runs.columns else F.lit(True)
    return runs.groupBy(*keys).agg(F.coalesce(F.bool_and(judged & no_error), F.lit(True)).alias("all_passed"))
