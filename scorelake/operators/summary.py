"""Run summaries with exact nearest-rank percentiles.

A run can hold most of all case rows, so its latencies are never gathered. Cases are first reduced to one row per run
and distinct latency (a hash aggregation with map-side combine); the percentiles are read off the running count of
that histogram. Latency is a whole number of milliseconds, which bounds the histogram of a run however many cases it has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.functions.text import py_round
from scorelake.operators.fold import rate_band

RUN_KEYS = ("run_id", "dataset")

# Digits kept in result files and in the history store.
RESULT_DIGITS = {"pass_rate": 4, "total_cost_usd": 6, "avg_latency_ms": 1, "p50_latency_ms": 1, "p95_latency_ms": 1}
HISTORY_DIGITS = {"pass_rate": 6, "total_cost_usd": 6, "avg_latency_ms": 2, "p50_latency_ms": 2, "p95_latency_ms": 2}


def summarize_runs(
    cases: DataFrame, keys: Sequence[str] = RUN_KEYS, means: Sequence[str] = (), flags: Mapping[str, str] | None = None
) -> DataFrame:
    """Counts, pass rate, cost, mean latency, p50 and p95 per run, unrounded.

    ``means`` names score columns to average as well (composite, answer and tool score of agent runs); ``flags`` maps
    boolean columns to the names of their counts, e.g. ``{"regressed": "regressions"}``.
    """
    flags = flags or {}
    histogram = cases.groupBy(*keys, "latency_ms").agg(
        F.count("*").alias("_n"),
        F.count_if(F.col("passed")).alias("_ok"),
        F.sum("cost_usd").alias("_cost"),
        *[F.sum(m).alias(f"_sum_{m}") for m in means],
        *[F.count_if(F.col(f)).alias(f"_count_{f}") for f in flags],
    )
    run = W.partitionBy(*keys)
    upto = run.orderBy("latency_ms").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = histogram.withColumn("_cum", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(run))

    def at_rank(index: str) -> Column:
        return F.min(F.when(F.col("_cum") > F.expr(index), F.col("latency_ms"))).cast("double")

    total = F.sum("_n")
    return ranked.groupBy(*keys).agg(
        total.alias("total"),
        F.sum("_ok").alias("passed"),
        (total - F.sum("_ok")).alias("failed"),
        (F.sum("_ok") / total).alias("pass_rate"),
        F.sum("_cost").alias("total_cost_usd"),
        (F.sum(F.col("latency_ms").cast("long") * F.col("_n")) / total).alias("avg_latency_ms"),
        at_rank("_all div 2").alias("p50_latency_ms"),
        at_rank("_all * 95 div 100").alias("p95_latency_ms"),
        *[(F.sum(f"_sum_{m}") / total).alias(f"avg_{m}") for m in means],
        *[F.sum(f"_count_{f}").alias(name) for f, name in flags.items()],
    )


def percentiles(cases: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    return summarize_runs(cases, keys).select(*keys, "p50_latency_ms", "p95_latency_ms")


def rounded(summary: DataFrame, digits: dict[str, int] = RESULT_DIGITS) -> DataFrame:
    """Round the summary columns as they are stored."""
    means = {c: 4 for c in summary.columns if c.startswith("avg_") and c not in digits}
    present = {c: d for c, d in {**digits, **means}.items() if c in summary.columns}
    return summary.withColumns({c: py_round(F.col(c), d) for c, d in present.items()})


def with_rate_band(summary: DataFrame) -> DataFrame:
    return summary.withColumn("band", rate_band(F.col("pass_rate"), 1.0, 0.8))


def last_n_stats(runs: DataFrame, last: int = 10, run_type: str | None = None) -> DataFrame:
    """Statistics over the newest ``last`` runs of every dataset at once.

    Run types are mixed unless one is asked for. The rank filter becomes a group limit ahead of the shuffle, so at
    most ``last`` rows per task and dataset travel.
    """
    source = runs if run_type is None else runs.filter(F.col("run_type") == run_type)
    newest = W.partitionBy("dataset").orderBy(F.col("ran_at").desc(), F.col("run_id").desc())
    recent = source.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= last)
    return recent.groupBy("dataset").agg(
        F.count("*").alias("run_count"),
        F.avg("pass_rate").alias("avg_pass_rate"),
        F.min("pass_rate").alias("min_pass_rate"),
        F.max("pass_rate").alias("max_pass_rate"),
        F.sum("total_cost_usd").alias("total_cost_usd"),
        F.avg("total_cost_usd").alias("avg_cost_per_run"),
        F.max("total_cost_usd").alias("max_cost_per_run"),
        F.avg("avg_latency_ms").alias("avg_latency_ms"),
        F.max("p95_latency_ms").alias("max_p95_latency_ms"),
        F.sum("total_tokens").alias("total_tokens"),
    )


def sweep_summary(runs: DataFrame) -> DataFrame:
    """Passed, total, rate and status per dataset, plus one overall row with a null dataset."""
    rate = F.sum("passed") / F.sum("total")
    return (
        runs.groupingSets([[F.col("dataset")], []], F.col("dataset"))
        .agg(F.sum("passed").alias("passed"), F.sum("total").alias("total"), rate.alias("pass_rate"))
        .withColumn("status", F.when(F.col("passed") == F.col("total"), "PASS").otherwise("FAIL"))
    )


def case_counts(cases: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    return cases.groupBy(*keys).agg(F.count("*").alias("case_count"))
