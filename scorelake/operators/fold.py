"""Fold raw provider results into case results, and break them down by provider.

Input rows: run_id, dataset, key, ord, provider, success, score, latency_ms, cost_usd. ``key`` identifies the case,
``ord`` is a unique position inside the run. Every aggregate buffer is of fixed width, so Spark combines on the map
side with hash aggregation; a case or run that holds most of the rows is reduced before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN_KEYS = ("run_id", "dataset")


def fold_providers(raw: DataFrame, carry: Sequence[str] = (), run_keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """One row per run and case: passed by all, lowest score, whole-number mean latency, summed cost.

    ``carry`` names columns that the key determines, such as ``vars_json``; they become grouping columns.
    """
    return raw.groupBy(*run_keys, "key", *carry).agg(
        F.bool_and("success").alias("passed"),
        F.min("score").alias("score"),
        F.expr("cast(floor(sum(cast(latency_ms as long)) / count(*)) as int)").alias("latency_ms"),
        F.sum("cost_usd").alias("cost_usd"),
        F.min("ord").alias("ord"),
    )


def provider_cases(raw: DataFrame, carry: Sequence[str] = (), run_keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """One row per run, provider and case; a repeated case keeps the values of its last row."""
    return raw.groupBy(*run_keys, "provider", "key", *carry).agg(
        F.max_by("success", "ord").alias("passed"),
        F.max_by("score", "ord").alias("score"),
        F.max_by("latency_ms", "ord").alias("latency_ms"),
        F.max_by("cost_usd", "ord").alias("cost_usd"),
        F.min("ord").alias("ord"),
    )


def rate_band(rate: Column, full: float, near: float) -> Column:
    return F.when(rate >= full, "green").when(rate >= near, "yellow").otherwise("red")


def provider_summary(raw: DataFrame, run_keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Pass rate, cost, mean latency and colour band of each provider in a run."""
    rate = F.count_if(F.col("passed")) / F.count("*")
    return (
        provider_cases(raw, run_keys=run_keys)
        .groupBy(*run_keys, "provider")
        .agg(
            F.count("*").alias("cases"),
            F.count_if(F.col("passed")).alias("passed"),
            rate.alias("pass_rate"),
            F.sum("cost_usd").alias("cost_usd"),
            F.avg("latency_ms").alias("avg_latency_ms"),
            F.min("ord").alias("first_ord"),
        )
        .withColumn("band", rate_band(F.col("pass_rate"), 0.8, 0.6))
    )


def list_providers(raw: DataFrame) -> list[str]:
    """Providers by first appearance, for ``provider_matrix``, in which each is a set of columns.

    The names come to the driver. Where they are many, ``provider_cases`` holds the same comparison as rows.
    """
    seen = raw.groupBy("provider").agg(F.min("ord").alias("first")).orderBy("first", "provider")
    return [r["provider"] for r in seen.collect()]


def provider_matrix(
    raw: DataFrame, providers: Sequence[str], carry: Sequence[str] = (), run_keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """One row per case, three columns per provider; a provider without the case has nulls.

    The provider list is explicit, so one aggregation pass does both last-row-wins and the pivot. ``first_ord`` gives
    the order of first appearance. With fewer than two providers there is nothing to compare and no row comes out.
    """
    columns = []
    for p in providers:
        here = F.col("provider") == p
        at = F.when(here, F.col("ord"))
        for field, name in (("success", "passed"), ("score", "score"), ("latency_ms", "latency_ms")):
            columns.append(F.max_by(F.when(here, F.col(field)), at).alias(f"{p}_{name}"))
    matrix = raw.groupBy(*run_keys, "key", *carry).agg(F.min("ord").alias("first_ord"), *columns)
    return matrix if len(providers) >= 2 else matrix.limit(0)


def token_totals(stats: DataFrame, run_keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Token totals of a run; a missing count is zero."""
    names = ("total_tokens", "prompt_tokens", "completion_tokens")
    return stats.groupBy(*run_keys).agg(
        *[F.sum(F.coalesce(F.col(n), F.lit(0)).cast("long")).alias(n) for n in names]
    )
