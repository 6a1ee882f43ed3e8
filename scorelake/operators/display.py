"""Short names, previews and capped lists for reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.functions.text import py_repr, shorten, strip


def provider_id(field: Column) -> Column:
    """Id of a provider given as plain text or as a JSON object; ``unknown`` when there is none."""
    is_object = F.startswith(field, F.lit("{"))
    inner = F.coalesce(F.get_json_object(field, "$.id"), F.lit("unknown"))
    return F.coalesce(F.nullif(F.when(is_object, inner).otherwise(field), F.lit("")), F.lit("unknown"))


def short_provider(provider: Column) -> Column:
    """Provider name without its kind, region and vendor, 28 characters at most."""
    name = F.regexp_replace(provider, r"^[^:]*:", "")
    name = F.regexp_replace(name, r"^(us|eu|ap)\.", "")
    # Vendor prefixes that are cut.
    name = F.regexp_replace(name, r"^(anthropic|amazon|meta|mistral)\.", "")
    return F.substring(name, 1, 28)


def case_label(vars_map: Column) -> Column:
    """Short label of a case from its instruction, query or text; else from all its variables."""
    chosen = F.coalesce(*[F.nullif(F.try_element_at(vars_map, F.lit(k)), F.lit("")) for k in ("instruction", "query", "text")])
    asked = F.when(F.contains(chosen, F.lit("Question:")), strip(F.substring_index(chosen, "Question:", -1))).otherwise(chosen)
    shown = F.array_join(
        F.transform(F.map_entries(vars_map), lambda e: F.concat(py_repr(e["key"]), F.lit(": "), py_repr(e["value"]))), ", "
    )
    everything = F.substring(F.concat(F.lit("{"), shown, F.lit("}")), 1, 60)
    return F.coalesce(shorten(F.replace(asked, F.lit("\n"), F.lit(" ")), 60), everything)


def display_time(iso: Column) -> Column:
    """Timestamp text to the second, without the T."""
    return F.replace(F.substring(iso, 1, 19), F.lit("T"), F.lit(" "))


def preview(cases: DataFrame, limit: int, keys: Sequence[str] = ("dataset",), order: str = "ord") -> DataFrame:
    """The first cases of each dataset. The rank filter limits each task's rows before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return cases.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def failed_cases(
    cases: DataFrame, limit: int | None = None, keys: Sequence[str] = ("run_id",), order: str = "ord"
) -> DataFrame:
    """Failing cases; with a limit the first ones of each run plus ``more``, the number left out."""
    failed = cases.filter(~F.col("passed"))
    if limit is None:
        return failed
    counts = failed.groupBy(*keys).agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("more"))
    return preview(failed, limit, keys, order).join(counts, list(keys))


def recent_runs(
    runs: DataFrame, limit: int = 20, dataset: str | None = None, run_type: str | None = None
) -> DataFrame:
    """Newest runs first, optionally of one dataset and run type."""
    columns = (
        "run_id", "dataset", "ran_at", "providers", "total_cases", "passed", "failed", "pass_rate",
        "total_cost_usd", "total_tokens", "avg_latency_ms", "p95_latency_ms", "run_type",
    )
    return (
        filter_runs(runs, dataset, run_type)
        .select(*columns)
        .orderBy(F.col("ran_at").desc(), F.col("run_id").desc())
        .limit(limit)
    )


def filter_runs(runs: DataFrame, dataset: str | None = None, run_type: str | None = None) -> DataFrame:
    if dataset:
        runs = runs.filter(F.col("dataset") == dataset)
    if run_type:
        runs = runs.filter(F.col("run_type") == run_type)
    return runs


def run_cases(runs: DataFrame, case_results: DataFrame) -> DataFrame:
    """Case rows of the given runs in recorded order."""
    wanted = runs.select("run_id").distinct()
    return (
        case_results.join(wanted, "run_id", "left_semi")
        .select("run_id", "id", "vars_json", "passed", "score", "latency_ms", "cost_usd")
        .orderBy("run_id", "id")
    )
