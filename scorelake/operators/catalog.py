"""Catalog views over dataset metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.text import py_round


def with_counts(datasets: DataFrame, counts: DataFrame) -> DataFrame:
    """Datasets with their case counts; null where the cases could not be read."""
    return datasets.join(counts.select(F.col("dataset").alias("name"), "case_count"), "name", "left")


def with_baseline(datasets: DataFrame, baselines: DataFrame) -> DataFrame:
    """Datasets with the pass rate and counts of their baseline, if any."""
    summary = baselines.select(
        F.col("dataset").alias("name"),
        py_round(F.col("pass_rate"), 4).alias("baseline_pass_rate"),
        F.col("passed").alias("baseline_passed"),
        F.col("total").alias("baseline_total"),
    )
    return datasets.join(summary, "name", "left")


def update_metadata(datasets: DataFrame, updates: DataFrame, today: str) -> DataFrame:
    """Replace only the fields an update gives; changed datasets get ``updated_at``."""
    fields = [c for c in updates.columns if c != "name"]
    renamed = updates.select("name", *[F.col(c).alias(f"_{c}") for c in fields])
    any_given = F.lit(False)
    for c in fields:
        any_given = any_given | F.col(f"_{c}").isNotNull()
    joined = datasets.join(renamed, "name", "left")
    merged = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields}
    merged["updated_at"] = F.when(any_given, F.lit(today)).otherwise(F.col("updated_at"))
    return joined.withColumns(merged).select(*datasets.columns)


def resolve_meta(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """Metadata of versions: the snapshot's own where there is one, else the current one of the dataset."""
    now = current.select("dataset", F.col("type").alias("_type"))
    return snapshot.join(now, "dataset", "left").withColumn("type", F.coalesce("type", "_type")).drop("_type")
