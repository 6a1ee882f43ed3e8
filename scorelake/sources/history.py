"""Run history, baselines and case versions as partitioned Parquet tables."""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scorelake.functions.text import py_round
from scorelake.operators.summary import HISTORY_DIGITS, rounded
from scorelake.schemas import CASE_RESULTS, RUNS
from scorelake.sources import commits

# Fixed value: form of a version name.
VERSION = re.compile(r"^v\d+\.\d+\.\d+$")


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def _overwrite(df: DataFrame, path: str, *partitions: str) -> None:
    df.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *partitions
    ).parquet(path)


def read_table(spark: SparkSession, path: str, *partitions: str) -> DataFrame:
    """A partitioned table with its partition columns as text, so that a dataset named 007 keeps its name."""
    found = spark.read.parquet(path).schema
    fields = [StructField(f.name, StringType()) if f.name in partitions else f for f in found]
    return spark.read.schema(StructType(fields)).parquet(path)


def _existing(spark: SparkSession, path: str, *partitions: str) -> DataFrame | None:
    """The table at a path, or None before its first write."""
    try:
        return read_table(spark, path, *partitions)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def history_runs(summary: DataFrame, run_type: str, providers: Column, ran_at: Column) -> DataFrame:
    """History rows of summarised runs of one type. Agent and retrieval runs carry no tokens."""
    token = lambda c: (F.col(c) if c in summary.columns else F.lit(0)).cast("long").alias(c)
    return rounded(summary, HISTORY_DIGITS).select(
        "run_id",
        "dataset",
        ran_at.alias("ran_at"),
        providers.alias("providers"),
        F.col("total").cast("int").alias("total_cases"),
        F.col("passed").cast("int").alias("passed"),
        F.col("failed").cast("int").alias("failed"),
        "pass_rate",
        "total_cost_usd",
        token("total_tokens"),
        token("prompt_tokens"),
        token("completion_tokens"),
        "avg_latency_ms",
        "p50_latency_ms",
        "p95_latency_ms",
        F.lit(run_type).alias("run_type"),
    )


def history_cases(cases: DataFrame, key: str = "key", score: str = "score") -> DataFrame:
    """History rows of case results. ``id`` keeps the order inside a run."""
    return cases.select(
        F.col("ord").alias("id"),
        "run_id",
        "dataset",
        F.col(key).alias("vars_key"),
        "vars_json",
        "passed",
        py_round(F.col(score), 6).alias("score"),
        "latency_ms",
        py_round(F.col("cost_usd"), 6).alias("cost_usd"),
    )


def migrate_runs(runs: DataFrame) -> DataFrame:
    """Runs written before run types existed count as plain ones."""
    if "run_type" not in runs.columns:
        runs = runs.withColumn("run_type", F.lit(None).cast("string"))
    return runs.withColumn("run_type", F.coalesce("run_type", F.lit("llm")))


def union_histories(*histories: DataFrame) -> DataFrame:
    """One table of runs of all types."""
    first, *others = [migrate_runs(h) for h in histories]
    for h in others:
        first = first.unionByName(h, allowMissingColumns=True)
    return first


def record_runs(runs: DataFrame, cases: DataFrame, path: str) -> None:
    """Store runs and their cases; a run that is there already is replaced, under whatever dataset it was.

    Both tables only grow, by a commit a call (see ``commits``), whose names sort by time; the newest commit of a run holds. A call that
    dies before its manifest row changes nothing that is read, and may be repeated.
    """
    tables = {name: rows.select(*_names(ddl)) for rows, ddl, name in ((cases, CASE_RESULTS, "case_results"), (runs, RUNS, "runs"))}
    commits.write_commit(path, tables)


def _recorded(spark: SparkSession, path: str, name: str, ddl: str, runs: Collection[str] | None) -> DataFrame:
    """Rows of all commits, and those of a table from before there were commits, which count as the oldest."""
    found = commits.read_commits(spark, path, name, ddl, runs)
    try:
        old = spark.read.schema(f"{ddl}, commit string").parquet(f"{path}/{name}")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None if found is not None else spark.createDataFrame([], f"{ddl}, commit string")
    if old is not None and runs is not None:
        old = old.filter(F.col("run_id").isin(sorted(set(runs))))
    every = [x.select(*_names(ddl), F.coalesce("commit", F.lit("")).alias("commit")) for x in (found, old) if x is not None]
    return every[0] if len(every) == 1 else every[0].unionByName(every[1])


def load_history(spark: SparkSession, path: str, runs: Collection[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs and case rows as last recorded, of all runs or of the given ones, whose commits alone are then read.

    Rows of before there were commits and run types count as the oldest.
    """
    every = migrate_runs(_recorded(spark, path, "runs", RUNS, runs))
    last = every.groupBy("run_id").agg(F.max_by(F.struct(*every.columns), "commit").alias("r")).select("r.*")
    rows = _recorded(spark, path, "case_results", CASE_RESULTS, runs)
    held = rows.join(last.select("run_id", "commit"), ["run_id", "commit"], "left_semi")
    return last.select(*_names(RUNS)), held.select(*_names(CASE_RESULTS))


def compact_history(spark: SparkSession, path: str, to: str) -> None:
    """Write the history as last recorded to another folder, as one commit without replaced rows."""
    record_runs(*load_history(spark, path), to)


def save_baselines(runs: DataFrame, cases: DataFrame, path: str) -> None:
    """Make the given runs, one per dataset, the baselines of their datasets."""
    _overwrite(cases, f"{path}/cases", "dataset")
    _overwrite(rounded(runs), f"{path}/runs", "dataset")


def load_baselines(spark: SparkSession, path: str, datasets: Collection[str] | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Baseline runs and cases, or None when nothing was saved yet. Of given datasets, only their folders are read."""
    runs = _existing(spark, f"{path}/runs", "dataset")
    if runs is None:
        return None
    both = runs, read_table(spark, f"{path}/cases", "dataset")
    return both if datasets is None else tuple(x.filter(F.col("dataset").isin(sorted(set(datasets)))) for x in both)


def check_version(version: str) -> str:
    if not VERSION.match(version):
        raise ValueError(f"invalid version '{version}'; use v<MAJOR>.<MINOR>.<PATCH>")
    return version


def tag_version(
    cases: DataFrame, path: str, version: str, created_at: str, description: str = "", meta: DataFrame | None = None
) -> DataFrame:
    """Snapshot the cases of all given datasets under a version; a dataset that has it already is refused.

    Returns the version rows with their case counts. The version row is written last and makes the snapshot count: what a call
    that died before it has left is overwritten by the next one, and not read until then.
    """
    check_version(version)
    spark = cases.sparkSession
    existing = _existing(spark, f"{path}/versions")
    if existing is not None:
        clash = existing.filter(F.col("version") == version).join(cases.select("dataset").distinct(), "dataset", "left_semi")
        named = clash.select("dataset").distinct()
        names = [r["dataset"] for r in named.orderBy("dataset").limit(5).collect()]
        if names:
            more = named.count() - len(names)
            raise ValueError(f"version '{version}' already exists for {', '.join(names)}{f' and {more} more' if more else ''}")
    snapshot = cases.withColumn("version", F.lit(version))
    _overwrite(snapshot, f"{path}/case_versions", "dataset", "version")
    written = read_table(spark, f"{path}/case_versions", "dataset", "version").filter(F.col("version") == version)
    info = written.join(cases.select("dataset").distinct(), "dataset", "left_semi").groupBy("dataset", "version").agg(
        F.count("*").alias("case_count")
    ).withColumns({"created_at": F.lit(created_at), "description": F.lit(description)})
    if meta is not None:
        info = info.join(meta.select("dataset", "type"), "dataset", "left")
    info.write.mode("append").parquet(f"{path}/versions")
    return spark.read.parquet(f"{path}/versions").filter(F.col("version") == version)


def sort_versions(versions: DataFrame, semantic: bool = False) -> DataFrame:
    """Versions by name as text (v1.10.0 before v1.2.0), or by their numbers. Malformed names are left out."""
    valid = versions.filter(F.col("version").rlike(VERSION.pattern))
    parts = F.transform(F.split(F.substring("version", 2, 100), r"\."), lambda p: p.cast("int"))
    return valid.orderBy("dataset", parts if semantic else F.col("version"))


def list_versions(spark: SparkSession, path: str, semantic: bool = False) -> DataFrame:
    return sort_versions(spark.read.parquet(f"{path}/versions"), semantic)


def read_version(spark: SparkSession, path: str, version: str, dataset: str | None = None) -> DataFrame:
    """Cases of a snapshot; only its partitions are read, and only of datasets that were tagged."""
    cases = read_table(spark, f"{path}/case_versions", "dataset", "version").filter(F.col("version") == check_version(version))
    cases = cases if dataset is None else cases.filter(F.col("dataset") == dataset)
    return cases.join(spark.read.parquet(f"{path}/versions").select("dataset", "version"), ["dataset", "version"], "left_semi")


def restore_version(spark: SparkSession, path: str, version: str, cases_path: str, dataset: str | None = None) -> DataFrame:
    """Overwrite the working cases with a snapshot and return the restored counts. Metadata is left as it is."""
    snapshot = read_version(spark, path, version, dataset).drop("version")
    if snapshot.isEmpty():
        raise FileNotFoundError(f"version '{version}' has no cases to restore")
    _overwrite(snapshot, cases_path, "dataset")
    return snapshot.groupBy("dataset").agg(F.count("*").alias("case_count"))
