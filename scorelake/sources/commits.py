"""Tables that grow by commits, and a manifest that says which runs a commit holds.

Each table is Parquet below ``commits``, with a partition a commit. In a commit rows lie by dataset and run, so that a file holds a
range of runs and its statistics tell which. The manifest gets one row a dataset when all of a commit's tables are written: the
commit, the dataset, and its first and last run. What a call that died has written has no manifest row and isn't read. A read of given
runs lists and opens the folders of the commits whose range holds one of them, and no other.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Collection, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "commit string, dataset string, first_run string, last_run string, runs long"


def write_commit(path: str, tables: Mapping[str, DataFrame], of: str = "runs") -> str:
    """Write tables that have ``dataset`` and ``run_id`` as one commit; the table ``of`` says which runs it holds."""
    commit = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        inside = [c for c in ("ord", "id") if c in rows.columns][:1]
        laid = rows.repartitionByRange("dataset", "run_id", *inside).sortWithinPartitions("dataset", "run_id", *inside)
        laid.withColumn("commit", F.lit(commit)).write.mode("append").partitionBy("commit", "dataset").parquet(f"{path}/commits/{name}")
    spark = tables[of].sparkSession
    held = _read(spark, path, of, "run_id string, dataset string", [commit])
    spans = held.groupBy("dataset").agg(F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"), F.count("*").alias("runs"))
    rows = spans.select(F.lit(commit).alias("commit"), "dataset", "first_run", "last_run", "runs")
    rows.coalesce(1).write.mode("append").parquet(f"{path}/manifest")  # a row a dataset
    return commit


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all commits; none before the first."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _read(spark: SparkSession, path: str, name: str, schema: str, names: Collection[str] | None = None) -> DataFrame:
    """Rows of all commits, finished or not, or of those named, without a look at others. A commit without rows has no folder."""
    root = f"{path}/commits/{name}"
    read = spark.read.schema(f"{schema}, commit string").option("basePath", root)
    found = []
    for folder in [root] if names is None else [f"{root}/commit={c}" for c in sorted(names)]:
        try:
            spark.read.schema("run_id string").parquet(folder)
            found.append(folder)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
    return read.parquet(*found) if found else spark.createDataFrame([], f"{schema}, commit string")


def read_commits(spark: SparkSession, path: str, name: str, schema: str, runs: Collection[str] | None = None) -> DataFrame | None:
    """Rows of a table with their ``commit``, of all commits, or only of those that may hold one of ``runs``; None if there are none."""
    known = manifest(spark, path)
    if runs is None:
        if known.isEmpty():
            return None
        rows = _read(spark, path, name, schema)
        return rows.join(known.select("commit").distinct(), "commit", "left_semi")
    wanted = sorted(set(runs))
    meant = F.exists(F.lit(wanted), lambda r: r.between(F.col("first_run"), F.col("last_run")))
    # of the runs that a caller names, a few folders each
    names = [r["commit"] for r in known.where(meant).select("commit").distinct().collect()] if wanted else []
    if not names:
        return None
    return _read(spark, path, name, schema, names).where(F.col("run_id").isin(wanted))
