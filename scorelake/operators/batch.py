"""Run a user's agent function over a table of cases."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.operators.agent import case_latency
from scorelake.schemas import STEPS
from scorelake.session import materialize

RESULT = (
    f"steps {STEPS}, final_answer string, total_tokens int, total_cost_usd double, total_latency_ms int, error string"
)


def run_batch(cases: DataFrame, fn: Callable[[dict], dict], keep: str = "case_id string") -> DataFrame:
    """Call ``fn(case)`` for every row and return one trajectory row per case.

    ``keep`` is the DDL of the columns to carry over. ``fn`` gets the row as a dict and returns trajectory fields. An
    exception is recorded as the error of that case; the others go on. Rows are streamed in Arrow batches, never held
    together. ``latency_ms`` is what the trajectory reports, else the measured time.
    """
    kept = [part.split()[0] for part in keep.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for case in batch.to_dict("records"):
                started = time.monotonic()
                try:
                    out = {"error": None, **fn(case)}
                    elapsed = int((time.monotonic() - started) * 1000)
                except Exception as exc:  # one failing case must not end the run
                    out, elapsed = {"error": str(exc)}, 0
                rows.append(
                    {
                        **{c: case[c] for c in kept},
                        "steps": out.get("steps") or [],
                        "final_answer": out.get("final_answer"),
                        "total_tokens": out.get("total_tokens") or 0,
                        "total_cost_usd": float(out.get("total_cost_usd") or 0.0),
                        "total_latency_ms": out.get("total_latency_ms") or 0,
                        "error": out["error"],
                        "elapsed_ms": elapsed,
                    }
                )
            columns = [*kept, "steps", "final_answer", "total_tokens", "total_cost_usd", "total_latency_ms", "error"]
            yield pd.DataFrame(rows, columns=[*columns, "elapsed_ms"])

    out = cases.mapInPandas(run, f"{keep}, {RESULT}, elapsed_ms int")
    return out.withColumn("latency_ms", case_latency(F.col("total_latency_ms"), F.col("elapsed_ms"))).drop("elapsed_ms")


def resume_batch(cases: DataFrame, fn: Callable[[dict], dict], path: str, key: str = "case_id", keep: str = "case_id string", per_task: int = 50) -> DataFrame:
    """``run_batch`` into a table at ``path``, where a call goes on from what earlier calls have left; the results of ``cases`` by key.

    Each task takes about ``per_task`` cases and its results are in the table when it ends, whatever becomes of the job. A killed run
    that is called again calls ``fn`` only for cases without a result; a case is called twice only if its own task died. Every key has
    one result, the first by commit of its task; cases that repeat a key share it, and those without a key have none.
    """
    spark = cases.sparkSession
    schema = f"{keep}, {RESULT}, latency_ms int"

    def done() -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    named = cases.filter(F.col(key).isNotNull())
    todo = materialize(named.join(done().select(key).distinct(), key, "left_anti").dropDuplicates([key]))
    tasks = -(-todo.count() // per_task)
    if tasks:
        results = run_batch(todo.repartition(tasks, key), fn, keep)
        # the second commit protocol moves a task's file into place when the task ends, not when the job does
        write = results.select(*[part.split()[0] for part in keep.split(", ")], *_result_names(), "latency_ms").write.mode("append")
        write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    wanted = named.select(key).distinct()
    return done().withColumn("_file", F.input_file_name()).join(wanted, key, "left_semi").transform(lambda df: _first_by_key(df, key))


def _result_names() -> list[str]:
    return ["steps", "final_answer", "total_tokens", "total_cost_usd", "total_latency_ms", "error"]


def _first_by_key(rows: DataFrame, key: str) -> DataFrame:
    """One row a key: a task that was repeated after its results were in place leaves its cases twice."""
    columns = [c for c in rows.columns if c not in (key, "_file")]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*columns), "_file").alias("_r"))
    return first.select(key, "_r.*")
