"""Tables that grow by commits: what a read of a run opens, many runs in few files, and runs of agents that go on where they ended."""

import os
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scorelake.operators.batch import resume_batch
from scorelake.sources import commits, history, results
from scorelake.sources.documents import list_documents, next_documents, object_store_path, read_documents

RUNS = "run_id string, dataset string, total long, passed long, failed long, pass_rate double, total_cost_usd double, avg_latency_ms double, p50_latency_ms double, p95_latency_ms double"
ROWS = "ord long, run_id string, dataset string, key string, vars_json string, passed boolean, score double, latency_ms int, cost_usd double"


def recorded(spark, ids, path, cases_=2, rate=0.5):
    runs = spark.createDataFrame([(i, f"d{i[-1]}", 3, 2, 1, rate, 0.5, 10.0, 9.0, 12.0) for i in ids], RUNS)
    rows = spark.createDataFrame([(n, i, f"d{i[-1]}", f"k{n}", "{}", True, 1.0, 5, 0.0) for i in ids for n in range(cases_)], ROWS)
    history.record_runs(history.history_runs(runs, "llm", F.lit("[]"), F.lit("2024-01-01")), history.history_cases(rows), path)


def folders(df):
    return {Path(f).parts[-3] for f in df.inputFiles()}


def test_a_read_of_one_run_opens_its_commits_only(spark, tmp_path):
    path = str(tmp_path / "h")
    for block in range(4):
        recorded(spark, [f"r{block}{i}" for i in range(5)], path)
    recorded(spark, ["r12"], path, cases_=7, rate=0.9)
    names = sorted(n for n in os.listdir(f"{path}/commits/case_results") if n.startswith("commit="))
    found = commits.read_commits(spark, path, "case_results", "id long, run_id string, dataset string", ["r12"])
    assert folders(found) == {names[1], names[4]}
    assert folders(commits.read_commits(spark, path, "runs", "run_id string, dataset string", ["r31", "r00"])) == {names[0], names[3]}
    assert commits.read_commits(spark, path, "runs", "run_id string", ["x"]) is None and commits.read_commits(spark, path, "runs", "run_id string", []) is None
    runs, rows = history.load_history(spark, path, ["r12", "r30"])
    assert {r["run_id"]: r["pass_rate"] for r in runs.collect()} == {"r12": 0.9, "r30": 0.5}
    assert {r["run_id"]: r["count"] for r in rows.groupBy("run_id").count().collect()} == {"r12": 7, "r30": 2}
    assert history.load_history(spark, path)[1].count() == 19 * 2 + 7
    assert history.load_history(spark, path, ["none"])[0].count() == 0
    history.compact_history(spark, path, str(tmp_path / "c"))
    assert len(list((tmp_path / "c" / "commits" / "runs").glob("commit=*"))) == 1 and history.load_history(spark, str(tmp_path / "c"))[0].count() == 20


def test_a_commit_without_its_manifest_row_is_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    recorded(spark, ["r1"], path)
    with monkeypatch.context() as m:
        m.setattr(commits, "MANIFEST", "")
        m.setattr(F, "max", lambda *_: 1 / 0)  # the call dies after its tables, ahead of its manifest row
        with pytest.raises(ZeroDivisionError):
            recorded(spark, ["r1", "r2"], path, cases_=9)
    assert len(list(Path(path).glob("commits/runs/commit=*"))) == 2
    runs, rows = history.load_history(spark, path)
    assert [r["run_id"] for r in runs.collect()] == ["r1"] and rows.count() == 2
    assert history.load_history(spark, path, ["r2"])[0].count() == 0


def test_a_hundred_thousand_runs_in_few_files(spark, tmp_path):
    path, n = str(tmp_path / "r"), 100_000
    runs = spark.range(n).select(F.format_string("run%06d", "id").alias("run_id"), F.lit("d").alias("dataset"), F.lit(1.0).alias("pass_rate"))
    cases = runs.select("run_id", "dataset", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("ord"), F.rand(1).alias("score"))
    results.write_result_table(runs, cases.repartition(7), path)
    files = list(Path(path).rglob("cases/**/*.parquet"))
    assert len(files) <= 8 and len(list(Path(path).rglob("*.parquet"))) < 24
    groups = [pq.ParquetFile(f).metadata.row_group(0) for f in files]
    spans = [next(g.column(i).statistics for i in range(g.num_columns) if g.column(i).path_in_schema == "run_id") for g in groups]
    assert sum(s.min <= "run054321" <= s.max for s in spans) == 1
    schemas = ("run_id string, dataset string, pass_rate double", "run_id string, dataset string, ord long, score double")
    own, rows = results.read_result_table(spark, path, *schemas, runs=["run054321"])
    assert own.count() == 1 and sorted(r["ord"] for r in rows.collect()) == [0, 1, 2]
    assert "EqualTo(run_id,run054321)" in rows._jdf.queryExecution().executedPlan().toString()
    results.write_result_table(runs.filter("run_id = 'run054321'"), cases.filter("run_id = 'run054321' and ord = 0"), path)
    assert results.read_result_table(spark, path, *schemas, runs=["run054321"])[1].count() == 1
    assert results.read_result_table(spark, path, *schemas)[1].count() == 3 * n - 2
    assert results.read_result_table(spark, path, *schemas, runs=["no"])[0].count() == 0


def test_baselines_of_one_dataset(spark, tmp_path):
    path = str(tmp_path / "b")
    runs = spark.createDataFrame([(f"r{i}", f"d{i}", 3, 2, 1, 0.5, 0.5, 10.0, 9.0, 12.0) for i in range(3)], RUNS)
    history.save_baselines(runs, spark.createDataFrame([(0, f"r{i}", f"d{i}", "k", "{}", True, 1.0, 5, 0.0) for i in range(3)], ROWS), path)
    own, rows = history.load_baselines(spark, path, ["d1"])
    assert [r["run_id"] for r in own.collect()] == [r["run_id"] for r in rows.collect()] == ["r1"]
    assert "PartitionFilters: [isnotnull(dataset" in rows._jdf.queryExecution().executedPlan().toString()


def agent(folder, poison=None):
    def call(case):
        with open(f"{folder}/calls", "a") as log:
            log.write(f"{case['case_id']}\n")
        if case["case_id"] == poison:
            os._exit(1)
        if case["case_id"] == "c7":
            raise ValueError("no answer")
        return {"final_answer": f"answer {case['case_id']}", "total_latency_ms": 3}

    return call


def test_a_killed_run_goes_on(spark, tmp_path):
    cases = spark.createDataFrame([(f"c{i}",) for i in range(60)] + [("c5",), (None,)], "case_id string").repartition(5)
    path, calls = str(tmp_path / "t"), tmp_path / "calls"
    with pytest.raises((PySparkException, Py4JJavaError)):
        resume_batch(cases, agent(str(tmp_path), "c33"), path, per_task=6)
    left = {r["case_id"] for r in spark.read.parquet(path).collect()}
    assert left and "c33" not in left
    calls.unlink()
    got = resume_batch(cases, agent(str(tmp_path)), path, per_task=6)
    rows = {r["case_id"]: r for r in got.collect()}
    again = calls.read_text().split()
    assert sorted(again) == sorted({f"c{i}" for i in range(60)} - left)
    assert set(rows) == {f"c{i}" for i in range(60)} and rows["c3"]["final_answer"] == "answer c3" and rows["c7"]["error"] == "no answer"
    calls.unlink()
    assert resume_batch(cases, agent(str(tmp_path)), path, per_task=6).count() == 60 and not calls.exists()
    assert resume_batch(cases.limit(0), agent(str(tmp_path)), str(tmp_path / "none")).count() == 0


def test_objects_by_uri_and_page(spark, tmp_path):
    for name in ("docs/a.txt", "docs/b c.md", "docs/sub/c[1].txt", "docs/z.pdf", "docs-old/d.TXT", "other/e.txt", "docs/sub/f.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"text of {name}")
    uri = f"file://{tmp_path}/docs"
    listed = sorted(r["source"] for r in list_documents(spark, uri).collect())
    assert listed == [f"{tmp_path}/{n}" for n in ("docs-old/d.TXT", "docs/a.txt", "docs/b c.md", "docs/sub/c[1].txt", "docs/sub/f.md")]
    assert list_documents(spark, uri).agg(F.sum("bytes")).first()[0] == sum(len(f"text of {x.removeprefix(f'{tmp_path}/')}") for x in listed)
    after, pages = "", []
    while True:
        page = next_documents(spark, uri, after, 2).orderBy("source").collect()
        if not page:
            break
        pages.append([r["source"] for r in page])
        after = page[-1]["source"]
        assert all(r["content"] == f"text of {r['source'].removeprefix(f'{tmp_path}/')}" for r in page)
    assert [len(p) for p in pages] == [2, 2, 1] and sum(pages, []) == listed
    assert sorted(r["source"] for r in read_documents(spark, object_store_path(uri)).collect()) == listed
    assert list_documents(spark, f"file://{tmp_path}/nothing").count() == 0 and next_documents(spark, f"file://{tmp_path}/nothing").count() == 0
