"""What Spark takes a staged table's size for, since that decides whether a join sends it to every machine."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from scorelake.functions.json_values import json_value
from scorelake.functions.staging import stage

DATA = Path("/root/testdata/sf0.001")


def estimate(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_staged_values_leave_the_size_as_it_is(spark, tmp_path):
    spark.range(2000).select("id", F.concat(F.lit('{"a": '), F.col("id").cast("string"), F.lit("}")).alias("line")).write.parquet(str(tmp_path / "t"))
    lines = spark.read.parquet(str(tmp_path / "t"))
    twice = stage(stage(lines, "_v", json_value("line")), "_s", F.from_json("line", "struct<a:string,b:string,c:string,d:array<string>>"))
    kept = twice.filter(F.col("_v").isNotNull()).select("id", "line", F.col("_s.a").alias("a"))
    assert estimate(kept) >= estimate(lines.select("id", "line"))
    assert kept.columns == ["id", "line", "a"] and {r["a"] for r in kept.collect()} == {str(i) for i in range(2000)}


@pytest.mark.skipif(not DATA.exists(), reason="the shared tables are not here")
def test_traces_with_their_texts_are_not_broadcast(spark):
    size = sum(p.stat().st_size for p in [DATA / "documents.parquet"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(size // 10))
    try:
        plan = queries()["trace_scan"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Broadcast" not in plan


@pytest.mark.skipif(not DATA.exists(), reason="the shared tables are not here")
def test_replies_of_one_row_group_are_parsed_by_several_tasks(spark):
    made = queries()["parse_generated"](spark, str(DATA))
    assert made.select(F.spark_partition_id().alias("task")).distinct().count() > 1


@pytest.mark.skipif(not DATA.exists(), reason="the shared tables are not here")
def test_objects_are_listed_once(spark, monkeypatch):
    from scorelake.sources import documents

    listed, files = [], documents._files
    monkeypatch.setattr(documents, "_files", lambda spark, path, *more: listed.append(path) or files(spark, path, *more))
    rows = queries()["object_documents"](spark, str(DATA)).collect()
    assert len(listed) == 1 and sum(r["objects"] for r in rows) > 1
