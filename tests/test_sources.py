import json

import pytest
from pyspark.sql import functions as F

from scorelake.operators import catalog, replies, summary, traces, transcripts
from scorelake.operators.batch import run_batch
from scorelake.sources import cases, history, results

QA = {"id": "a", "input": {"query": "q"}, "expected": {"ground_truth": "g"}}


def lines(spark, *items, kind="qa"):
    rows = [(kind, i if isinstance(i, str) else json.dumps(i)) for i in items]
    return spark.createDataFrame(rows, "type string, line string").withColumn("dataset", F.lit("d"))


def errors(spark, item, kind="qa"):
    return cases.validate_cases(lines(spark, item, kind=kind)).first()["errors"]


@pytest.mark.parametrize(
    "change, error",
    [
        ({}, None),
        ({"id": 5}, "id: not a string"),
        ({"id": None}, "id: not a string"),
        ({"tags": "x"}, "tags: not a list of strings"),
        ({"tags": []}, None),
        ({"tags": [1]}, "tags: not a list of strings"),
        ({"difficulty": "brutal"}, "difficulty: not one of easy, medium, hard"),
        ({"difficulty": None}, None),
        ({"metadata": []}, "metadata: not an object"),
        ({"input": {"query": 5}}, "input.query: not a string"),
        ({"input": {}}, "input.query: field required"),
        ({"unknown": 1}, None),
    ],
)
def test_question_cases(spark, change, error):
    assert errors(spark, {**QA, **change}) == ([error] if error else [])


@pytest.mark.parametrize(
    "kind, item, ok",
    [
        ("classification", {"input": {"text": "t"}, "expected": {"label": "l"}}, True),
        ("classification", {"input": {"text": "t"}, "expected": {"label": 1}}, False),
        ("instruction", {"input": {"instruction": "i", "document": None}, "expected": {"rubric": "r"}}, True),
        ("instruction", {"input": {"instruction": "i", "document": 3}, "expected": {"rubric": "r"}}, False),
        ("rag", {"input": {"query": "q", "retrieved_contexts": ["c"]}, "expected": {"ground_truth": "g"}}, True),
        ("rag", {"input": {"query": "q", "retrieved_contexts": "c"}, "expected": {"ground_truth": "g"}}, False),
        ("agent", {"input": {"task": "t"}}, True),
        ("agent", {"input": {"task": "t"}, "expected": {"answer_match": "fuzzy"}}, False),
        ("agent", {"input": {"task": "t"}, "expected": {"max_steps": 4.5}}, False),
        ("agent", {"input": {"task": "t"}, "expected": {"max_steps": 4}, "tools": {"a": {"response": 1}}}, True),
        ("agent", {"input": {"task": "t"}, "tools": {"a": 1}}, False),
        ("agent", {"input": {"task": "t"}, "tools": {"a": {"error": 5}}}, False),
        ("agent", {"input": {"task": "t"}, "tools": {}}, True),
        ("agent", {"input": {"task": "t"}, "expected": {"must_call_with": [{"tool": "a", "args": {"k": 1}}, {"tool": "b"}]}}, True),
        ("agent", {"input": {"task": "t"}, "expected": {"must_call_with": [{"args": {}}]}}, False),
        ("agent", {"input": {"task": "t"}, "expected": {"must_call_with": []}}, True),
        ("agent", {"expected": {}}, False),
        ("qa", "nonsense", False),
        ("qa", "[1]", False),
    ],
)
def test_other_kinds(spark, kind, item, ok):
    assert (errors(spark, item, kind) == []) is ok


def test_typed_cases_get_defaults(spark):
    item = {"input": {"task": "t"}, "tools": {"s": {"response": {"b": 1, "a": "x"}}}, "expected": {"must_call_with": [{"tool": "s", "args": {"n": 1.0, "q": "x", "z": None}}]}}
    got = cases.parse_cases(lines(spark, item, kind="agent")).first()
    assert got["case_id"].startswith("atc_") and got["description"] == "" and got["tags"] == []
    assert got["expected"]["answer_match"] == "contains" and got["expected"]["must_call"] == []
    assert got["expected"]["must_call_with"][0]["args"] == {"n": "1", "q": '"x"', "z": None}
    assert json.loads(got["tools"]["s"]["response_json"]) == {"b": 1, "a": "x"} and got["tools"]["s"]["latency_ms"] == 0


def test_numbered_lines_count_blanks_and_not(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "cases.jsonl").write_text('{"a": 1}\n\n  \n{"b": 2}\n')
    got = cases.read_numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["dataset"], r["line_no"], r["item_no"]) for r in got] == [("d", 1, 1), ("d", 4, 2)]
    assert cases.read_lines(spark, str(tmp_path)).count() == 2


def test_loading_names_the_line(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "cases.jsonl").write_text(f"{json.dumps(QA)}\n\nbad\n{{}}\n")
    with pytest.raises(ValueError, match="line 3"):
        cases.load_cases(spark, str(tmp_path / "d"), "qa", first_only=True)
    with pytest.raises(cases.InvalidCases) as refused:
        cases.load_cases(spark, str(tmp_path / "d"), "qa")
    assert sorted(r["line_no"] for r in refused.value.errors.collect()) == [3, 4]
    (tmp_path / "d" / "cases.jsonl").write_text(f"{json.dumps(QA)}\n")
    assert [r["case_id"] for r in cases.load_cases(spark, str(tmp_path / "d"), "qa").collect()] == ["a"]
    assert cases.load_cases(spark, str(tmp_path / "none"), "qa").count() == 0


def test_strict_append_adds_nothing_and_lenient_skips(spark, tmp_path):
    path = str(tmp_path / "cases")
    cases.append_cases(lines(spark, QA), path)
    with pytest.raises(cases.InvalidCases) as refused:
        cases.append_cases(lines(spark, QA, "bad"), path)
    assert refused.value.errors.first()["errors"] == ["not a JSON object"]
    assert spark.read.parquet(path).count() == 1
    counts = cases.append_cases(lines(spark, QA, "bad"), path, on_error="skip").first()
    assert (counts["added"], counts["skipped"]) == (1, 1) and spark.read.parquet(path).count() == 2
    with pytest.raises(cases.InvalidCases):
        cases.append_cases(lines(spark, "bad", "worse"), path, on_error="skip")


def test_catalog_skips_unreadable_and_updates_only_given_fields(spark, tmp_path):
    for name, text in (("b", '{"name": "b", "type": "qa", "tags": ["x"], "updated_at": "2024-01-01"}'), ("a", '{"name": "a", "type": "rag"}'), ("c", "{"), ("e", '{"name": "e", "type": "odd"}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "dataset.json").write_text(text)
    listed = cases.read_catalog(spark, str(tmp_path / "*" / "dataset.json"))
    assert [r["name"] for r in listed.collect()] == ["a", "b"]
    updates = spark.createDataFrame([("b", "new", None)], "name string, description string, tags array<string>")
    got = {r["name"]: r for r in catalog.update_metadata(listed, updates, "2024-02-02").collect()}
    assert (got["b"]["description"], got["b"]["tags"], got["b"]["updated_at"]) == ("new", ["x"], "2024-02-02")
    assert got["a"]["updated_at"] is None
    counts = summary.case_counts(spark.createDataFrame([("b",), ("b",)], "dataset string"))
    assert {r["name"]: r["case_count"] for r in catalog.with_counts(listed, counts).collect()} == {"a": None, "b": 2}


RUN = "run_id string, dataset string, total long, passed long, failed long, pass_rate double, total_cost_usd double, avg_latency_ms double, p50_latency_ms double, p95_latency_ms double"
ROW = "ord long, run_id string, dataset string, key string, vars_json string, passed boolean, score double, latency_ms int, cost_usd double"


def recorded(spark, run_id, dataset, rate, cases_, path):
    runs = spark.createDataFrame([(run_id, dataset, 3, 2, 1, rate, 0.5, 10.0, 9.0, 12.0)], RUN)
    rows = spark.createDataFrame([(i, run_id, dataset, f"k{i}", "{}", True, 1.0, 5, 0.0) for i in range(cases_)], ROW)
    history.record_runs(
        history.history_runs(runs, "llm", F.lit("[]"), F.lit(f"2024-01-0{run_id[-1]}")), history.history_cases(rows), path
    )


def test_recording_replaces_by_run(spark, tmp_path):
    path = str(tmp_path / "h")
    recorded(spark, "r1", "d", 0.5, 3, path)
    recorded(spark, "r2", "d", 0.6, 2, path)
    recorded(spark, "r3", "e", 0.7, 1, path)
    recorded(spark, "r1", "d", 2 / 3, 4, path)
    runs, rows = history.load_history(spark, path)
    assert {r["run_id"]: r["pass_rate"] for r in runs.collect()} == {"r1": 0.666667, "r2": 0.6, "r3": 0.7}
    assert {r["run_id"]: r["count"] for r in rows.groupBy("run_id").count().collect()} == {"r1": 4, "r2": 2, "r3": 1}


def test_a_recorded_run_loses_its_old_rows(spark, tmp_path):
    path, small = str(tmp_path / "h"), str(tmp_path / "c")
    recorded(spark, "r1", "d", 0.5, 3, path)
    recorded(spark, "r2", "d", 0.5, 1, path)
    recorded(spark, "r1", "e", 0.6, 1, path)
    runs, rows = history.load_history(spark, path)
    assert {(r["run_id"], r["dataset"]) for r in runs.collect()} == {("r1", "e"), ("r2", "d")}
    assert sorted((r["run_id"], r["dataset"]) for r in rows.collect()) == [("r1", "e"), ("r2", "d")]
    recorded(spark, "r1", "e", 0.6, 0, path)
    runs, rows = history.load_history(spark, path)
    assert runs.count() == 2 and [r["run_id"] for r in rows.collect()] == ["r2"]
    history.compact_history(spark, path, small)
    again, kept = history.load_history(spark, small)
    assert sorted(again.collect()) == sorted(runs.collect()) and kept.collect() == rows.collect()


def test_case_rows_without_their_run_are_not_read(spark, tmp_path):
    path = str(tmp_path / "h")
    recorded(spark, "r1", "d", 0.5, 3, path)
    rows = spark.createDataFrame([(9, "r1", "d", "k9", "{}", True, 1.0, 5, 0.0)], ROW)
    lost = history.history_cases(rows).withColumn("commit", F.lit("9"))
    lost.write.mode("append").partitionBy("dataset").parquet(f"{path}/case_results")
    assert sorted(r["id"] for r in history.load_history(spark, path)[1].collect()) == [0, 1, 2]


def test_history_from_before_run_types(spark, tmp_path):
    path = str(tmp_path / "h")
    old = spark.createDataFrame([("r0", 0.25)], "run_id string, pass_rate double").withColumn("dataset", F.lit("d"))
    old.write.partitionBy("dataset").parquet(f"{path}/runs")
    spark.createDataFrame([(0, "r0", "d")], "id long, run_id string, dataset string").write.partitionBy("dataset").parquet(f"{path}/case_results")
    recorded(spark, "r1", "d", 0.5, 1, path)
    runs, rows = history.load_history(spark, path)
    assert {(r["run_id"], r["run_type"]) for r in runs.collect()} == {("r0", "llm"), ("r1", "llm")} and rows.count() == 2


def test_results_of_runs_add_up(spark, tmp_path):
    path = str(tmp_path / "r")
    for run, n in (("r1", 3), ("r2", 1), ("r1", 2)):
        runs = spark.createDataFrame([(run, "d", 3, 2, 1, 0.5, 0.5, 10.0, 9.0, 12.0)], RUN)
        rows = spark.createDataFrame([(i, run, "d", f"k{i}", "{}", True, 1.0, 5, 0.0) for i in range(n)], ROW)
        results.write_results(runs, rows, path)
    assert {r["run_id"] for r in spark.read.json(f"{path}/runs").collect()} == {"r1", "r2"}
    assert {r["run_id"]: r["count"] for r in spark.read.json(f"{path}/cases").groupBy("run_id").count().collect()} == {"r1": 2, "r2": 1}


def test_numeric_names_stay_text(spark, tmp_path):
    path, work = str(tmp_path / "v"), str(tmp_path / "w")
    recorded(spark, "r1", "007", 0.5, 2, path)
    recorded(spark, "r2", "007", 0.5, 2, path)
    runs, rows = history.load_history(spark, path)
    assert {r["dataset"] for r in runs.collect()} == {r["dataset"] for r in rows.collect()} == {"007"} and runs.count() == 2
    cases_ = spark.createDataFrame([("007", 1), ("7", 2)], "dataset string, n int")
    history.tag_version(cases_, path, "v1.0.0", "t")
    history.restore_version(spark, path, "v1.0.0", work)
    assert {r["dataset"] for r in history.read_table(spark, work, "dataset").collect()} == {"007", "7"}


def test_old_runs_get_a_type(spark):
    old = spark.createDataFrame([("r",)], "run_id string")
    typed = spark.createDataFrame([("s", "rag"), ("t", None)], "run_id string, run_type string")
    got = {r["run_id"]: r["run_type"] for r in history.union_histories(old, typed).collect()}
    assert got == {"r": "llm", "s": "rag", "t": "llm"}


def test_last_n_uses_the_newest_runs(spark):
    rows = [("d", f"r{i}", f"2024-01-{i:02d}", i / 10, float(i), 1.0, 2.0, 5, "llm" if i % 2 else "rag") for i in range(1, 6)]
    df = spark.createDataFrame(rows, "dataset string, run_id string, ran_at string, pass_rate double, total_cost_usd double, avg_latency_ms double, p95_latency_ms double, total_tokens long, run_type string")
    got = summary.last_n_stats(df, 2).first()
    assert (got["run_count"], got["min_pass_rate"], got["max_pass_rate"], got["total_cost_usd"], got["total_tokens"]) == (2, 0.4, 0.5, 9.0, 10)
    assert summary.last_n_stats(df, 10, "rag").first()["run_count"] == 2


def test_baselines(spark, tmp_path):
    path = str(tmp_path / "b")
    assert history.load_baselines(spark, path) is None
    runs = spark.createDataFrame([("r", "d", 3, 2, 1, 2 / 3, 0.5, 10.0, 9.0, 12.0)], RUN)
    history.save_baselines(runs, spark.createDataFrame([(0, "r", "d", "k", "{}", True, 1.0, 5, 0.0)], ROW), path)
    saved, rows = history.load_baselines(spark, path)
    assert saved.first()["pass_rate"] == 0.6667 and rows.count() == 1


def test_versions(spark, tmp_path):
    path, work = str(tmp_path / "v"), str(tmp_path / "w")
    rows = spark.createDataFrame([("d", i) for i in range(5)] + [("e", 9)], "dataset string, n int")
    for bad in ("1.0.0", "v1.0", "v1.0.0-x"):
        with pytest.raises(ValueError):
            history.tag_version(rows, path, bad, "t")
    # what a call that died ahead of its version row has left
    rows.withColumn("version", F.lit("v1.2.0")).write.partitionBy("dataset", "version").parquet(f"{path}/case_versions")
    tagged = history.tag_version(rows, path, "v1.2.0", "t1", "first")
    assert {r["dataset"]: r["case_count"] for r in tagged.collect()} == {"d": 5, "e": 1}
    assert history.read_version(spark, path, "v1.2.0").count() == 6
    history.tag_version(rows.filter("n < 2"), path, "v1.10.0", "t2")
    with pytest.raises(ValueError):
        history.tag_version(rows, path, "v1.2.0", "t3")
    names = [r["version"] for r in history.list_versions(spark, path).filter("dataset = 'd'").collect()]
    assert names == ["v1.10.0", "v1.2.0"]
    assert [r["version"] for r in history.list_versions(spark, path, semantic=True).filter("dataset = 'd'").collect()] == names[::-1]
    assert history.read_version(spark, path, "v1.10.0", "d").count() == 2
    rows.filter("n = 0 or n = 9").write.partitionBy("dataset").parquet(work)
    counts = history.restore_version(spark, path, "v1.2.0", work, "d").collect()
    assert [(r["dataset"], r["case_count"]) for r in counts] == [("d", 5)] and spark.read.parquet(work).count() == 6
    with pytest.raises(FileNotFoundError):
        history.restore_version(spark, path, "v9.9.9", work)


def test_runner_output_shapes_and_defaults(spark):
    item = '{"vars": {"q": "a"}, "success": true, "latencyMs": 12, "provider": {"id": "p"}}'
    docs = [("a", f'{{"results": {{"results": [{item}], "stats": {{"tokenUsage": {{"total": 9}}}}}}}}'), ("b", f'{{"results": [{item}, {{"vars": {{"q": "b"}}}}]}}'), ("c", f" [{item}]"), ("e", "{}"), ("f", '{"results": {"stats": {}}}'), ("g", "bad")]
    df = spark.createDataFrame(docs, "run_id string, json string")
    got = results.parse_results(df).orderBy("run_id", "ord").collect()
    assert [(r["run_id"], r["ord"], r["provider"], r["success"], r["score"], r["latency_ms"]) for r in got] == [
        ("a", 0, "p", True, 1.0, 12), ("b", 0, "p", True, 1.0, 12), ("b", 1, "unknown", False, 0.0, 0), ("c", 0, "p", True, 1.0, 12),
    ]
    assert got[0]["key"] == got[3]["key"] != got[2]["key"]
    assert {r["run_id"]: r["total_tokens"] for r in results.parse_token_stats(df).collect()} == {"a": 9, "b": 0, "c": 0, "e": 0, "f": 0, "g": 0}


TRACE = {
    "task": "which region?",
    "steps": [
        {"type": "thought", "content": "search"}, {"type": "tool_call", "tool": "kb", "arguments": {"q": 1}, "result": {"r": "x"}},
        {"type": "observation", "content": "seen"}, {"type": "tool_call", "tool": "get"}, {"type": "tool_call", "tool": "kb", "result": [2]},
        {"type": "tool_call", "tool": ""}, {"type": "answer", "content": "old"}, {"type": "answer", "content": ""},
    ],
    "metadata": {"tags": ["s3"], "difficulty": "easy"},
}


def test_trace_inference(spark):
    df = spark.createDataFrame([(json.dumps(TRACE),), (json.dumps({"task": "t", "steps": [], "final_answer": ""}),)], "line string")
    full, bare = traces.trace_to_case(results.read_traces(df)).collect()
    e = full["expected"]
    assert (e["answer"], e["must_call"], e["max_steps"], e["max_tool_calls"]) == ("old", ["kb", "get"], 12, 4)
    assert full["tools"]["kb"]["response_json"] == "[2]" and full["tools"]["get"]["response_json"] is None
    assert (full["tags"], full["difficulty"], full["description"]) == (["s3"], "easy", "")
    assert (bare["expected"]["answer"], bare["expected"]["max_steps"], bare["expected"]["max_tool_calls"]) == ("", 3, 1)


@pytest.mark.parametrize("bad", ["x", '{"steps": []}', '{"task": "t"}', '{"task": "t", "steps": [{"type": "dream"}]}', '{"task": "t", "steps": [{"content": "no type"}]}'])
def test_invalid_traces_are_refused(spark, bad):
    with pytest.raises(ValueError):
        results.read_traces(spark.createDataFrame([(json.dumps(TRACE),), (bad,)], "line string"))


def test_transcripts_stop_at_the_first_answer(spark):
    turns = [
        ("a", 0, "<thought>\n hm </thought><tool_call>{\"name\": \"ok\", \"arguments\": {\"k\": 1}}</tool_call>", 5),
        ("a", 1, "<tool_call>{\"name\": \"no\"}</tool_call><answer> fin\nal </answer>", 6), ("a", 2, "<thought>late</thought>", 7),
        ("b", 0, "<tool_call>{bad</tool_call>", 8),
    ]
    mocks = F.from_json(F.lit('{"ok": {"response_json": "7"}}'), "map<string,struct<response_json:string,latency_ms:int,error:string>>")
    df = spark.createDataFrame(turns, "case_id string, turn int, text string, latency_ms int").withColumn("tools", mocks)
    got = {r["case_id"]: r["steps"] for r in transcripts.assemble(transcripts.transcript_steps(df)).collect()}
    assert [(s["type"], s["content"]) for s in got["a"]] == [
        ("thought", "hm"), ("tool_call", "Calling ok"), ("observation", "7"), ("tool_call", "Calling no"),
        ("observation", "Error: Tool 'no' is not defined in this test case. Available: ['ok']"), ("answer", "fin\nal"),
    ]
    assert got["a"][1]["tool_call"]["arguments"] == {"k": "1"} and got["b"][0]["content"].startswith("[parse error in tool call")
    out = {r["case_id"]: r for r in transcripts.transcript_outcomes(df, 10).collect()}
    assert (out["a"]["final_answer"], out["a"]["total_latency_ms"], out["a"]["error"]) == ("fin\nal", 11, None)
    assert out["b"]["error"] == "Reached max iterations (10) without producing an answer"


def test_event_log(spark):
    def orch(**kw):
        return json.dumps({"trace": {"trace": {"orchestrationTrace": kw}}})

    events = [
        orch(rationale={"text": "think"}, invocationInput={"actionGroupInvocationInput": {"actionGroupName": "g", "requestBody": {"content": {"a": "b"}}}}),
        orch(observation={"actionGroupInvocationOutput": {"text": "got"}}), orch(invocationInput={"actionGroupInvocationInput": {}}),
        json.dumps({"chunk": {"bytes": "an"}}), json.dumps({"chunk": {"bytes": "swer"}}),
    ]
    df = spark.createDataFrame([("c", i, e) for i, e in enumerate(events)] + [("n", 0, events[1])], "case_id string, ord int, event string")
    answers = transcripts.event_log_answers(df)
    assert {r["case_id"]: r["final_answer"] for r in answers.collect()} == {"c": "answer", "n": None}
    got = transcripts.assemble(transcripts.with_answer_steps(transcripts.event_log_steps(df), answers)).filter("case_id = 'c'").first()["steps"]
    assert [(s["type"], s["content"]) for s in got] == [("thought", "think"), ("tool_call", "Invoking g"), ("observation", "got"), ("answer", "answer")]
    assert got[1]["tool_call"]["arguments"] == {"a": '"b"'}


def test_argument_text(spark):
    df = spark.createDataFrame([('{"a": 1, "b": null}',), ("plain \"x\"",), ("[1]",), ("",)], "t string")
    got = [r["m"] for r in df.select(transcripts.argument_map(F.col("t")).alias("m")).collect()]
    assert got == [{"a": "1", "b": None}, {"input": '"plain \\"x\\""'}, {"input": '"[1]"'}, {"input": '""'}]


def test_generated_replies(spark):
    full = {"description": "d", "input": {"query": "q"}, "expected": {"ground_truth": "g"}, "tags": ["t"], "difficulty": "hard", "case_type": "negation", "source_excerpt": "s"}
    text = json.dumps([full, {"input": {"query": "q"}, "expected": {}}, {"input": {}}, 5])
    df = spark.createDataFrame([(1, f"```json\n{text}\n```"), (2, "sorry"), (3, "[]")], "id int, raw_text string")
    got = replies.parse_generated(df).orderBy("item_no").collect()
    assert [(r["id"], r["item_no"], r["difficulty"], r["case_type"]) for r in got] == [(1, 0, "hard", "negation"), (1, 1, "medium", "factual")]
    assert json.loads(got[0]["input"]) == {"query": "q"} and got[1]["tags"] == []
    bad = replies.reply_errors(df).collect()
    assert [r["id"] for r in bad] == [2] and bad[0]["error"].endswith("sorry")
    assert set(replies.importable(replies.parse_generated(df)).columns).isdisjoint({"case_type", "source_excerpt"})


def test_generated_agent_replies(spark):
    text = json.dumps([{"task": "t", "must_call_with": [{"tool": "s", "args": {"a": 1}}, {"args": {}}], "max_steps": "4"}, {"description": "no task"}, {"task": "u"}])
    df = spark.createDataFrame([(1, text), (2, '{"task": "t"}'), (3, "x")], "id int, raw_text string")
    got = traces.generated_to_case(replies.parse_generated_agent(df)).orderBy("item_no").collect()
    assert [(r["id"], r["task"], r["expected"]["max_steps"]) for r in got] == [(1, "t", 4), (1, "u", 6)]
    assert [(c["tool"], c["args"]) for c in got[0]["expected"]["must_call_with"]] == [("s", {"a": "1"})] and got[0]["tools"] == {}


def test_batch_runs_go_on_after_a_failure(spark):
    def agent(case):
        if case["n"] == 1:
            raise KeyError("lost")
        return {"final_answer": str(case["n"]), "total_latency_ms": 5 if case["n"] == 2 else 0, "total_cost_usd": 0.25}

    got = run_batch(spark.range(4).withColumnRenamed("id", "n"), agent, "n long").orderBy("n").collect()
    assert [r["final_answer"] for r in got] == ["0", None, "2", "3"] and got[1]["error"] == "'lost'"
    assert got[2]["latency_ms"] == 5 and got[0]["total_cost_usd"] == 0.25 and got[1]["steps"] == []


def test_row_wise_scoring_also_runs_on_a_stream(spark, tmp_path):
    from scorelake.operators.judge import parse_replies

    source = str(tmp_path / "in")
    spark.createDataFrame([("correctness", '{"answer": "correct"}')] * 3, "metric string, raw_text string").write.parquet(source)
    stream = parse_replies(spark.readStream.schema("metric string, raw_text string").parquet(source))
    run = stream.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [r["normalized"] for r in spark.table("scored").collect()] == [1.0, 1.0, 1.0]


def test_output_files_one_per_run(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "run_1.json").write_text('{"results": [\n{"vars": {"q": "a"},\n "success": true}\n]}\n')
    got = results.parse_results(results.read_outputs(spark, str(tmp_path))).collect()
    assert [(r["run_id"], r["dataset"], r["success"]) for r in got] == [("run_1", "d", True)]


def test_runner_output_keys_keep_number_spelling(spark):
    import hashlib

    given = {"b": 1.0, "a": [1, {"z": None}], "c": "é"}
    df = spark.createDataFrame([("a", json.dumps([{"vars": given}]))], "run_id string, json string")
    want = hashlib.sha256(json.dumps(given, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
    assert results.parse_results(df).first()["key"] == want


def test_json_that_models_write(spark):
    from scorelake.operators import judge

    rows = [
        ("faithfulness", '{"answer": "unsupported", "answer": "fully_supported", "reasoning": "r"}'),
        ("faithfulness", '{"answer": "fully_supported", "score": NaN}'),
        ("faithfulness", "no json"),
    ]
    labels = judge.METRIC_SCALES["faithfulness"]
    rows = [(m, t.replace("unsupported", labels[0]).replace("fully_supported", labels[-1])) for m, t in rows]
    got = judge.parse_replies(spark.createDataFrame(rows, "metric string, raw_text string")).collect()
    assert [r["label"] for r in got[:2]] == [labels[-1]] * 2 and got[2]["reason"].startswith("Could not parse judge response")


def test_generated_values_keep_their_spelling(spark):
    text = '[{"input": {"b": 1.0, "a": "x"}, "expected": {"n": 3}, "expected": {"z": null, "n": 2}}, 5, "t", null, {"input": {"q": 1}, "expected": {}, "tags": "odd"}]'
    rows = replies.parse_generated(spark.createDataFrame([(1, f"```json\n{text}\n```"), (2, "[1"), (3, "{}")], "i int, raw_text string")).collect()
    assert [(r["i"], r["item_no"], r["input"], r["expected"]) for r in rows] == [
        (1, 0, '{"b":1.0,"a":"x"}', '{"z":null,"n":2}'), (1, 4, '{"q":1}', "{}"),
    ]


def test_unknown_kinds_and_mock_latency(spark):
    lines = [("zzz", {"input": {}}), ("agent", {"input": {"task": "t"}, "tools": {"f": {"latency_ms": "soon"}}}), ("agent", {"input": {"task": "t"}, "tools": {"f": {"latency_ms": 5}}})]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in lines], "type string, line string")
    assert [r["errors"] for r in cases.validate_cases(df).collect()] == [
        ["type: not one of qa, classification, instruction, rag, agent"], ["tools: not an object of mock responses"], [],
    ]


def test_trace_checks_name_the_line(spark):
    step = {"type": "tool_call", "tool": "f", "arguments": {}}
    good = {"task": "t", "steps": [step]}
    bad = [
        {"task": "t", "steps": [step | {"arguments": [1]}]}, {"task": "t", "steps": [step | {"tool": 3}]}, good | {"metadata": []},
    ]
    lines = [(4, json.dumps(bad[0])), (3, json.dumps(bad[1])), (2, json.dumps(bad[2])), (1, json.dumps(good)), (5, json.dumps(good | {"metadata": None}))]
    df = spark.createDataFrame(lines, "line_no int, line string")
    errors = {r["line_no"]: r["error"] for r in results.validate_traces(df).collect()}
    wrong = "steps: tool not a string or arguments not an object"
    assert errors == {1: None, 2: "metadata: not an object", 3: wrong, 4: wrong, 5: None}
    with pytest.raises(ValueError, match="on line 2: metadata"):
        results.read_traces(df)
