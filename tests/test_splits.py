"""Large files read split by split: line numbers and elements of one long list, against plain reading."""

import json
import random

import pytest
from pyspark.sql import functions as F

from scorelake.sources import cases, results
from scorelake.sources.json_splits import split_documents


@pytest.fixture
def small_splits(spark):
    """Splits of 1,500 bytes, several of them in a task."""
    names = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_line_numbers_over_splits(small_splits, tmp_path):
    spark, rng = small_splits, random.Random(1)
    want = []
    for name in ("a", "b", "c"):
        (tmp_path / name).mkdir()
        lines = [rng.choice(["", "  ", "\t", f'{{"n": {i}, "é": "{"x" * rng.randrange(90)}"}}']) for i in range(rng.randrange(1, 400))]
        (tmp_path / name / "cases.jsonl").write_bytes("".join(x + rng.choice(["\n", "\r\n"]) for x in lines).encode())
        kept = [(i, x.strip()) for i, x in enumerate(lines, 1) if x.strip()]
        want += [(name, no, item, x) for item, (no, x) in enumerate(kept, 1)]
    got = cases.read_numbered_lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 5
    assert sorted((r["dataset"], r["line_no"], r["item_no"], r["line"]) for r in got.collect()) == sorted(want)


def test_line_numbers_by_a_shuffle(small_splits, tmp_path, monkeypatch):
    monkeypatch.setattr(cases, "BROADCAST_SPLITS", 1)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "cases.jsonl").write_text("".join(f"{i} {'y' * 40}\n\n" for i in range(200)))
    got = cases.read_numbered_lines(small_splits, str(tmp_path)).collect()
    assert sorted((r["line_no"], r["item_no"], r["line"][:4].split()[0]) for r in got) == [(2 * i + 1, i + 1, str(i)) for i in range(200)]


def document(rng, n, shape):
    text = lambda: rng.choice(["plain", 'a "quoted" one', "br}ace{s [and], commas", "\\", "é\n", "end\\\\", '"results": [', ""]) * rng.randrange(3)
    items = [
        rng.choice(
            [
                {"vars": {"q": text(), "deep": {"results": [1, {"results": []}]}}, "success": rng.random() < 0.5, "score": rng.random()},
                {"provider": {"id": "p"}, "vars": {}, "latencyMs": 5},
                {"vars": {"long": text() * 200}},
            ]
        )
        for _ in range(n)
    ]
    if rng.random() < 0.3 and n:
        items[rng.randrange(n)] = rng.choice([None, 5, "text, with } and ]", [], [1, {"a": 2}]])
    stats = {"tokenUsage": {"total": n, "prompt": 1}, "note": text()}
    whole = {
        "list": items,
        "flat": {"other": {"results": [{"not": "this"}]}, "results": items, "after": [text()]},
        "nested": {"x": [1], "results": {"prompts": [text(), {"results": [3]}], "results": items, "stats": stats}, "other": {"results": [{"no": 1}]}},
        "none": {"results": {"prompts": [{"results": [1]}], "stats": stats}, "more": {"results": [2]}},
    }[shape]
    return items if shape != "none" else [], whole


@pytest.mark.parametrize("shape", ["list", "flat", "nested", "none"])
def test_elements_equal_a_plain_reading(small_splits, tmp_path, shape):
    rng = random.Random(shape)
    want, shells = {}, {}
    for i in range(6):
        items, whole = document(rng, [0, 1, 2, 90, 3, 20][i], shape)
        dumped = json.dumps(whole, ensure_ascii=i % 2 == 0, indent=[None, 2, None][i % 3]) + ["", "\n", " \n "][i % 3]
        (tmp_path / f"run{i}.json").write_text(dumped, encoding="utf-8")
        want[f"run{i}.json"] = items
        empty = json.loads(dumped)
        if shape == "list":
            empty = []
        elif shape == "flat":
            empty["results"] = []
        elif shape == "nested":
            empty["results"]["results"] = []
        shells[f"run{i}.json"] = empty
    elements, shell = split_documents(small_splits, str(tmp_path))
    got = {name: {} for name in want}
    for r in elements.collect():
        place = got[r["file_path"].rsplit("/", 1)[1]]
        assert r["ord"] not in place
        place[r["ord"]] = json.loads(r["element"])
    assert {n: [x[i] for i in sorted(x)] for n, x in got.items()} == want
    assert all(sorted(x) == list(range(len(x))) for x in got.values())
    assert {r["file_path"].rsplit("/", 1)[1]: json.loads(r["shell"]) for r in shell.collect()} == shells


def test_large_results_equal_small_ones(small_splits, tmp_path, monkeypatch):
    rng = random.Random(5)
    for i, shape in enumerate(["list", "flat", "nested", "nested", "none"]):
        (tmp_path / f"d{i % 2}").mkdir(exist_ok=True)
        items, whole = document(rng, 40, shape)
        if shape != "none":
            items[:] = [x for x in items if isinstance(x, dict)]
        (tmp_path / f"d{i % 2}" / f"r{i}.json").write_text(json.dumps(whole))
    good = [x.name for x in tmp_path.glob("*/*.json")]
    for i, text in enumerate(['[{"vars": {}},]', '{"results": [{"vars": {}}, {"vars" {}}]}', '{"results": [{"vars": {}}]', '[{"vars": {}}] more', "", '{"results": [,]}']):
        (tmp_path / "d0" / f"bad{i}.json").write_text(text)
    plain = results.read_outputs(small_splits, str(tmp_path)).where(~F.col("run_id").startswith("bad"))
    key = lambda rows: sorted(map(tuple, rows.collect()), key=str)
    want, counts = results.parse_results(plain), results.parse_token_stats(plain)
    for most in (1 << 20, 1):
        monkeypatch.setattr("scorelake.sources.json_splits.BROADCAST_SPLITS", most)
        monkeypatch.setattr(results, "BROADCAST_SPLITS", most)
        rows, stats = results.load_results(small_splits, str(tmp_path))
        assert key(rows.select(want.columns)) == key(want) and want.count() > 60
        assert key(stats.select(counts.columns)) == key(counts) and stats.count() == len(good)
