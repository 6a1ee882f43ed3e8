import math
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from scorelake.operators import crawl, documents
from scorelake.sources.documents import check_source, object_store_path, read_documents, require_documents


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>Hello <b>world</b></p>", "Hello world"),
        ("a<script>var x = '</p>';\n</SCRIPT>b<STYLE type='x'>p{}</style>c", "a b c"),
        ("&amp;lt; &lt;b&gt; &quot;x&quot; &#39;y&#39;&nbsp;z", "< <b> \"x\" 'y' z"),
        ("a\n\n\n\n\nb   \t c", "a\n\nb c"),
        (" \n<div>\n x </div> ", "x"),
        ("1 < 2 and 3 > 2", "1 2"),
        ("<script>never closed", "never closed"),
    ],
)
def test_html_to_text(spark, html, text):
    assert spark.range(1).select(documents.html_to_text(F.lit(html)).alias("t")).first()["t"] == text


def test_links_resolve_like_urllib(spark):
    bases = [
        "http://h.com", "http://h.com/", "https://h.com/a/b/c.html", "http://h.com/a/b/?q=1", "http://h.com/a//b/x?y#z",
        "https://H.com:80/a;p/b", "http://h/a/b/../c/d", "http://h?x=1",
    ]
    hrefs = [
        "/x", "x", "./x", "../x", "../../x", "../../../../x", "/a/../b", "/a/./b/", "?q", "http://o.com/p?q", "//o.com/p",
        "mailto:a@b", "HTTP://O.com/x", "x/y/", "x//y", "//o", "a/..", "a/.", "..", ".", "/..", "x?y=/../z", "x;p?q",
        "/x//y", "http:foo", "x:y", "a/b/../../c/", "/", "ftp://x/y", "http://o.com/../x", "a///../b", "/x?", "x?", "http://o.com?", "https://o.com/a?b?", "/a?b=/../c",
    ]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for r in df.select("b", "h", documents.resolve_url(F.col("b"), F.col("h")).alias("u")).collect():
        want = urljoin(r["b"], r["h"]).split("#")[0]
        assert r["u"] == (want if want.startswith(("http://", "https://")) else None), (r["b"], r["h"])


def test_page_links_order_and_forms(spark):
    html = (
        "<a href=\"/b\">1</a><a HREF='a#top'>2</a><a href=\"#x\">no</a><a href=\"/b\">again</a>"
        "<a href=\"mailto:x\">m</a><a href=\"https://o.test/p q\">cut at the blank</a>"
    )
    got = spark.range(1).select(documents.page_links(F.lit(html), F.lit("http://h.test/d/x")).alias("l")).first()["l"]
    assert got == ["http://h.test/b", "http://h.test/d/a", "https://o.test/p"]


@pytest.mark.parametrize(
    "url, name",
    [
        ("http://h/a/b", "b.txt"), ("http://h/a/b.html", "b.html"), ("http://h/a/", "a.txt"), ("http://h/x?y=1.2", "x.txt"),
        ("http://h/x.md?y=1", "x.md?y=1"), ("///", "index.txt"),
    ],
)
def test_filenames(spark, url, name):
    assert spark.range(1).select(documents.page_filename(F.lit(url)).alias("n")).first()["n"] == name


@pytest.mark.parametrize(
    "url, prefix",
    [("http://h/a/b", "http://h/a/"), ("http://h/a/b/", "http://h/a/b/"), ("http://h", "http://h/"), ("http://h/a?x=/y/", "http://h/")],
)
def test_prefixes(spark, url, prefix):
    assert spark.range(1).select(documents.url_prefix(F.lit(url)).alias("p")).first()["p"] == prefix


def test_page_documents_sniff_html_and_are_a_source(spark):
    pages = spark.createDataFrame(
        [("http://h/a", " \n<b>x</b>", None), ("http://h/b.txt", " 1 < 2 & <b> \n", "text/plain"), ("http://h/c", "x <i>y</i>", "text/html; a")],
        "url string, html string, content_type string",
    )
    got = {r["filename"]: r["content"] for r in check_source(documents.page_documents(pages)).collect()}
    assert got == {"a.txt": "x", "b.txt": "1 < 2 & <b>", "c.txt": "x y"}
    with pytest.raises(TypeError):
        check_source(pages)


def walk(text, limit, mark):
    """Chunks by the rule: the last mark in the window, if it is behind its start, else the full window."""
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    while at < len(text):
        window = text[at : at + limit]
        if at + limit < len(text) and window.rfind(mark) > 0:
            window = window[: window.rfind(mark)]
        out.append(window.strip())
        at += len(window)
    return [p for p in out if p]


def test_chunks(spark):
    rng = random.Random(4)
    texts = ["", " short ", "x" * 10, "x" * 11, "ab\n\n" * 9, "\n\n" * 20, "é\U0001F600" * 12, "word " * 30]
    texts += ["".join(rng.choice("ab \n") for _ in range(rng.randrange(120))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    got = {}
    for r in documents.chunk_documents(df, ("i",), max_chars=10).orderBy("i", "chunk_no").collect():
        got.setdefault(r["i"], []).append(r["text"])
        assert len(walk(texts[r["i"]], 10, "\n\n")) == r["chunks"]
    assert all(got.get(i, []) == walk(t, 10, "\n\n") for i, t in enumerate(texts))


@pytest.mark.parametrize("count, n", [(10, 3), (3, 10), (7, 7), (1, 5), (100, 3)])
def test_quota_documents(spark, count, n):
    got = documents.quota_documents(spark.range(n).select(F.col("id").alias("path")), count, ["path"]).orderBy("path")
    want, left, each = [], count, max(1, math.ceil(count / n))
    for _ in range(n):
        want.append(max(0, min(each, left)))
        left -= want[-1]
    assert [r["quota"] for r in got.collect()] == want


def test_remaining_quota_of_groups(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.randrange(4)) for g, size in (("a", 50), ("b", 1), ("c", 7)) for i in range(size)]
    df = spark.createDataFrame(rows, "g string, i int, made int").repartition(4)
    got = {(r["g"], r["i"]): r["quota"] for r in documents.remaining_quota(df, F.lit(20), ["i"], "made", ["g"]).collect()}
    alone = {r["i"]: r["quota"] for r in documents.remaining_quota(df.filter("g = 'a'").drop("g"), F.lit(20), ["i"], "made").collect()}
    for g in "abc":
        mine = [r for r in rows if r[0] == g]
        each, done = max(1, math.ceil(20 / len(mine))), 0
        for _, i, made in mine:
            assert got[g, i] == max(0, min(each, 20 - done))
            assert g != "a" or alone[i] == got[g, i]
            done += made


def breadth_first(links, seed, prefix, cap):
    """The crawl as a queue: visited once, only known pages count, links below the prefix are followed."""
    queue, seen, reached = [seed], set(), []
    while queue and len(reached) < cap:
        url = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        if url in links:
            reached.append(url)
            queue += [u for u in links[url] if u.startswith(prefix)]
    return reached


@pytest.mark.parametrize("seed_no, cap", [(1, 50), (2, 7), (3, 1), (4, 12)])
def test_crawl_order(spark, seed_no, cap):
    rng = random.Random(seed_no)
    urls = [f"http://h.test/d/{i}" for i in range(25)] + ["http://h.test/other", "http://o.test/d/1"]
    links = {u: [rng.choice(urls) for _ in range(rng.randrange(5))] for u in urls if rng.random() < 0.8}
    links[urls[0]] = urls[1:4]
    links[urls[1]] = [urls[0], urls[5]]
    rows = [(u, "<p>" + "".join(f'<a href="{t}">' for t in dict.fromkeys(out))) for u, out in links.items()]
    pages = spark.createDataFrame(rows, "url string, html string")
    seeds = spark.createDataFrame([(urls[0],), (urls[1],), ("http://h.test/d/none",)], "url string")
    got = {}
    for r in crawl.crawl(pages, seeds, cap).orderBy("seed", "position").collect():
        assert r["position"] == len(got.setdefault(r["seed"], []))
        got[r["seed"]].append(r["url"])
    for seed in urls[:2]:
        assert got[seed] == breadth_first({u: list(dict.fromkeys(o)) for u, o in links.items()}, seed, "http://h.test/d/", cap)
    assert "http://h.test/d/none" not in got


def test_read_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.TXT").write_bytes(b" caf\xc3\xa9 \xff\n")
    (tmp_path / "sub" / "a.md").write_text("# title\n\n")
    (tmp_path / "c.json").write_text("{}")
    got = read_documents(spark, str(tmp_path)).orderBy("source").collect()
    assert [(r["filename"], r["content"]) for r in got] == [("b.TXT", "café �"), ("a.md", "# title")]
    assert got[1]["source"] == str(tmp_path / "sub" / "a.md")
    assert [r["filename"] for r in read_documents(spark, str(tmp_path), recursive=False).collect()] == ["b.TXT"]
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "x.json").write_text("{}")
    with pytest.raises(ValueError):
        require_documents(read_documents(spark, str(tmp_path / "only")), "only")


def test_object_store_paths():
    assert object_store_path("s3://b/docs/x") == "s3a://b/docs/x*" and object_store_path("s3://b") == "s3a://b/*"
    with pytest.raises(ValueError):
        object_store_path("/tmp/x")


def test_chunks_count_characters_and_cut_at_the_edge(spark):
    texts = ["😀" * 25, "a" * 8 + "\n\n" + "b" * 8, "a" * 9 + "\n\n" + "b" * 8, "\n\n" + "c" * 12, "  x  " * 5, "short \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    got = {}
    for r in documents.chunk_documents(df, ("i",), max_chars=10).orderBy("i", "chunk_no").collect():
        got.setdefault(r["i"], []).append(r["text"])
    assert got[0] == ["😀" * 10, "😀" * 10, "😀" * 5] and got[1] == ["a" * 8, "b" * 8]
    assert got[2] == ["a" * 9, "b" * 8] and got[3] == ["c" * 8, "c" * 4] and got[5] == ["short \n"]


def test_a_long_conversation_is_one_case(spark, tmp_path):
    from scorelake.plans import bindings

    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"word {i}") for i in range(200)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    one = bindings.compact_trajectories(spark, str(tmp_path)).collect()
    assert len(one) == 1 and one[0]["step_count"] == 200 and one[0]["tool_call_count"] == 100
    assert (one[0]["task"], one[0]["final_answer"]) == ("word 0", "word 199")
    assert len(bindings.trajectories(spark, str(tmp_path)).first()["steps"]) == 200


def test_a_level_shuffles_its_candidates_only(spark):
    links = spark.createDataFrame([(f"u{i}", [f"u{i + 1}"]) for i in range(50)], "url string, links array<string>")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    name = crawl.lay_out(links)
    try:
        level = spark.createDataFrame([("s", f"u{i}") for i in range(3)], "seed string, url string")
        found = spark.createDataFrame([("s", "u", f"u{i % 9}", i) for i in range(20)], "seed string, prefix string, url string, _rank long")
        fresh = crawl.probe(found, level, spark.table(name))
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert sorted((r["url"], r["_rank"], r["links"][0]) for r in fresh.collect()) == [(f"u{i}", i, f"u{i + 1}") for i in range(3, 9)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sql(f"drop table {name}")
