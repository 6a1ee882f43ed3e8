"""Operators that learn or compare across documents, against brute force and held-out rows; edge rows of every operator."""

import collections
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import common, decontaminate, langid, mtree, ppm, quality, simhash
from scorelake.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="the shared tables are not here")
LOWER = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


# --- PPM ----------------------------------------------------------------------------------------------------------


def plain_scores(rows):
    """Base score and PPM score of (learn, text) rows, one symbol at a time."""
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
    marked = lambda t: b"\xfe" * ppm.ORDER + (t or "").translate(LOWER).encode() + b"\xff"
    counts, trie = collections.Counter(), collections.defaultdict(collections.Counter)
    for learn, text in rows:
        if learn:
            counts.update(words(text))
            b = marked(text)
            for p in range(ppm.ORDER, len(b)):
                for k in range(ppm.ORDER + 1):
                    trie[b[p - k : p]][b[p]] += 1
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for _, text in rows:
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words(text))
        b, score = marked(text), 0.0
        for p in range(ppm.ORDER, len(b)):
            excluded = set()
            for k in range(ppm.ORDER, -1, -1):
                node = trie.get(b[p - k : p])
                if not node:
                    continue
                left = {s: n for s, n in node.items() if s not in excluded}
                if b[p] in left:
                    score += math.log10((left[b[p]] - 0.5) / sum(left.values()))
                    break
                if left:
                    score += math.log10(0.5 * len(left) / sum(left.values()))
                excluded |= node.keys()
            else:
                score += math.log10(1 / (256 - len(excluded)))
        out.append((len(words(text)), sum(counts[w] > 0 for w in words(text)), total, base, score))
    return out


def test_ppm_equals_plain_coding(spark):
    rng = random.Random(1)
    words = ["the", "The", "then", "hen", "é", "on", "once", "x1", "zz"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "new\tWORDS\nhere ~"), (62, "new\tWORDS\nhere ~"), (63, "a" * 3000)]
    learn = lambda i: i is not None and i % 3 != 0
    docs = frame(spark, [*rows, (None, "the then")], block="clash", learn=True, score=1.0)
    got = ppm.scores(docs, F.col("doc_id") % 3 != 0, block_bytes=500).collect()
    want = plain_scores([(learn(i), t) for i, t in [*rows, (None, "the then")]])
    key = lambda r: (r[0] is not None, r[0] or 0)
    got = sorted(([r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]] for r in got), key=key)
    expected = sorted(([i, *w] for (i, _), w in zip([*rows, (None, "")], want, strict=True)), key=key)
    assert len(got) == len(expected)
    for g, w in zip(got, expected, strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-6)


def test_ppm_with_nothing_to_learn_from(spark):
    got = ppm.scores(frame(spark, [(1, "ab"), (2, None)]), F.lit(False)).orderBy("doc_id").collect()
    assert [r["score"] for r in got] == pytest.approx([3 * math.log10(1 / 256), math.log10(1 / 256)])
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(2, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert ppm.scores(frame(spark, [(1, "ab")]).limit(0), F.lit(True)).count() == 0


def test_adaptive_code_length(spark):
    got = {r["doc_id"]: r["bits"] for r in ppm.adaptive_bits(frame(spark, [(1, "ab" * 300), (2, ""), (3, None), (4, "qwertzuiop")])).collect()}
    assert got[2] == got[3] == 8.0 and got[1] < 100 and got[4] > 60


# --- decontamination ----------------------------------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").encode().translate(common.ASCII_LOWER))


def plain_report(docs, items, window):
    windows = collections.defaultdict(set)
    for name, text in items:
        own = words_of(text)
        for j in range(max(1, len(own) - window + 1)) if own else ():
            windows[tuple(own[j : j + window])].add(name)
    out = []
    for doc_id, text in docs:
        own, hit, found = words_of(text), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(own) - n + 1):
                if tuple(own[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[tuple(own[j : j + n])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(own), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination_equals_plain_search(spark, block_bytes):
    rng = random.Random(3)
    say = lambda n, kinds="abcde": " ".join(rng.choice(kinds) for _ in range(n))
    items = [(i, say(rng.randrange(1, 9))) for i in range(25)] + [(90, "A,a.A"), (91, ""), (92, None), (3, "e e e e e e"), (None, "Éa b")]
    docs = [(i, say(rng.randrange(60), "abcdeXé")) for i in range(80)] + [(80, None), (81, ""), (81, "..."), (82, "éa, B a-a-a"), (None, say(30))]
    docs += [(83, "a " * 3000), (83, "a " * 3000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.search_documents(frame(spark, docs, n_words=5, __hits="clash"), bench, window=4, block_bytes=block_bytes)
    got = [(r["doc_id"], r["__n_words"], len(r["__hits"]), len(r["__items"]), decontaminate.items_digest(r["__items"]), bool(r["__hits"])) for r in found.collect()]
    assert sorted(got, key=str) == sorted(plain_report(docs, items, 4), key=str)
    if block_bytes > 1000:
        rows = decontaminate.report(frame(spark, docs), bench, window=4).drop("longest", "longest_at").collect()
        assert sorted(map(tuple, rows), key=str) == sorted(got, key=str)


def test_longest_verbatim_match(spark):
    bench = spark.createDataFrame([("i", "one two three four five six seven"), ("j", "four five six nine")], "item_id string, text string")
    docs = frame(spark, [(1, "x One two, three four! y two three four five six z"), (2, "nothing")])
    got = {r["doc_id"]: (r["longest"], r["longest_at"]) for r in decontaminate.report(docs, bench, window=3).collect()}
    assert got == {1: (5, 6), 2: (0, 0)}
    assert [r["doc_id"] for r in decontaminate.keep_clean(docs, bench, window=3).collect()] == [2]
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == 2
    assert decontaminate.report(docs.limit(0), bench).count() == 0


def test_longest_match_of_every_document():
    rng = random.Random(20)
    say = lambda n: [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(n)]
    items = [say(40) for _ in range(6)] + [say(5)]
    docs = [[b"X", *items[0][3:30]] for _ in range(5)] + [[*items[0][3:18], b"X"], [*items[0][3:15]], [b"X", *items[1]], [b"X"], []]
    docs += [[*say(9), *items[2][5 : 5 + n], *say(9)] for n in range(3, 30)]
    block = decontaminate.block_of([(str(i), b" ".join(x)) for i, x in enumerate(items)], 10)
    _, _, longest, at = decontaminate.shard_hits(block, docs)
    held = {tuple(x[i:j]) for x in items for i in range(len(x)) for j in range(i + block.least, len(x) + 1)}
    want = []
    for d in docs:
        found = [(j - i, -i) for i in range(len(d)) for j in range(i + block.least, len(d) + 1) if tuple(d[i:j]) in held]
        want.append((max(found)[0], -max(found)[1]) if found else (0, 0))
    assert list(zip(longest.tolist(), at.tolist(), strict=True)) == want
    assert {x for x, _ in want[:5]} == {27} and want[5][0] == 15 and want[6][0] == 12


# --- SimHash ------------------------------------------------------------------------------------------------------


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b) and find(a) != find(b):
                parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_links_within_two_bits(spark, hot):
    rng = random.Random(7)
    values = set()
    for _ in range(40):
        start = rng.getrandbits(64)
        values.add(start)
        for _ in range(rng.randrange(12)):
            for _ in range(rng.randrange(1, 4)):
                start ^= 1 << rng.randrange(64)
            values.add(start)
    values |= {1 << i for i in range(64)} | {0, (1 << 64) - 1}
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in simhash.components(simhash.links(df, 2, hot)).collect()}
    want = plain_components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    groups = lambda of: sorted(sorted(g) for g in _classes(of).values() if len(g) > 1)
    assert groups(roots) == groups(want)


def _classes(of):
    out = collections.defaultdict(list)
    for member, root in of.items():
        out[root].append(member)
    return out


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert len({roots[i] for i in range(301)}) == 1 and roots[1000] == roots[1001] != roots[0] and len(roots) == 303
    assert simhash.components(edges.limit(0)).count() == 0


def test_size_estimates_do_not_grow_with_the_rounds_of_components(spark):
    # a path takes many rounds; five digits of an estimate are 25 after a round, 125 after the next, and so on
    edges = spark.range(400).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    roots = simhash.components(edges)
    assert roots._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 40
    assert roots.count() == 401 and roots.select("root").distinct().count() == 1


def plain_fingerprint(text):
    import xxhash

    own = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().translate(common.ASCII_LOWER)) if w]
    parts = [b" ".join(own[i : i + 3]) for i in range(len(own) - 2)] if len(own) >= 3 else [b" ".join(own)] if own else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("many", [simhash.MANY, 1, 5])
def test_grouped_rows(spark, monkeypatch, many):
    monkeypatch.setattr(simhash, "MANY", many)
    rng = random.Random(8)
    long = [rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(600)]
    texts = [" ".join(long), " ".join([*long[:300], "q", *long[301:]]), " ".join(long).upper(), "a b", "A\tb", "c", None, "", " \n", "x y z w"]
    rows = [(i + 10, t) for i, t in enumerate(texts)] + [(3, "c"), (3, "c"), (None, "a b"), (None, "lonely row")]
    got = simhash.grouped(frame(spark, rows, fp="clash")).select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fp"), "component_id").collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = collections.defaultdict(lambda: None)
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[roots[p]] = i if least[roots[p]] is None else min(i, least[roots[p]])
    want = [(i, f"{p:016x}", least[roots[p]]) for (i, _), p in zip(rows, prints, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.grouped(frame(spark, rows).limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(9)
    long = [rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(600)]
    near = " ".join([*long[:300], "q", *long[301:]])
    rows = [(5, " ".join(long)), (4, near), (4, "another text under an id that recurs"), (7, "one two"), (7, "one two"), (8, "One\ttwo")]
    rows += [(None, "one two"), (None, "alone without an id"), (None, "alone without an id"), (9, None), (3, ""), (None, " ")]
    docs = frame(spark, rows, fp=1, row_digest_0="clash")
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    groups = plain_components(sorted({plain_fingerprint(t) for _, t in rows}), lambda a, b: (a ^ b).bit_count() <= 2)
    best = {}
    for i, t in rows:
        root = groups[plain_fingerprint(t)]
        best[root] = min(best.get(root, (True, 0)), (i is None, i or 0))
    got = kept.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted(best.values())
    assert {(r["doc_id"], r["text"]) for r in got} <= set(rows)
    assert simhash.keep_representatives(docs.limit(0)).count() == 0


# --- search -------------------------------------------------------------------------------------------------------


def plain_top(rows, every, k):
    vectors = [(i, [math.floor(256.0 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in vectors:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in vectors if i != q and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 17, 60])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(mtree, "PAGE", 7)
    monkeypatch.setattr(mtree, "FAN", 3)
    monkeypatch.setattr(mtree, "TREE_ROWS", 64)
    rng = random.Random(10)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(1, 300)]
    rows += [(i, [0.5, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(300, 340)]  # ties
    rows += [(400, None), (405, [0.1, None] + [0.0] * 4), (410, [float("nan")] + [0.0] * 5), (415, [float("inf")] * 6), (None, [0.2] * 6), (420, [1e5, -1e5]), (421, [2.0, 1e6]), (430, []), (440, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = mtree.top_k(df, F.col("vec_id") % 5 == 0, k=4, block=block)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 5, 4)


def test_search_of_nothing(spark):
    df = spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<float>")
    assert mtree.top_k(df, F.col("vec_id") % 50 == 0).count() == 0
    assert mtree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(50, [0.5])], "vec_id long, embedding array<float>")
    assert mtree.top_k(alone, F.col("vec_id") % 50 == 0).count() == 0


# --- learned models -----------------------------------------------------------------------------------------------


def prose(rng, lang):
    words = {"en": "the of and this that with for are then there".split(), "de": "der die das und nicht mit für sich auch über".split(), "fr": "le la les des que dans pour est être où".split()}[lang]
    return " ".join(rng.choice(words) for _ in range(rng.randrange(3, 60)))


def test_language_on_held_out_rows(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, lang), lang) for i, lang in enumerate(["en", "de", "fr"] * 80)]
    df = spark.createDataFrame([*rows, (900, "the of", None), (901, None, "en"), (None, "the", "en")], "doc_id long, text string, lang string")
    model = langid.fit(df.where(F.coalesce(common.id_remainder("doc_id", 5) != 0, F.lit(False))))
    assert model.languages == ("de", "en", "fr")
    got = langid.predict(df.withColumn("score", F.lit("clash")), model).join(df, "doc_id")
    held = [r for r in got.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["lang"]]
    assert len(held) > 30 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in held)
    again = langid.fit(df.where(F.coalesce(common.id_remainder("doc_id", 5) != 0, F.lit(False))).repartition(3))
    assert (again.scores == model.scores).all() and again.temperature == model.temperature


def test_language_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 ?!"), (4, "é"), (5, "x" * 200_000), (None, "and")], "doc_id long, text string")
    rng = random.Random(12)
    train = spark.createDataFrame([(i, prose(rng, lang), lang) for i, lang in enumerate(["en", "fr"] * 40)], "doc_id long, text string, lang string")
    for model in (langid.fit(train), langid.fit(train.limit(0)), langid.fit(train.where("lang = 'en'"))):
        got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
        for i in (1, 2, 3):
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
        assert got[4]["lang_pred"] in (*model.languages, "und") and len(got) == 6
    kept = langid.keep_accepted(train.withColumn("lang_pred", F.lit("own")), langid.fit(train))
    assert kept.columns == [*train.columns, "lang_pred"] and kept.count() >= 78


def test_quality_on_held_out_rows(spark):
    rng = random.Random(13)
    good = lambda: ". ".join(prose(rng, "en").capitalize() for _ in range(4))
    bad = lambda: rng.choice([" | ".join(prose(rng, "en").split()), "!! ".join(prose(rng, "en").upper().split()), "$$$ ".join(prose(rng, "de").split())])
    rows = [(i, bad() if i % 4 == 0 else good(), int(i % 4 != 0)) for i in range(400)]
    docs = frame(spark, [r[:2] for r in rows] + [(900, None), (901, ""), (None, "x"), (902, "a" * 100_000)], score="clash")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (905, None), (906, 7)], "doc_id long, quality int")
    model = quality.fit(docs, labels.where(F.coalesce(common.id_remainder("doc_id", 5) != 0, F.lit(False))))
    scored = quality.score(docs, model)
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == bool(q) for i, q in held) / len(held) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 404
    top = quality.select_top(scored, 0.25)
    assert 0.2 * 404 < top.count() < 0.3 * 404
    marked = {r["doc_id"]: (r["raw"], r["selected"]) for r in quality.mark_top(scored, 0.25).where("doc_id < 400").collect()}
    assert min(x for x, s in marked.values() if s) > max(x for x, s in marked.values() if not s)
    assert quality.mark_top(scored.limit(0), 0.25).count() == 0
    for only in (labels.limit(0), labels.where("quality = 1")):
        flat = quality.fit(docs, only)
        assert len({r["score"] for r in quality.score(docs, flat).collect()}) == 1
    assert quality.score(docs.limit(0), model).count() == 0


# --- queries and pipeline -----------------------------------------------------------------------------------------

COLUMNS = {
    "op1": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op2": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op3": {"doc_id": "bigint", "n_tokens": "bigint"},
    "op4": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op6": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op7": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op9": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op12": dict.fromkeys(("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), "bigint") | {"rank": "int"},
    "op13": dict.fromkeys(("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), "bigint") | {"ends_sha256": "string"},
}


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_give_their_columns(spark, name):
    found = QUERIES[name](spark, str(DATA))
    wanted = COLUMNS[name.split("_")[0]]
    assert {k: v for k, v in found.dtypes if k in wanted} == wanted
    documents = spark.read.parquet(f"{DATA}/documents.parquet").count()
    if name in ORACLES:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for table in ("embeddings", "documents", "benchmark", "conversations"):
            con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
        assert sorted(map(tuple, found.collect()), key=str) == sorted(con.sql(ORACLES[name]).select(*found.columns).fetchall(), key=str)
    if "doc_id" in wanted:
        assert found.count() == documents == found.select("doc_id").distinct().count()


def test_there_is_one_query_an_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(14)
    text = lambda lang, n=70: " ".join("".join(rng.choice({"en": "thneoras", "de": "üerndschi"}[lang]) for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage, base = text("en", 30), text("en", 900)
    near = base.split()
    near[20] = near[20] + "e"
    near = " ".join(near)
    assert (plain_fingerprint(base) ^ plain_fingerprint(near)).bit_count() <= 2
    texts = {i: text("en" if i % 2 else "de") for i in range(60)}
    texts |= {100: base, 101: base, 102: near, 110: f"{text('en')} {passage} {text('en')}", 120: text("en") + " write to joe@example.org or +1 212 555 0100", 130: None, 131: "", 132: "12 34 !!"}
    rows = [(i, t, None if t is None else ("de" if i < 60 and i % 2 == 0 else "en"), "s", len(t or "")) for i, t in texts.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        seen[name] = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert [(f.name, f.dataType) for f in seen[name].schema] == [(f.name, f.dataType) for f in docs.schema]
        docs = seen[name]
    ids = {name: {r["doc_id"] for r in df.collect()} for name, df in seen.items()}
    assert ids["language"] == set(texts) - {130, 131, 132}
    assert ids["near_duplicates"] == ids["language"] - {101, 102}
    assert ids["benchmark_passages"] == ids["near_duplicates"] - {110} == ids["personal_data"] == ids["tokens"]
    cleaned = seen["personal_data"].where("doc_id = 120").first()
    assert cleaned["text"].endswith("write to [EMAIL] or [PHONE]") and cleaned["n_chars"] == len(cleaned["text"])
    same = {r["doc_id"]: r["text"] for r in seen["personal_data"].where("doc_id < 60").collect()}
    assert same == {i: texts[i] for i in range(60)}
    last = {r["doc_id"]: r for r in seen["tokens"].collect()}
    assert last[5]["decoded_sha256"] == hashlib.sha256(texts[5].encode()).hexdigest()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in last.values())
    whole = pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in whole.collect()} == ids["tokens"] and np.sum([r["n_tokens"] for r in last.values()]) > 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(23)
    text = lambda lang, n=60: " ".join("".join(rng.choice({"en": "thneoras", "de": "üerndschi"}[lang]) for _ in range(rng.randrange(2, 9))) for _ in range(n))
    rows = [(i, text("en" if i % 2 else "de")) for i in range(60)]
    same, long = text("en"), text("en", 60_000)
    odd = [(100, text("en")), (100, text("de")), (101, same), (101, same), (None, text("en")), (None, text("en")), (None, same), (102, long), (103, long + " x"), (104, None), (105, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, None if t is None else "en" if set(t) & set("to") else "de", "s", len(t or "")) for i, t in rows + odd]
    spark.createDataFrame([("a", "no such passage anywhere in the documents of this test at all")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, kept in (("none", []), ("all", full)):
        spark.createDataFrame(kept, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(str(tmp_path / "benchmark.parquet")).write.parquet(str(tmp_path / name / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
    got = pipeline.run(spark, str(tmp_path / "all")).collect()
    # wholly repeated rows and copies count once, an id that recurs with another text and rows without an id stay
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter([*range(60), 100, 100, 101, None, None, 102])
    sizes = {r["doc_id"]: r["n_tokens"] for r in got}
    assert sizes[102] > 60_000


def test_ties_of_learned_models(spark):
    rows = [(i, "the same words in every text" if i < 40 else "andere wörter in jedem text") for i in range(80)]
    docs = frame(spark, rows)
    train = docs.withColumn("lang", F.when(F.col("doc_id") < 40, "en").otherwise("de"))
    model = langid.fit(train)
    named = langid.predict(docs, model).collect()
    assert {(r["doc_id"] < 40, r["lang_pred"]) for r in named} == {(True, "en"), (False, "de")}
    assert len({r["score"] for r in named if r["doc_id"] < 40}) == 1
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(80)], "doc_id long, quality int")
    scores = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len({r["score"] for r in scores if r["doc_id"] < 40}) == 1


def test_models_equal_a_plain_recomputation(spark):
    """Each text by itself, gram by gram, gives what the batched code gives."""
    rng = random.Random(24)
    texts = [prose(rng, rng.choice(["en", "de"])) for _ in range(60)] + ["", "a", "ab", "ÄÖ x", "1 2 3"]
    rows = list(enumerate(texts))
    train = frame(spark, rows[:60]).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    model = langid.fit(train)
    best, sure = langid.classify(model, [t.encode() for t in texts])
    for i, t in enumerate(texts):
        total, count = np.zeros(len(model.languages)), 0
        for order in langid.ORDERS:
            data = np.frombuffer(t.encode().translate(common.ASCII_LOWER) + bytes(max(langid.ORDERS)), np.uint8)
            slots = langid.buckets(data, order)
            for at in range(max(0, len(t.encode()) - order + 1)):
                total = total + model.scores[slots[at]]
                count += 1
        z = (total / max(1, count) + model.bias) / model.temperature
        chance = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert best[i] == chance.argmax() and math.isclose(sure[i], chance.max(), rel_tol=1e-4)
    labels = spark.createDataFrame([(i, int(len(t) % 2)) for i, t in rows], "doc_id long, quality int")
    judge = quality.fit(frame(spark, rows), labels)
    raw, chances = quality.chances(judge, [t.encode() for t in texts])
    for i, t in enumerate(texts):
        x = quality.features(t.encode())
        plain = sum((a - m) / s * w for a, m, s, w in zip(x, judge.mean, judge.scale, judge.weights, strict=True))
        assert math.isclose(raw[i], plain, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(chances[i], 1 / (1 + math.exp(-(judge.slope * plain + judge.intercept))), rel_tol=1e-9)
