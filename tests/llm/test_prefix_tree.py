"""The tree of conversation prefixes against a plain walk over all prefixes."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from scorelake.llm import prefixtree

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_paths(rows):
    """Turns (role, text) of each conversation, in order."""
    out = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            out[c].append(((turn is not None, turn or 0), mark, role, text))
    return {c: [x[2:] for x in sorted(ts)] for c, ts in out.items()}


def plain_forks(paths):
    out = {}
    for c, own in paths.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c / 20) * 20
        out[c] = paths.get(base, [])[:h] + own[h:]
    return out


def plain_tree(paths):
    members = collections.defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    kids = collections.defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = [totals[k] for k in kids[node]]
        leaves = sum(x for x, _ in below) if below else 1
        totals[node] = (leaves, (len(members[node]) - 1) * words + sum(s for _, s in below))
    out = []
    for node, cs in members.items():
        ended = ",".join(str(c) for c in cs if len(paths[c]) == len(node))
        up = members[node[:-1]][0] if node else None
        digest = hashlib.sha256(ended.encode()).hexdigest()
        out.append((cs[0], len(node), up, len(cs), len(kids[node]), *totals[node], digest))
    return sorted(out, key=str)


def sample(seed):
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "", None, "d\te  f", "ü"]))
    rows = []
    for c in range(70):
        if c in (20, 45):
            continue
        rows += [(c, t, *turn()) for t in range(rng.randrange(1, 7))]
    long = [("u", f"w{i % 7} x") for i in range(45)]
    for c in (100, 101, 102, 120):  # long paths that part late
        rows += [(c, t, *long[t]) for t in range(45 - (c == 102))] + [(c, 45 + t, "u", str(c)) for t in range(c % 3)]
    rows += [(200, 0, "u", "same"), (201, 0, "u", "same"), (205, 3, "u", "one")]
    rows += [(300, None, "u", "first"), (300, 1, "u", "tie b"), (300, 1, "u", "tie a"), (300, 1, "u", "tie a"), (300, -5, None, None)]
    rows += [(None, 0, "u", "nobody's"), (-40, 0, "u", "below"), (-21, 0, "u", "zero"), (-21, 1, "u", "zero")]
    for c in range(400, 460):  # a crowd of copies
        rows += [(c, t, "u", f"copy {t}") for t in range(5)]
    rng.shuffle(rows)
    return rows


def collected(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("width", [prefixtree.WIDTH, 2])
def test_tree_equals_a_plain_walk(spark, monkeypatch, width):
    for name, value in (("STRETCH", 3), ("PIECE", 4), ("HOT_PARENTS", 20)):
        monkeypatch.setattr(prefixtree, name, value)
    rows = sample(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"d": F.lit("clash"), "pos": F.lit("clash"), "key": F.lit("clash")})
    numbered = prefixtree.turns(df)
    assert collected(prefixtree.tree(prefixtree.paths(numbered), width)) == plain_tree(plain_paths(rows))
    assert collected(prefixtree.tree(prefixtree.forked(numbered), width)) == plain_tree(plain_forks(plain_paths(rows)))


def test_conversations_left_without_turns_are_members_of_the_root(spark):
    rows = [(c, 0, "u", "x") for c in range(21, 30)]
    got = collected(prefixtree.tree(prefixtree.forked(prefixtree.turns(spark.createDataFrame(rows, SCHEMA)))))
    assert got == plain_tree(plain_forks(plain_paths(rows)))
    assert any(r[1] == 0 and r[3] == 9 for r in got)


def test_a_tree_of_nothing(spark):
    df = spark.createDataFrame([(None, 0, "u", "x")], SCHEMA)
    for empty in (df, df.limit(0)):
        assert prefixtree.tree(prefixtree.forked(prefixtree.turns(empty))).count() == 0
