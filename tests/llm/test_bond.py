"""Hard negatives against all pairs, and the scan of one page against plain products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import bond


def plain(rows, every, positives, negatives, low, high):
    fine = [
        (i, c, [math.floor(256.0 * x) for x in v])
        for i, c, v in rows
        if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, c, v in fine:
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, d) for j, d, w in fine if j != i and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == c)[:positives]:
            found = sorted(x for x in scored if x[2] != c and low * -s <= 100 * -x[0] <= high * -s)[:negatives]
            out += [(i, p, r, j, -s, -t) for r, (t, j, _) in enumerate(found, 1)]
    return sorted(out)


def sample():
    rng = random.Random(21)
    rows = [(i, i % 4, [rng.gauss(0.05, 0.3) for _ in range(20)]) for i in range(1, 240)]
    rows += [(i, i % 2, [0.5] * 20) for i in range(240, 280)]  # ties
    rows += [(50, 1, [0.25] * 20), (50, 1, [0.25] * 20), (53, 2, [0.2] * 20), (53, 2, [0.2] * 20)]  # repeated rows
    rows += [(300, 1, None), (305, None, [0.1] * 20), (310, 1, [None] * 20), (315, 2, [float("nan")] * 20), (320, 2, [float("inf")] * 20)]
    rows += [(None, 1, [0.1] * 20), (400, 1, [1e5, -1e5]), (401, 1, [2.0, 1e6]), (402, 3, [1.5e6, 1.5e6]), (405, 3, [-2.0, 1.0])]
    rows += [(410, 1, []), (411, 1, []), (412, 2, []), (415, 9, [3.0]), (420, 1, [3e6, 1e6, 3.0]), (421, 1, [1e6, 9.5, 1.0]), (422, 2, [5e5, 7.0, 2.0])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"g": F.lit("clash"), "number": F.lit("clash")})


@pytest.mark.parametrize(("page", "group"), [(bond.PAGE, bond.GROUP), (7, 300)])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, page, group):
    monkeypatch.setattr(bond, "PAGE", page)
    monkeypatch.setattr(bond, "GROUP", group)
    rows = sample()
    got = bond.hard_negatives(frame(spark, rows), F.col("label"), F.col("vec_id") % 5 == 0, positives=4, negatives=3, low=40, high=90)
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, 4, 3, 40, 90)


def test_negatives_of_nothing(spark):
    alone = frame(spark, [(50, 1, [0.5]), (51, 1, None), (52, None, [0.5])])
    for df in (alone, alone.limit(0), alone.where("vec_id = 51")):
        assert bond.hard_negatives(df, F.col("label"), F.col("vec_id") % 50 == 0).count() == 0


def test_scan_drops_only_what_the_bounds_rule_out():
    rng = np.random.default_rng(3)
    cells = rng.integers(-200, 200, (37, 500)).astype("<i2")
    page = bond.Page({"dim": 37, "size": 500, "kind": "<i2", "ids": np.arange(500).tobytes(), "labels": (np.arange(500) % 3).tobytes(), "cells": cells.tobytes()})
    query = rng.integers(-300, 300, 37)
    scores = query @ cells.astype(np.int64)
    read = []

    def keep(sums, least, most):
        read.append(len(sums))
        return sums + most >= np.sort(scores)[-5]

    alive, found = bond.scan(page, query, np.arange(500), keep)
    assert found.tolist() == scores[alive].tolist() and set(np.argsort(-scores)[:5]) <= set(alive.tolist())
    assert read[-1] < 500
    want = sorted(zip((-scores).tolist(), range(500), strict=True))
    assert bond.nearest([page], 0, 1, query, 4) == [x for x in want if x[1] % 3 == 1][:4]
