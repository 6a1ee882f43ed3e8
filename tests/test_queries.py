"""Every registered query against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from scorelake.plans.registry import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the shared tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA / name}.parquet'")
    return con


def cell(value):
    return round(value, 9) if isinstance(value, float) else value


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, duck, name):
    frame = queries()[name](spark, str(DATA))
    columns = sorted(frame.columns)
    relation = duck.sql(oracle_sql()[name])
    assert sorted(relation.columns) == columns
    place = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(cell(row[i]) for i in place) for row in relation.fetchall()), key=repr)
    got = sorted((tuple(map(cell, row)) for row in frame.select(*columns).collect()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry(spark).count() > 0
