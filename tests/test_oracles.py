"""Each query against its SQL in DuckDB, rows compared as multisets."""

import math
from collections import Counter

import duckdb
import pytest
from conftest import SF

from stridewell.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else x for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == names
    want = [plain(r) for r in rel.project(", ".join(f'"{c}"' for c in names)).fetchall()]
    got = [plain(r) for r in df.select(*names).collect()]
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_stream_equals_batch(spark):
    batch = {tuple(r) for r in QUERIES["q36_event_state_fold"](spark, SF).collect()}
    stream = {tuple(r) for r in QUERIES["q48_streaming_state"](spark, SF).collect()}
    assert batch == stream
