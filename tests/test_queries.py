"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans import base
from tidemark.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(round(float(value), 9)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, oracle, name):
    got = QUERIES[name](spark, sf_dir)
    rows = got.collect()
    if name not in ORACLES:
        assert rows and got.columns
        return
    want = oracle.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got.columns, rows) == rows_of(columns, want.fetchall())


def test_many_lines_are_dealt_by_their_number(spark, sf_dir, oracle, monkeypatch):
    monkeypatch.setattr(base, "ROWS_A_TASK", 400)
    got = QUERIES["evidence_by_three_keys"](spark, sf_dir)
    want = oracle.execute(ORACLES["evidence_by_three_keys"]).fetchall()
    assert sorted(map(tuple, got.select("id", "n").collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("REPARTITION_BY_NUM") >= 4  # three ways and the pieces; no more lines in a task as they grow
