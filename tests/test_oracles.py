"""Every core query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from retromill import queries as core


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in data])


def compare(spark, sf, queries, oracles, name):
    got = queries[name](spark, sf)
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    want = con.execute(oracles[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_core(spark, sf, name):
    compare(spark, sf, core.QUERIES, core.ORACLES, name)
