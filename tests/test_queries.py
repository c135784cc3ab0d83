"""Every registered query of the activity operators against its SQL in DuckDB, over the smallest tables."""

import math
import os

import pytest

from mnemospark.plans import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf)):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{sf}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert rows
        return
    found = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr) == rows
