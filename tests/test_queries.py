"""Every query with SQL against DuckDB on the smallest tables."""

import os
from glob import glob

import duckdb
import pytest

from spanloom.plans import queries as plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted([tuple(plain(r[i]) for i in order) for r in found], key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, db, name):
    got = plans.QUERIES[name](spark, DATA)
    found = db.execute(plans.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, found.fetchall())
