"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from millrace import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def plain(rows, names, order):
    out = []
    for r in rows:
        d = dict(zip(names, r, strict=True))
        out.append(tuple(repr(round(d[c], 9)) if isinstance(d[c], float) and not math.isnan(d[c]) else repr(d[c]) for c in order))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    rel = con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    assert plain(df.collect(), df.columns, order) == plain(rel.fetchall(), rel.columns, order)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).collect() is not None
