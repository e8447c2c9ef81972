"""The driver's contract: queries run, their columns are those of the SQL, and results agree."""

import os

import duckdb
import pytest

from cairnlake.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def norm(rows):
    one = lambda v: round(v, 6) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v
    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = df.select(columns).collect()
    if name in catalogue.oracle_sql():
        want = duck.execute(f"select {', '.join(columns)} from ({catalogue.oracle_sql()[name]})").fetchall()
        assert norm(rows) == norm(want)


def test_names():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
