"""The queries of this subpackage against their SQL, and their plans."""

import os
import re

import duckdb
import pytest

from cairnlake.llm import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def norm(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    columns = sorted(df.columns)
    rows = df.select(columns).collect()
    if name in catalogue.oracle_sql():
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert norm(rows) == norm(duck.execute(f"select {quoted} from ({catalogue.oracle_sql()[name]})").fetchall())


def test_names():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
