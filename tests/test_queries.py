"""Every core query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tipstaff.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return "" if v is None else f"{round(float(v), 3) + 0.0}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    theirs = sorted(tuple(map(plain, r)) for r in duck.sql(f"select {', '.join(cols)} from ({registry.SQL[name]})").fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    registry.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
