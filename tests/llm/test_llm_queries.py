"""Queries of the subpackage on the smallest tables: against SQL where there is SQL, else that they run."""

import duckdb
import pytest

from tipstaff.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    folder = SF.replace("0.001", "0.01") if name == "p7_limits" else SF  # shares cannot be met with a handful of documents a source
    df = queries.QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in queries.SQL:
        c = duckdb.connect()
        for t in ("records", "documents", "mix_targets", "packing_specs"):
            c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
        cols = ", ".join(df.columns)
        plain = lambda rs: sorted(tuple(round(v, 2) + 0.0 if isinstance(v, float) else v for v in r) for r in rs)
        assert plain(rows) == plain(c.sql(f"select {cols} from ({queries.SQL[name]})").fetchall())
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
