"""Every query that has SQL gives the rows DuckDB gives."""

import duckdb
import pytest

from mosaiq import catalogue

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_rows_equal_sql(spark, name):
    db = duckdb.connect()
    for table in ("events", "orders", "embeddings", "nation", "customer", "supplier", "part", "lineitem"):
        db.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    want = db.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = catalogue.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == columns
    key = lambda row: tuple((x is not None, x) for x in row)
    a = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    b = sorted(want.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=key)
    assert len(a) == len(b) and a
    for x, y in zip(a, b):
        assert [v if not isinstance(v, float) else pytest.approx(v, abs=2e-9) for v in y] == list(x)
