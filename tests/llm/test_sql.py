"""Queries that SQL can express against their SQL, over whole tables."""

import duckdb
import pytest

from quillstone.llm import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    out = registry.queries()[name](spark, SMALL)
    assert sorted(out.columns) == sorted(want.columns)
    key = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, out.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)
