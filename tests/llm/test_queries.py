"""The registered queries of this part: those with SQL against DuckDB, all of them on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tessella.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(name, spark):
    rows = queries.queries()[name](spark, DIR).collect()
    assert rows
    if sql := queries.oracle_sql().get(name):
        con = duckdb.connect()
        for t in ("pages", "embeddings"):
            con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
        found = con.execute(sql)
        order = [[d[0] for d in found.description].index(c) for c in rows[0].__fields__]
        assert sorted(map(str, ([r[i] for i in order] for r in found.fetchall()))) == sorted(str(list(r)) for r in rows)
