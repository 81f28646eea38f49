"""Every registered query with SQL against DuckDB on the same files; the others must run."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tessella import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    return repr(round(float(v), 9)) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, duck):
    df = catalogue.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    if name in catalogue.oracle_sql():
        found = duck.execute(catalogue.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def test_entry_works_without_the_training_data_part(tmp_path):
    """In a copy without those folders and the pipeline's file, the entry imports and offers all other queries."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert [x.split() for x in done.stdout.splitlines()] == [sorted(catalogue.queries()), sorted(catalogue.oracle_sql())]
