"""Polarity has the SQL's ends of words: a letter beyond ASCII ends one."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella import catalogue
from tessella.catalogue import verify_q
from tessella.functions import text as T


def test_negation_beside_any_letter(spark):
    beside = ["", " ", "ñ", "é", "中", "ß", "ſ", "İ", "́", "‍", "x", "X", "7", "٣", "_", "-", "'", "’"]
    words = ["no", "NOT", "fail", "failed", "faıled", "İsn't", "isn't", "iſn't", "doeſn't", "waSn't", "weren't", "can't", "don't", "没有"]
    texts = [f"{a}{w}{b}" for a in beside for w in words for b in beside]
    got = [r["n"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.negated(F.col("t")).alias("n")).orderBy("i").collect()]
    con = duckdb.connect()
    asked = con.execute(f"select regexp_matches(t, '{verify_q.NEG}') from (select unnest(?) t, generate_subscripts(?, 1) i) order by i", [texts, texts]).fetchall()
    assert [t for t, a, b in zip(texts, got, asked, strict=True) if a != b[0]] == []


@pytest.mark.parametrize("name", ["claim_gates", "claim_verdicts"])
def test_claims_with_negation_before_other_letters(spark, tmp_path, name):
    text = "Osll noñcorr queda la casa grande de todos. El 中no中 rio."
    spark.createDataFrame([(i, text) for i in range(10, 16)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    rows = sorted(found.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in catalogue.queries()[name](spark, f"file://{tmp_path}").collect()) == rows
    assert {"contradicted", "partial", "supported"} > {r[1] for r in rows if r[0] == "c10"} == {"partial"}
