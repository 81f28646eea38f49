"""Queries without SQL see whole texts and all documents."""

from __future__ import annotations

import pytest

from tessella import catalogue
from tessella.catalogue import retrieval_q, verify_q

FILLER = "The report of the garden describes plain weather and quiet roads near the old river. "


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('whole')}"
    late = FILLER * 20 + "The zebrafish genome holds many peculiar quasar markers."
    rows = [(i, late if i in (1002, 1003) else FILLER * 20, "en", "s", 1700) for i in range(1000, 1010)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "zebrafish quasar genome")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_search_finds_what_stands_late(spark, folder):
    best = retrieval_q.hybrid_search(spark, folder).where("rank = 1").collect()
    assert [r["doc_id"] for r in best] == [1002]


def test_claims_of_all_documents(spark, folder):
    claims, evidence = verify_q.claims(spark, folder)
    rows = {r["claim_id"]: r for r in claims.collect()}
    assert len(rows) == 10 and rows["c1004"]["evidence_ids"] == ["e1004", "e1005"] and rows["c1009"]["evidence_ids"] == ["e1009"]
    assert rows["c1003"]["text"].strip() == FILLER.strip() and all(r["text"].endswith(("markers.", ". ")) for r in evidence.collect())
    assert catalogue.queries()["claim_gates"](spark, folder).count() == 10
