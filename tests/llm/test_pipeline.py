from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
import public_tokenizers
import sentencepiece

from tessella.llm import mixing, simhash, toxicity

DIR = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = [{r["doc_id"]: r for r in docs.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        out.write.parquet(f"file://{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{k}")
        rows = {r["doc_id"]: r for r in docs.collect()}
        assert len(rows) == docs.count() and set(rows) <= set(kept[-1]), name
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.toxicity(before, spark.read.parquet(f"{DIR}/labels.parquet")).where("predicted = 1").collect()}
            assert set(rows) == set(kept[-1]) - bad
        if name == "near duplicates":
            every, table = simhash.groups(before)
            firsts = {}
            for r in every.join(table, "node").select("doc.doc_id", "root").collect():
                firsts[r["root"]] = min(r["doc_id"], firsts.get(r["root"], r["doc_id"]))
            assert set(rows) == set(firsts.values())
        if name == "secrets":
            assert set(rows) == set(kept[-1]) and all(r["n_chars"] == len(r["text"]) for r in rows.values())
        if name == "mixing":
            assert set(rows) == {r["doc_id"] for r in mixing.sampling_plan(before).where("sampled").collect()}
        if name == "pieces":
            lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert all(r["ids"] == lib.encode(kept[-1][i]["text"]) and r["round_trip"] for i, r in rows.items())
        kept.append(rows)


def test_stages_on_empty_and_odd_documents(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (3, "same text here", "de", "s", 14), (4, "same text here", "de", "t", 14), (3, "same text here", "de", "s", 14)]
    docs = spark.createDataFrame([(*r, "more", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string, mix_a int")
    for k, start in enumerate((docs, docs.limit(0))):
        now = start
        for j, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, f"file://{tmp_path}").write.parquet(f"file://{tmp_path}/{k}-{j}")
            now = spark.read.parquet(f"file://{tmp_path}/{k}-{j}")
        ids = [r["doc_id"] for r in spark.read.parquet(f"file://{tmp_path}/{k}-1").collect()]
        assert sorted(ids, key=str) == ([1, 3, None] if k == 0 else [])


def test_run(spark):
    assert corpus_pipeline.run(spark, DIR).columns == ["doc_id", "n_bytes", "n_pieces", "ids", "round_trip"]
