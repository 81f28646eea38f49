"""The evidence indexer: batches, bad records, a run that breaks and goes on, the table's key and digests, the log."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.operators import indexer
from tessella.operators.layout import fresh_folder


def rows(spark, texts, version=""):
    return spark.createDataFrame([(f"e{i:03d}", t, f"{t}{version}") for i, t in texts.items()], "evidence_id string, text string, content_sha256 string").coalesce(1)


def table(spark):
    return indexer.VectorTable(spark, fresh_folder(spark, "test-vectors"))


by_length = (lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])()  # a function without a name travels to the workers by value


def test_batches_have_their_size_over_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = indexer.embedded(rows(spark, {i: "x" * i for i in range(50)}), lambda ts: [[float(len(ts))] for _ in ts], 16, False).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["embedding"][0] for r in got) == [2.0] * 2 + [16.0] * 48


def test_bad_records_stand_alone(spark):
    def embed(texts):
        if any("bad" in t for t in texts):
            raise ValueError("refused  it")
        return by_length(texts)

    t, texts = table(spark), {i: "bad" if i in (3, 11) else f"text {i}" for i in range(20)}
    r = indexer.index(rows(spark, texts), t, embed, "m", batch_size=8, continue_on_error=True)
    assert (r["total"], r["indexed"], r["failed"], r["complete"], r["embedding_dimension"]) == (20, 18, 2, False, 2)
    assert sorted(map(tuple, r["failures"].collect())) == [("e003", "ValueError", "refused it"), ("e011", "ValueError", "refused it")]
    assert t.rows("m").count() == 18
    with pytest.raises(Exception, match="refused"):
        indexer.index(rows(spark, texts), table(spark), embed, "m")


def test_a_run_that_breaks_keeps_its_commits_and_the_next_goes_on(spark, tmp_path):
    flag, log, t = tmp_path / "offline", str(tmp_path / "log"), table(spark)
    texts = {i: f"text {i}" for i in range(60)}
    parts = {r["evidence_id"]: r["p"] for r in rows(spark, texts).select("evidence_id", F.pmod(F.xxhash64("evidence_id"), F.lit(3)).alias("p")).collect()}
    last = {texts[int(k[1:])] for k, p in parts.items() if p == 1}
    flag.touch()

    def embed(batch):
        if flag.exists() and last & set(batch):
            raise RuntimeError("service is offline")
        return by_length(batch)

    with pytest.raises(Exception, match="service is offline"):
        indexer.index(rows(spark, texts), t, embed, "m", commit_rows=20, continue_on_error=True, log=log)
    first = sum(p == 0 for p in parts.values())
    assert t.commits() == [1] and t.rows("m").count() == first
    stopped = indexer.progress(spark, log).first()
    assert (stopped["event"], stopped["indexed_count"], stopped["completed_count"], stopped["message"]) == ("run_interrupted", first, first, "PythonException")
    flag.unlink()
    r = indexer.index(rows(spark, texts), t, embed, "m", commit_rows=20, resume=True, log=log)
    assert (r["skipped"], r["indexed"], r["complete"]) == (first, 60 - first, True) and t.rows("m").count() == 60
    done = indexer.progress(spark, log).where("event = 'run_completed'").first()
    assert (done["total_count"], done["completed_count"], done["skipped_count"], done["message"]) == (60, 60, first, "complete")
    log_rows = spark.read.json(log).where(F.col("run_id") == done["run_id"]).orderBy("seq").collect()
    assert [x["event"] for x in log_rows][:2] == ["run_started", "batch_skipped"] and [x["completed_count"] for x in log_rows] == sorted(x["completed_count"] for x in log_rows)


def test_changed_evidence_is_embedded_anew(spark):
    t = table(spark)
    indexer.index(rows(spark, {0: "a", 1: "bb", 2: "ccc"}), t, by_length, "m")
    r = indexer.index(rows(spark, {0: "a", 1: "bbbb", 5: "new"}), t, by_length, "m", resume=True)
    assert (r["skipped"], r["indexed"]) == (1, 2)
    assert {x["evidence_id"]: (x["embedding"][0], x["content_sha256"]) for x in t.rows("m").collect()} == {"e000": (1.0, "a"), "e001": (4.0, "bbbb"), "e002": (3.0, "ccc"), "e005": (3.0, "new")}
    indexer.index(rows(spark, {0: "a"}), t, lambda ts: [[9.0]] * len(ts), "other")
    assert t.rows("m").count() == 4 and t.rows("other").count() == 1 and t.rows().count() == 5


def test_conflicts_dimensions_and_integrity(spark):
    t = table(spark)
    with pytest.raises(ValueError, match="'e001'"):
        indexer.index(rows(spark, {1: "a"}).union(rows(spark, {1: "b"})), t, by_length, "m")
    twice = rows(spark, {1: "a"})
    assert indexer.index(twice.union(twice), t, by_length, "m")["total"] == 1
    mixed = lambda ts: [[1.0] * (2 if x == "odd" else 3) for x in ts]
    r = indexer.index(rows(spark, {0: "a", 1: "odd", 2: "b"}), t, mixed, "mixed", batch_size=1, continue_on_error=True)
    assert (r["indexed"], r["failed"], r["embedding_dimension"]) == (2, 1, 3)
    assert indexer.index(rows(spark, {0: "a"}), t, lambda ts: [], "none", continue_on_error=True)["failed"] == 1
    before = t.commits()
    for ids, vector, what in ((["e009"], [1.0], "unknown"), (["e000"], [], "empty"), (["e000"], [float("nan")], "empty"), (["e000", "e000"], [1.0], "repeated")):
        with pytest.raises(ValueError, match=what):
            t.upsert(spark.createDataFrame([(i, vector) for i in ids], "evidence_id string, embedding array<double>"), rows(spark, {0: "a"}), "m")
    assert t.commits() == before
    for how in ({"model": " "}, {"model": "m", "batch_size": 0}):
        with pytest.raises(ValueError):
            indexer.index(twice, t, by_length, **how)
