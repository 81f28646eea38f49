"""File sources and writes, label containment."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import evaluate
from tessella.sources import files, sinks


def test_a_file_is_replaced_as_a_whole(tmp_path):
    path = tmp_path / "a.json"
    sinks.replace_file(str(path), "old")
    sinks.replace_file(str(path), "new ß")
    assert path.read_text(encoding="utf-8") == "new ß"
    with pytest.raises(UnicodeEncodeError):
        sinks.replace_file(str(path), "\ud800")
    assert path.read_text(encoding="utf-8") == "new ß" and len(list(tmp_path.iterdir())) == 1


def test_labels_contain_each_other(spark):
    rows = spark.createDataFrame([("The  Straße\n", "a the STRASSE b", True), ("x", "", True), ("abc", "abd", False), (None, "x", False)], "a string, b string, r boolean")
    assert all(r.got == r.r for r in rows.withColumn("got", evaluate.label_contained(F.col("a"), F.col("b"))).collect())


def test_line_numbers_of_files_of_many_splits(spark, tmp_path):
    rng, want = random.Random(1), {}
    for name in ("a.jsonl", "sub/b.jsonl"):
        lines = [rng.choice(["", "  ", "{bad", "[1]", "5", '{"n": %d, "s": "é%s"}' % (i, "x" * rng.randrange(90))]) for i in range(700)]
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes("".join(x + rng.choice(["\n", "\r\n"]) for x in lines).encode())
        want[path.name] = lines
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        for path, names in ((str(tmp_path / "a.jsonl"), ["a.jsonl"]), (f"{tmp_path}/*/*.jsonl", ["b.jsonl"]), (f"{tmp_path}/{{a.jsonl,sub}}", ["a.jsonl", "b.jsonl"])):
            assert spark.read.text(path).rdd.getNumPartitions() > 10
            assert sorted(map(tuple, files.numbered_lines(spark, path).collect())) == sorted((f, n, x) for f in names for n, x in enumerate(want[f], 1))
            rows, errors = files.jsonl_strict(spark, path, "n long, s string")
            ok = [(f, n, json.loads(x)) for f in names for n, x in enumerate(want[f], 1) if x.startswith("{") and x != "{bad"]
            assert sorted(map(tuple, rows.collect())) == sorted((f, n, x["n"], x["s"]) for f, n, x in ok)
            assert sorted(map(tuple, errors.collect())) == sorted((f, n, "blank line" if not x.strip() else "not a JSON object") for f in names for n, x in enumerate(want[f], 1) if (f, n) not in {o[:2] for o in ok})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_documents_and_labels(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n "a": 1,\n "b": {"c": "x"}\n}')
    (tmp_path / "two.json").write_text('{"a": 2}')
    got = files.json_documents(spark, f"{tmp_path}/*.json", "a long, b struct<c:string>").select("a", "b.c", "file").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "x", "one.json"), (2, None, "two.json")]
    (tmp_path / "l.csv").write_text('id,note\n007,"say ""yes"",\ntwice"\n2,\n')
    assert [tuple(r) for r in files.csv_labels(spark, str(tmp_path / "l.csv")).collect()] == [("007", 'say "yes",\ntwice'), ("2", None)]
