"""Sharding: the law, the slots, and that the shards hold the rows."""

from __future__ import annotations

import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import shards
from tessella.llm.common import new_folder


def hashed(i, s):
    h = 42 if i is None else xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<i", s), h)))[0]


def law(i, n):
    return max(s for s in range(n) if hashed(i, s) % (s + 1) == 0)


def rows_of(n):
    return [(i if i % 50 else None, None if i % 31 == 0 else "é" * (i % 9) + f"text {i}", "x", i) for i in range(n)] + [(7, "again", "x", 0)] * (n // 3)


@pytest.mark.parametrize("n, most", [(900, 400), (900, 1 << 24), (1, 100), (0, 100)])
def test_law_slots_and_rows(spark, n, most):
    rows = rows_of(n)
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int").repartition(3)
    got = shards.sharded(df, shards=7, bucket_bytes=most).collect()
    want = Counter((i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode()), "key", law(i, 7), law(i, 8)) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    assert all(r["grown_shard"] in (r["shard"], 7) for r in got)
    for s in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_buckets_fit_in_memory_though_one_id_repeats(spark):
    df = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.repeat(F.lit("x"), 84).alias("text"))
    dealt, n = shards.scattered(df, 4, 100_000, 1)
    sizes = [r["n"] * 100 for r in dealt.groupBy("bucket").agg(F.count("*").alias("n")).collect()]
    assert n == 20 and len(sizes) == 20 and max(sizes) < 130_000
    assert dealt.select("bucket", F.spark_partition_id().alias("p")).distinct().count() == 20  # a bucket for each partition


def test_files_hold_buckets_in_a_new_order_that_the_seed_decides(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")).coalesce(2)
    orders = []
    for seed in (1, 1, 2):
        path = new_folder(spark, "test-shards")
        shards.write_shards(df, path, shards=3, bucket_bytes=4000, seed=seed)
        held = spark.read.parquet(path).orderBy("shard", "bucket", "place").collect()
        orders.append([r["doc_id"] for r in held])
        assert all(r["text"] == f"t{r['doc_id']}" for r in held)
        files = spark.read.parquet(path).select(F.input_file_name().alias("f"), "bucket").distinct().count()
        assert files == len({r["bucket"] for r in held})
    assert orders[0] == orders[1] != orders[2] and sorted(orders[0]) == list(range(3000))
    runs = sum(b > a for a, b in zip(orders[0], orders[0][1:], strict=False))
    assert 1300 < runs < 1700  # neighbours ascend half the time


def test_main_path_has_no_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = shards.sharded(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
