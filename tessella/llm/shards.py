"""Sharding by a two-pass external shuffle. DataFrame functions only.

1. Scatter. Every row goes to a bucket of its shard by a seeded hash. Shards have as many buckets as their bytes need
   (`BUCKET_BYTES` each), so a bucket fits in memory. The shuffle's files are the buckets.
2. Each bucket is gathered in one array, in the order of its hashes, shuffled by Fisher-Yates (`shuffle` with a seed), and
   written to its shard: a bucket is a file of the folder shard=N, its rows in their new order.

The law is `key`: the id and the number of shards decide. Under n shards an id's shard is the last s below n for which
hash(id, s) mod (s + 1) is 0; shard 0 always fits. One more shard takes each id with the chance 1 / (n + 1) and moves no
other. A row's bucket comes from a hash of its id and its place in the input, so rows that repeat an id are in one shard,
as the law has it, but spread over that shard's buckets: no bucket grows with them.

A slot is the place in the bucket behind the rows of the shard's earlier buckets. Counts of buckets are one row for each;
running sums are windows within a shard.

Defined cases: a null text has 0 bytes, the checksum 0 and stays null in its shard; a null id is an id like others. Rows
that repeat are kept as often as they come. A text longer than a bucket makes its own bucket larger. Columns other than
id and text are ignored. An empty table gives an empty result and no files. The same rows in the same partitions give the
same order for a seed; with other partitions the shards are the same, the order in them is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import new_folder

SHARDS = 40
#: Bytes of text in a bucket, about.
BUCKET_BYTES = 16 << 20
#: What a row counts besides its text.
ROW_BYTES = 16
SEED = 12


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key under the law `key`."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.pmod(F.xxhash64(key, s), s + 1) == 0)
    return F.array_max(fits)


def row_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and of what a row has besides."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def scattered(rows: DataFrame, shards: int, bucket_bytes: int, seed: int) -> tuple[DataFrame, int]:
    """rows(doc_id, text) with shard, bucket and the hash h that orders a bucket, one bucket in each partition; the number of buckets."""
    placed = rows.withColumn("shard", shard_of(F.col("doc_id"), shards))
    sizes = {r["shard"]: r["bytes"] for r in placed.groupBy("shard").agg(F.sum(row_size(F.col("text"))).alias("bytes")).collect()}  # a row for each shard
    counts = [-(-sizes.get(s, 0) // bucket_bytes) for s in range(shards)]
    first = [sum(counts[:s]) for s in range(shards)]
    place = [F.get(F.lit(x).cast("array<int>"), F.col("shard")) for x in (first, counts)]
    drawn = placed.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", F.monotonically_increasing_id()))
    drawn = drawn.withColumn("bucket", (place[0] + F.pmod(F.col("h"), F.greatest(place[1], F.lit(1)))).cast("int"))
    n = max(1, sum(counts))
    return drawn.repartitionById(n, F.col("bucket")), n


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the shards' folders: (place, bucket, doc_id, text) by shard, each bucket a file in its shuffled order."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt, _ = scattered(rows, shards, bucket_bytes, seed)
    buckets = dealt.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list(F.struct("h", "doc_id", "text"))).alias("rows"))  # bucket_bytes of text, about
    mixed = buckets.select("shard", "bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("place", "row"))
    mixed.select("shard", "bucket", "place", "row.doc_id", "row.text").sortWithinPartitions("shard", "bucket", "place").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text, shard, slot) from the written shards; docs: what they were made of, for the types."""
    spark = docs.sparkSession
    schema = f"bucket int, place int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, shard int"
    rows = spark.read.schema(schema).parquet(path)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, "bucket").select("doc_id", "text", "shard", (F.col("start") + F.col("place")).alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, from the written shards; grown_shard is that under one more shard."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    path = new_folder(docs.sparkSession, "shards")
    write_shards(named, path, shards, bucket_bytes, seed)
    rows = read_shards(named, path)
    crc = F.crc32(F.coalesce("text", F.lit("")))
    grown = F.when(F.pmod(F.xxhash64("doc_id", F.lit(shards)), F.lit(shards + 1)) == 0, shards).otherwise(F.col("shard"))
    return rows.select("doc_id", row_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", grown.cast("int").alias("grown_shard"))
