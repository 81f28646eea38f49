"""Event streams: metrics per window, start/end pairing with bounded state, idempotent progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        stream, path = stream.option("pathGlobFilter", where.getName()), where.getParent().toString()
    rows = stream.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def window_metrics(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; state older than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def node_durations(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(run_id, node, ms): starts joined with the ends that follow within the watermark, whatever the order of arrival."""
    a = events.where("kind = 'start'").select("run_id", "node", F.col("ts").alias("a")).withWatermark("a", late)
    b = events.where("kind = 'end'").select(F.col("run_id").alias("r2"), F.col("node").alias("n2"), F.col("ts").alias("b")).withWatermark("b", late)
    on = (F.col("run_id") == F.col("r2")) & (F.col("node") == F.col("n2")) & (F.col("b") >= F.col("a")) & (F.col("b") <= F.col("a") + F.expr(f"INTERVAL {late}"))
    return a.join(b, on).select("run_id", "node", F.floor((F.unix_micros("b") - F.unix_micros("a")) / 1000).alias("ms"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Run over all data there is; the last row of each key, from a table below path.

    Each batch writes only the rows that it changed, as a folder of its own number, so state behind the watermark can go,
    nothing passes through the driver, and a batch that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("basePath", path).parquet(path)
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct("batch", *values)).alias("last"))
    return last.select(*keys, *(F.col(f"last.{c}").alias(c) for c in values))


def append_once(stream: DataFrame, path: str, checkpoint: str):
    """Append batches as folders named by their number: a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run `append_once` over all data there is; all rows appended so far, with the number of their batch."""
    where = stream.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(stream.sparkSession._jsc.hadoopConfiguration()).mkdirs(where)  # a stream without data writes nothing
    append_once(stream, path, checkpoint).awaitTermination()
    return stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("basePath", path).parquet(path)


def progress(appended: DataFrame, *counts: Column) -> DataFrame:
    """One row for each batch of a table of `appended`: its counts (aggregates with names), and all of them so far as total_<name>.

    The totals come from the batches' folders and not from a running process, so they go on after a restart, and a batch that
    is run again counts once. The window runs over one row for each batch.
    """
    each = appended.groupBy("batch").agg(F.count("*").alias("rows"), *counts)
    so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("*", *(F.sum(c).over(so_far).alias(f"total_{c}") for c in each.columns if c != "batch"))
