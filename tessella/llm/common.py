"""Shared folder, lineage cuts and small helpers of the training-data operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.operators.layout import shared_folder

#: Rows of whole documents that are worked on together: 1,000 average texts are a few MB. Spark bounds the bytes of a batch.
BATCH_ROWS = 1000


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one; removed when the driver's interpreter ends."""
    path = f"{shared_folder(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM has ended before: the folder stays for the cluster's own cleaning
        pass


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, kept in the shared folder so that a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The same rows, written as a Parquet table in the shared folder and read again."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = BATCH_ROWS):
    """The Arrow batches in parts of at most `rows` rows, so that what is made of a part stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
