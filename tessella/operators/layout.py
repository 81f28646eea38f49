"""How rows lie over tasks."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Masters whose driver and executors are one process.
LOCAL = re.compile(r"local(\[.*\])?")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A scan as it is, or dealt anew by a key if it has fewer partitions than there are cores.

    For tables in one file with one row group, which one task would read and work on alone. Only for plain scans: their
    partitions are known without running anything. Large tables are never dealt anew.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master (as in tests) gets a temporary one; a cluster raises."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    named = sc.getConf().get("spark.checkpoint.dir") or (held.get() if held.isDefined() else None)
    if not named:
        if not LOCAL.fullmatch(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessella-")
    if not held.isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one; removed when the driver's interpreter ends."""
    path = f"{shared_folder(spark)}/tessella/{name}-{uuid.uuid4().hex}"

    def remove():
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM has ended before: the folder stays for the cluster's own cleaning
            pass

    atexit.register(remove)
    return path


def settled(df: DataFrame) -> DataFrame:
    """The same rows, worked out once and kept in the shared folder: for frames that several parts of a plan read."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a compressed table in the shared folder: for frames too large for `settled`, which keeps rows as they are in memory."""
    path = fresh_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that may be sent to every task.
MAX_SMALL = 500_000


def small(df: DataFrame) -> DataFrame:
    """The same rows, worked out once; sent to every task if they are few, so that the other side of a join stays where it lies."""
    df = settled(df)
    return F.broadcast(df) if df.count() <= MAX_SMALL else df
