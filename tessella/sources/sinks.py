"""Writers: tables replaced as a whole, appended logs, JSON payloads."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write beside the old table, then swap; if the swap fails the old table comes back."""
    spark: SparkSession = df.sparkSession
    jvm, tag = spark._jvm, uuid.uuid4().hex[:12]
    target, staged, backup = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.staged-{tag}", f"{path}.backup-{tag}"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged.toString())
    old = fs.exists(target)
    if old and not fs.rename(target, backup):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(staged, target):
        if old:
            fs.rename(backup, target)
        raise OSError(f"can't move the new table to {path}")
    if old:
        fs.delete(backup, True)


def append_log(events: DataFrame, path: str, run_id: str, schema_version: str = "1.0") -> None:
    """Append events as JSON lines with version, run and time of recording."""
    events.select(F.lit(schema_version).alias("schema_version"), F.lit(run_id).alias("run_id"), F.current_timestamp().alias("recorded_at"), *events.columns).write.mode("append").json(path)


def payloads(rows: DataFrame, key: str, hidden: list[str] | None = None) -> DataFrame:
    """(key, payload): rows as JSON, without the columns that hold content."""
    kept = [c for c in rows.columns if c not in (hidden or [])]
    return rows.select(key, F.to_json(F.struct(*kept)).alias("payload"))


def replace_file(path: str, text: str) -> None:
    """Write a small file of the driver beside the old one, force it to disk, then put it in the old one's place."""
    staged = f"{path}.{uuid.uuid4().hex[:12]}.tmp"
    try:
        with open(staged, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(staged, path)
    finally:
        if os.path.exists(staged):
            os.remove(staged)
