"""Evidence into vectors: batches for an embedder, commits that survive, a log of what is done.

A vector table is a folder with a folder for each commit: (evidence_id, model, content_sha256, embedding). Its key is
(evidence_id, model); of several commits the last one counts. A commit is written aside, checked, and put in place by one
rename, so a run that breaks leaves whole commits only, and the next one goes on behind them.

`index` splits what is to be embedded into commits by a hash of the id. Inside a commit every task gathers `batch_size`
texts, over Arrow batches, for each call of the embedder. A ValueError stands for bad records: with continue_on_error the
batch is halved until they stand alone, and they are kept with their messages. Any other error is the service's: the task
fails, Spark tries it again, and if that doesn't help the run is logged as interrupted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators.layout import fresh_folder
from tessella.operators.store import missing_keys
from tessella.sources import sinks

VECTORS = "evidence_id string, model string, content_sha256 string, embedding array<double>"
EVENTS = "seq int, event string, model string, total_count long, completed_count long, indexed_count long, skipped_count long, failed_count long, commit_no int, message string"
Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


class VectorTable:
    """Vectors by evidence and model."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        """The numbers of the commits, in order."""
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n.removeprefix("commit=")) for n in names if n.startswith("commit="))

    def rows(self, model: str | None = None) -> DataFrame:
        """The vectors that count, with the number of their commit."""
        if not self.commits():
            return self.spark.createDataFrame([], f"{VECTORS}, commit int")
        held = self.spark.read.schema(f"{VECTORS}, commit int").parquet(self.path)
        held = held if model is None else held.where(F.col("model") == model)
        last = held.groupBy("evidence_id", "model").agg(F.max_by(F.struct("content_sha256", "embedding", "commit"), "commit").alias("x"))
        return last.select("evidence_id", "model", "x.*")

    def fresh(self, evidence: DataFrame, model: str) -> DataFrame:
        """Vectors of a model that were made of the evidence as it is."""
        return self.rows(model).join(evidence.select("evidence_id", "content_sha256"), ["evidence_id", "content_sha256"])

    def upsert(self, batch: DataFrame, evidence: DataFrame, model: str) -> int:
        """Commit batch(evidence_id, embedding) with the digests of the evidence as it is; the commit's number.

        Nothing is committed if an id is unknown or comes twice, or a vector is empty or not finite.
        """
        joined = batch.join(evidence.select("evidence_id", "content_sha256"), "evidence_id", "left")
        staged = f"{self.path}/.staged-{uuid.uuid4().hex}"
        joined.select("evidence_id", F.lit(model).alias("model"), "content_sha256", F.col("embedding").cast("array<double>").alias("embedding")).write.parquet(staged)
        rows = self.spark.read.parquet(staged)
        found = rows.agg(F.min(F.when(F.col("content_sha256").isNull(), F.col("evidence_id"))).alias("unknown"), F.min(F.when(~V.valid_vector(F.col("embedding")), F.col("evidence_id"))).alias("invalid")).first()
        twice = rows.groupBy("evidence_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.min("evidence_id")).first()[0]
        for what, key in (("unknown evidence", found["unknown"]), ("empty or infinite vector", found["invalid"]), ("repeated evidence", twice)):
            if key is not None:
                self._fs.delete(self._path(staged), True)
                raise ValueError(f"{what}: {key!r}")
        return self._place(staged)

    def _place(self, staged: str) -> int:
        number = (self.commits() or [0])[-1] + 1
        if not self._fs.rename(self._path(staged), self._path(f"{self.path}/commit={number}")):
            raise OSError(f"commit {number} of {self.path} can't be put in place")
        return number


def conflicting(evidence: DataFrame) -> DataFrame:
    """(evidence_id) of rows that share an id but not their contents."""
    whole = F.xxhash64(*evidence.columns)
    return evidence.groupBy("evidence_id").agg(F.min(whole).alias("a"), F.max(whole).alias("b")).where("a <> b").select("evidence_id")


def embedded(rows: DataFrame, embed: Embedder, batch_size: int, continue_on_error: bool, dimension: int | None = None) -> DataFrame:
    """(evidence_id, embedding, error_type, message) for rows(evidence_id, text); a row has a vector or an error."""

    def run(batches):
        import pyarrow as pa

        def each(ids, texts):
            try:
                got = [[float(x) for x in v] for v in embed(texts)]
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
                for v in got:
                    if not v or any(x != x or abs(x) == float("inf") for x in v):
                        raise ValueError("a vector is empty or not finite")
                    if len(v) != (dimension or len(got[0])):
                        raise ValueError("vectors of different dimensions")
                return [(i, v, None, None) for i, v in zip(ids, got, strict=True)]
            except ValueError as e:
                if not continue_on_error:
                    raise
                if len(ids) == 1:
                    return [(ids[0], None, type(e).__name__, " ".join(str(e).split()) or repr(e))]
                half = len(ids) // 2
                return each(ids[:half], texts[:half]) + each(ids[half:], texts[half:])

        def out(rows):
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.list_(pa.float64()), pa.string(), pa.string()), strict=True)], ["evidence_id", "embedding", "error_type", "message"])

        ids, texts = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            texts += [t or "" for t in b.column(1).to_pylist()]
            while len(ids) >= batch_size:
                yield out(each(ids[:batch_size], texts[:batch_size]))
                del ids[:batch_size], texts[:batch_size]
        if ids:
            yield out(each(ids, texts))

    return rows.select(F.col("evidence_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "evidence_id string, embedding array<double>, error_type string, message string")


class Progress:
    """An appended log of a run: every event with the counts so far. It holds no texts and no ids."""

    def __init__(self, spark: SparkSession, path: str | None, model: str):
        self.spark, self.path, self.model = spark, path, model
        self.run_id, self.seq = uuid.uuid4().hex, 0

    def __call__(self, event: str, counts: dict, commit_no: int | None = None, message: str | None = None) -> None:
        if self.path:
            done = counts["indexed"] + counts["skipped"] + counts["failed"]
            row = (self.seq, event, self.model, counts["total"], done, counts["indexed"], counts["skipped"], counts["failed"], commit_no, message)
            sinks.append_log(self.spark.createDataFrame([row], EVENTS).coalesce(1), self.path, self.run_id)
        self.seq += 1


def progress(spark: SparkSession, path: str) -> DataFrame:
    """The last event of every run in a log, with its cumulative counts."""
    log = spark.read.schema(f"schema_version string, run_id string, recorded_at timestamp, {EVENTS}").json(path)
    return log.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "run_id"]), "seq").alias("x")).select("run_id", "x.*")


def index(
    evidence: DataFrame, table: VectorTable, embed: Embedder, model: str, batch_size: int = 32, commit_rows: int = 1_000_000, resume: bool = False,
    continue_on_error: bool = False, dimension: int | None = None, log: str | None = None,
) -> dict:
    """Embed evidence(evidence_id, text, content_sha256) into the table, a commit for about `commit_rows` rows.

    Returns total, skipped, indexed, failed, complete, embedding_dimension and failures, a DataFrame (evidence_id,
    error_type, message). With resume, evidence with a fresh vector of the model is left out.
    """
    model = model.strip()
    if not model or batch_size < 1 or commit_rows < 1:
        raise ValueError("a model's name and positive sizes are needed")
    spark = evidence.sparkSession
    evidence = evidence.select("evidence_id", "text", "content_sha256")
    if clash := conflicting(evidence).agg(F.min("evidence_id")).first()[0]:
        raise ValueError(f"records of different contents share {clash!r}")
    unique = evidence.dropDuplicates(["evidence_id"])
    total = unique.count()
    pending = unique.join(table.fresh(unique, model).select("evidence_id"), "evidence_id", "left_anti") if resume else unique
    folder = fresh_folder(spark, "indexing")
    n = -(-total // commit_rows) or 1
    pending.withColumn("part", F.pmod(F.xxhash64("evidence_id"), F.lit(n)).cast("int")).write.partitionBy("part").parquet(f"{folder}/pending")
    held = spark.read.schema("evidence_id string, text string, content_sha256 string, part int").parquet(f"{folder}/pending")
    counts = {"total": total, "skipped": total - held.count(), "indexed": 0, "failed": 0}
    tell = Progress(spark, log, model)
    tell("run_started", counts)
    if counts["skipped"]:
        tell("batch_skipped", counts)
    failures = None
    try:
        for part in range(n):
            rows = held.where(F.col("part") == part)
            embedded(rows, embed, batch_size, continue_on_error, dimension).write.parquet(f"{folder}/{part}")
            made = spark.read.parquet(f"{folder}/{part}")
            if dimension is None:
                dimension = made.where("embedding is not null").agg(F.min_by(F.size("embedding"), "evidence_id")).first()[0]
            odd = F.col("embedding").isNotNull() & (F.size("embedding") != F.lit(dimension))
            wrong = made.where(F.col("embedding").isNull() | odd).select("evidence_id", F.coalesce("error_type", F.lit("ValueError")).alias("error_type"), F.coalesce("message", F.lit("vectors of different dimensions")).alias("message"))
            good = made.where(F.col("embedding").isNotNull() & ~odd).select("evidence_id", "embedding")
            k, bad = good.count(), wrong.count()
            if bad and not continue_on_error:
                raise ValueError(wrong.agg(F.min("message")).first()[0])
            number = table.upsert(good, rows, model) if k else None
            counts["indexed"], counts["failed"] = counts["indexed"] + k, counts["failed"] + bad
            failures = wrong if failures is None else failures.unionByName(wrong)
            if k:
                tell("batch_indexed", counts, number)
            if bad:
                tell("batch_failed", counts, number)
    except Exception as e:
        tell("run_interrupted", counts, message=type(e).__name__)
        raise
    complete = counts["failed"] == 0 and counts["indexed"] + counts["skipped"] == total
    tell("run_completed", counts, message="complete" if complete else "incomplete")
    return counts | {"complete": complete, "embedding_dimension": dimension, "failures": failures}


def dangling(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, evidence_id) of claims(claim_id, evidence_ids) whose evidence isn't there."""
    links = claims.select("claim_id", F.explode_outer("evidence_ids").alias("evidence_id")).where("evidence_id is not null")
    return missing_keys(links, "evidence_id", evidence, "evidence_id").select("claim_id", "evidence_id").distinct()
