"""Tables with keys on Parquet: upserts, edges, citations, vectors, resumable indexing, integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import vectors as V


def upsert(table: DataFrame, batch: DataFrame, key: str, ordinal: str | None = None) -> DataFrame:
    """The table after the batch: a key's last row of the batch (by `ordinal`) replaces it. Without one a batch has no order, and of rows that repeat a key the greatest by hash counts."""
    if ordinal is None:
        whole = F.struct(*(F.col(c) for c in batch.columns))
        batch = batch.groupBy(F.col(key).alias("_k")).agg(F.max_by(whole, F.xxhash64(whole)).alias("_b")).select("_b.*")
    else:
        batch = batch.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ordinal)))).where("_n = 1").drop("_n", ordinal)
    return table.join(batch.select(key), key, "left_anti").unionByName(batch)


def upsert_outcome(table: DataFrame, batch: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, outcome): insert, update or unchanged, by a null-safe comparison of the columns."""
    old = table.select(F.col(key).alias("_k"), F.struct(*compared).alias("_old"))
    joined = batch.select(key, F.struct(*compared).alias("_new")).join(old, F.col(key) == F.col("_k"), "left")
    return joined.select(key, F.when(F.col("_k").isNull(), "insert").when(F.col("_new").eqNullSafe(F.col("_old")), "unchanged").otherwise("update").alias("outcome"))


def replace_edges(edges: DataFrame, batch: DataFrame, owner: str, owners: DataFrame | None = None) -> DataFrame:
    """Edges after all edges of the batch's owners are replaced; owners, if given, names them all, those without edges in the batch too."""
    named = batch.select(owner) if owners is None else owners.select(owner).unionByName(batch.select(owner))
    return edges.join(named.distinct(), owner, "left_anti").unionByName(batch.distinct())


def missing_keys(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has no parent."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def citation_checks(citations: DataFrame, claims: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """citations with reason: null where claim, evidence and source are there and agree."""
    c = citations.join(claims.select("claim_id", F.col("evidence_ids")), "claim_id", "left")
    c = c.join(evidence.select("evidence_id", F.col("source_id").alias("_source")), "evidence_id", "left").join(sources.select("source_id", F.lit(True).alias("_there")), "source_id", "left")
    reason = F.when(F.col("evidence_ids").isNull(), "unknown_claim").when(F.col("_source").isNull(), "unknown_evidence").when(F.col("_there").isNull(), "unknown_source").when(F.col("_source") != F.col("source_id"), "source_mismatch").when(~F.array_contains("evidence_ids", F.col("evidence_id")), "not_linked")
    return c.withColumn("reason", reason).select(*citations.columns, "reason")


def vector_batch(batch: DataFrame) -> DataFrame:
    """batch with valid: vectors that are empty or not finite are kept out of the table."""
    return batch.withColumn("valid", V.valid_vector(F.col("vector")))


def fresh(evidence: DataFrame, embedded: DataFrame, model: str) -> DataFrame:
    """Vectors of a model whose digest is still that of the evidence."""
    return embedded.where(F.col("model") == model).join(evidence.select("evidence_id", "content_sha256"), ["evidence_id", "content_sha256"])


def resume(evidence: DataFrame, embedded: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(skipped, pending) evidence: what has a fresh vector, and what has not."""
    ok = fresh(evidence, embedded, model).select("evidence_id").distinct()
    return evidence.join(ok, "evidence_id", "left_semi"), evidence.join(ok, "evidence_id", "left_anti")


def indexing_counts(requested: DataFrame, skipped: DataFrame, results: DataFrame) -> DataFrame:
    """One row (requested, skipped, indexed, failed, complete); results has error, null for an indexed row."""
    r = results.agg(F.count_if(F.col("error").isNull()).alias("indexed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    out = requested.agg(F.count("*").alias("requested")).crossJoin(skipped.agg(F.count("*").alias("skipped"))).crossJoin(r)
    return out.withColumn("complete", F.col("requested") == F.col("skipped") + F.col("indexed"))


def index_vectors(pending: DataFrame, embed, dimension: int) -> DataFrame:
    """(evidence_id, content_sha256, vector, error): `embed` takes a list of texts; a batch that fails is halved until the rows that fail stand alone.

    Only ValueError stands for bad records; anything else fails the task, and Spark runs it again.
    """

    def run(batches):
        import pyarrow as pa

        def each(texts):
            try:
                got = [list(map(float, v)) for v in embed(texts)]
                if len(got) != len(texts) or any(len(v) != dimension for v in got):
                    raise ValueError("wrong number or dimension of vectors")
                return [(v, None) for v in got]
            except ValueError as e:
                if len(texts) <= 1:
                    return [(None, str(e))] * len(texts)
                half = len(texts) // 2
                return each(texts[:half]) + each(texts[half:])

        for b in batches:
            out = each(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v for v, _ in out], pa.list_(pa.float64())), pa.array([e for _, e in out], pa.string())], ["evidence_id", "content_sha256", "vector", "error"])

    return pending.select("evidence_id", "content_sha256", "text").mapInArrow(run, "evidence_id string, content_sha256 string, vector array<double>, error string")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


def pruned_sources(sources: DataFrame, evidence: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first `limit` evidence rows by id, and the sources that they need."""
    kept = evidence.orderBy("evidence_id").limit(limit)
    return sources.join(kept.select("source_id").distinct(), "source_id", "left_semi"), kept
