"""Adapters: dataset records and run records to sources and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import ids
from tessella.functions import text as T


def required(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with all columns filled, the others with missing)."""
    gaps = F.array_compact(F.array(*(F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in columns)))
    marked = rows.withColumn("missing", gaps)
    return marked.where(F.size("missing") == 0).drop("missing"), marked.where(F.size("missing") > 0)


def selected(rows: DataFrame, split: str | None = "development") -> DataFrame:
    """Indexable rows of a split; rows without the flag count as indexable."""
    kept = rows.where(F.coalesce("indexable", F.lit(True)))
    return kept if split is None else kept.where(F.col("dataset_split") == split)


def sources_from_manifest(manifest: DataFrame) -> DataFrame:
    """(source_id, kind, title, uri, content_sha256, paper_id, work_id) of the first record of each digest that is no duplicate."""
    kept = manifest.where("not coalesce(is_exact_duplicate, false)")
    one = kept.groupBy("sha256").agg(F.min(F.struct("relative_path", "paper_id", "work_id", "title")).alias("r"))
    return one.select(ids.source_id(None, F.col("sha256"), F.lit("")).alias("source_id"), F.lit("paper").alias("kind"), "r.title", F.col("r.relative_path").alias("uri"), F.col("sha256").alias("content_sha256"), "r.paper_id", "r.work_id")


def evidence_from_chunks(chunks: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence, chunks of unknown papers). NUL characters go; how many went is kept."""
    joined = chunks.join(sources.select("paper_id", "source_id"), "paper_id", "left")
    ok = joined.where("source_id is not null")
    clean = T.without_nul(F.col("text"))
    evidence = ok.select(ids.evidence_id(F.col("source_id"), clean, chunk_id=F.col("chunk_id")).alias("evidence_id"), "source_id", clean.alias("text"), ids.text_sha256(clean).alias("content_sha256"), "page_number", T.without_nul(F.col("section")).alias("section"), "chunk_id", (F.length("text") - F.length(clean)).alias("nul_removed"))
    return evidence, joined.where("source_id is null").select("chunk_id", "paper_id")


def quarantine(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows have a digest that isn't their text's, or no text."""
    good = F.coalesce((F.col("content_sha256") == ids.text_sha256(F.col("text"))) & (F.length(T.normalized(F.col("text"))) > 0), F.lit(False))
    return evidence.where(good), evidence.where(~good)


def sources_from_runs(runs: DataFrame) -> DataFrame:
    """(source_id, kind, uri, title) of the distinct source URLs of run records."""
    urls = runs.select(F.explode("source_urls").alias("uri")).where("trim(uri) <> ''").distinct()
    return urls.select(ids.content_id("source", F.col("uri")).alias("source_id"), F.lit("web").alias("kind"), "uri", F.col("uri").alias("title"))


def evidence_from_search(results: DataFrame) -> DataFrame:
    """(source_id, evidence_id, uri, text): the first that isn't blank of raw_content, content, snippet; rows without text go."""
    text = F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in ("raw_content", "content", "snippet")))
    rows = results.select(F.col("url").alias("uri"), text.alias("text")).where("text is not null and trim(uri) <> ''")
    made = rows.withColumn("source_id", ids.content_id("source", F.col("uri")))
    return made.select("source_id", ids.evidence_id(F.col("source_id"), F.col("text")).alias("evidence_id"), "uri", "text").distinct()
