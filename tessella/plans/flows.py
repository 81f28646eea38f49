"""The flows behind the command line: index a dataset, search it, answer questions with citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import vectors as V
from tessella.operators import quality, research, retrieval, store, verify
from tessella.operators.layout import settled

MODES = ("dense", "hybrid", "hybrid-rerank")


def checked(mode: str, top_k: int) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if not 1 <= top_k <= 100:
        raise ValueError("top_k must be in 1..100")


def index(evidence: DataFrame, embedded: DataFrame, model: str, dimension: int = 64) -> DataFrame:
    """New vectors (evidence_id, content_sha256, model, vector) for evidence without a fresh one, by the hashing embedder."""
    _, pending = store.resume(evidence, embedded, model)
    return pending.select("evidence_id", "content_sha256", F.lit(model).alias("model"), V.hashing_embedding(T.retrieval_tokens(F.col("text")), dimension).alias("vector"))


def prepared(passages: DataFrame, dimension: int = 64) -> DataFrame:
    """(doc_id, tokens, vector, accepted, quality_score) of passages(doc_id, text, section, page_number), kept in the shared folder: every text is tokenized and assessed once."""
    rows = passages.select("doc_id", "text", "section", "page_number", T.retrieval_tokens(F.col("text")).alias("tokens"))
    rows = rows.withColumn("vector", V.hashing_embedding(F.col("tokens"), dimension))
    rows = settled(rows.select("doc_id", "tokens", "vector", quality.assessment(F.col("text"), F.col("section"), F.col("page_number"), tokens=F.col("tokens")).alias("q")))
    return rows.select("doc_id", "tokens", "vector", F.col("q.accepted").alias("accepted"), F.col("q.score").alias("quality_score"))


def search(queries: DataFrame, passages: DataFrame, top_k: int = 8, mode: str = "hybrid-rerank", dimension: int = 64, ready: DataFrame | None = None) -> DataFrame:
    """Ranked passages(doc_id, text, section, page_number) for queries(query_id, text), with hashed vectors.

    hybrid gates both sides by quality before fusion and takes twice the number from each; hybrid-rerank fuses twice as
    many and orders them by the cosine of the hashed vectors. ready: the passages as `prepared` gives them, for several searches.
    """
    checked(mode, top_k)
    ready = prepared(passages, dimension) if ready is None else ready
    qv = settled(queries.select("query_id", V.hashing_embedding(T.retrieval_tokens(F.col("text")), dimension).alias("vector")))
    dv = ready.select("doc_id", "vector")
    if mode == "dense":
        return retrieval.dense(qv, dv, top_k, positive_only=False)
    wide = top_k * (2 if mode == "hybrid-rerank" else 1)
    fused = settled(retrieval.hybrid(queries, ready.select("doc_id", "tokens"), qv, dv, wide, 2, ready.select("doc_id", "accepted", "quality_score")))  # wide rows for each query
    if mode == "hybrid":
        return fused
    pairs = fused.select("query_id", "doc_id").join(qv.withColumnRenamed("vector", "a"), "query_id").join(dv.withColumnRenamed("vector", "b"), "doc_id")
    scores = pairs.select("query_id", "doc_id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("rerank_score"))
    return retrieval.reranked(fused, scores, top_k)


def answer(questions: DataFrame, passages: DataFrame, top_k: int = 5, mode: str = "hybrid-rerank") -> DataFrame:
    """(query_id, status, n_claims, n_published, report) for questions(query_id, text) over passages(doc_id, text, section, page_number, title)."""
    hits = search(questions, passages, top_k, mode).select("query_id", F.col("doc_id").cast("string").alias("evidence_id"), "rank")
    evidence = passages.select(F.col("doc_id").cast("string").alias("evidence_id"), "text", "page_number", F.lit(None).cast("int").alias("page_end"), "title")
    located = research.located(hits.join(evidence, "evidence_id"))
    drafts = settled(research.drafts(located, questions))  # a few rows for each question, used four times
    claims = drafts.groupBy("claim_id").agg(F.first("claim_text").alias("text"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    judged = verify.verdicts(claims, evidence.select("evidence_id", "text")).select("claim_id", "status", F.col("evidence_id").alias("support"))
    published = drafts.join(judged, "claim_id")
    cited = research.citations(judged.select("claim_id", F.col("support").alias("evidence_id"), "status"), evidence)
    out = research.outcomes(questions, published).join(research.reports(published, cited, questions), "query_id", "left")
    return out.withColumn("report", F.when(F.col("status") == "failed", F.lit(None)).otherwise(F.col("report")))


def health(passages: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """(check, ok): the corpus isn't empty, vectors have the dimension and are finite."""
    n = passages.agg((F.count("*") > 0).alias("ok")).select(F.lit("corpus").alias("check"), "ok")
    v = vectors.agg(F.coalesce(F.bool_and(V.valid_vector(F.col("vector")) & (F.size("vector") == dimension)), F.lit(False)).alias("ok")).select(F.lit("vectors").alias("check"), "ok")
    return n.unionByName(v)
