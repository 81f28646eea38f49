"""From ranked passages to a cited report, for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import ids
from tessella.functions import text as T

MAX_CLAIMS = 5


def located(hits: DataFrame) -> DataFrame:
    """Hits with a page, one for each evidence of a question: the first by rank."""
    w = Window.partitionBy("query_id", "evidence_id").orderBy("rank")
    return hits.where("page_number is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def drafts(hits: DataFrame, questions: DataFrame, most: int = MAX_CLAIMS) -> DataFrame:
    """(query_id, draft_no, evidence_id, claim_id, claim_text): the best sentence of each hit, the first `most` by rank."""
    joined = hits.join(questions.select("query_id", F.col("text").alias("question")), "query_id")
    made = joined.select("query_id", "evidence_id", "rank", T.best_sentence(F.col("text"), F.col("question")).alias("claim_text")).where("claim_text is not null")
    w = Window.partitionBy("query_id").orderBy("rank", "evidence_id")
    return made.withColumn("draft_no", F.row_number().over(w)).where(F.col("draft_no") <= most).select("query_id", "draft_no", "evidence_id", ids.claim_id(F.col("claim_text")).alias("claim_id"), "claim_text")


def citation_label(title: Column, first: Column, last: Column) -> Column:
    """[title, p. N] or [title, pp. a-b]."""
    many = last.isNotNull() & (last != first)
    return F.concat(F.lit("["), title, F.when(many, F.concat(F.lit(", pp. "), first.cast("string"), F.lit("-"), last.cast("string"))).otherwise(F.concat(F.lit(", p. "), first.cast("string"))), F.lit("]"))


def citations(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, evidence_id, citation_id, label) for supported claims(claim_id, evidence_id, status) and evidence(evidence_id, title, page_number, page_end)."""
    joined = claims.where("status = 'supported'").join(evidence, "evidence_id")
    return joined.select("claim_id", "evidence_id", ids.citation_id(F.col("claim_id"), F.col("evidence_id")).alias("citation_id"), citation_label(F.col("title"), F.col("page_number"), F.col("page_end")).alias("label"))


def reports(claims: DataFrame, cited: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """(query_id, report): a list of the supported claims(query_id, draft_no, claim_id, claim_text, status) with their labels.

    With questions(query_id, text) a heading and the question come first.
    """
    labels = cited.groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_set("label")), " ").alias("labels"))
    lines = claims.where("status = 'supported'").join(labels, "claim_id", "left").select("query_id", F.struct("draft_no", F.concat(F.lit("- "), "claim_text", F.lit(" "), F.coalesce("labels", F.lit(""))).alias("line")).alias("x"))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.rtrim(x["line"])), "\n").alias("report")).transform(lambda r: r if questions is None else _headed(r, questions))


def _headed(rows: DataFrame, questions: DataFrame) -> DataFrame:
    top = F.concat(F.lit("# Local evidence report\n\n**Question:** "), "text", F.lit("\n\n"), "report")
    return rows.join(questions.select("query_id", "text"), "query_id").select("query_id", top.alias("report"))


def research_status(n_drafts: Column, n_claims: Column, n_published: Column, n_errors: Column) -> Column:
    """success if all is published without errors, failed if nothing is, else partial."""
    return F.when(n_published == 0, "failed").when((n_errors == 0) & (n_published == n_claims) & (n_claims == n_drafts), "success").otherwise("partial")


def outcomes(questions: DataFrame, claims: DataFrame) -> DataFrame:
    """(query_id, n_claims, n_published, status) for every question."""
    n = claims.groupBy("query_id").agg(F.count("*").alias("n_claims"), F.count_if(F.col("status") == "supported").alias("n_published"))
    all_ = questions.select("query_id").join(n, "query_id", "left").na.fill(0, ["n_claims", "n_published"])
    return all_.withColumn("status", research_status(F.col("n_claims"), F.col("n_claims"), F.col("n_published"), F.lit(0)))
