"""Claim verification against linked evidence: deterministic first, semantic verdicts behind the same gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T

SUPPORTED, PARTIAL, MIN_CONFIDENCE = 0.8, 0.45, 0.75


def verdicts(claims: DataFrame, evidence: DataFrame, supported: float = SUPPORTED, partial: float = PARTIAL) -> DataFrame:
    """(claim_id, status, coverage, evidence_id, hard_gate_passed) for claims(claim_id, text, evidence_ids) and evidence(evidence_id, text).

    Numbers are looked up in all linked texts; words and polarity in the best span only: an extractive one first, then by
    coverage, then the shorter one, then the earlier. Claims without links, or with links that lead nowhere, fail the gate.
    """
    if not 0 <= partial <= supported <= 1:
        raise ValueError("thresholds must satisfy 0 <= partial <= supported <= 1")
    ids = F.array_distinct(F.coalesce("evidence_ids", F.array().cast("array<string>")))
    links = claims.select("claim_id", F.posexplode(ids).alias("link_no", "evidence_id"))
    found = links.join(evidence.select("evidence_id", T.numbers(F.col("text")).alias("evidence_numbers"), F.col("text").isNotNull().alias("there")), "evidence_id", "left")
    own = claims.select("claim_id", T.verifier_tokens(F.col("text")).alias("terms"), T.folded(T.normalized(F.col("text"))).alias("flat"))
    each = evidence.select("evidence_id", F.posexplode(T.sentences(F.col("text"))).alias("span_no", "span"))  # tokens of a span are made once, whatever links to it
    each = each.select("*", T.verifier_tokens(F.col("span")).alias("span_terms"), T.folded(T.normalized(F.col("span"))).alias("span_flat"))
    spans = links.join(own, "claim_id").join(each, "evidence_id")
    cover = T.coverage(F.col("terms"), F.col("span_terms"))
    order = F.struct(((F.length("flat") > 0) & F.contains("span_flat", "flat")).alias("extractive"), cover.alias("coverage"), (-F.length("span")).alias("short"), (-F.col("link_no")).alias("link"), (-F.col("span_no")).alias("first"))
    best = spans.groupBy("claim_id").agg(F.max(F.struct(order.alias("o"), F.col("span"), F.col("evidence_id"))).alias("best"))
    numbers = found.groupBy("claim_id").agg(F.array_distinct(F.flatten(F.collect_list("evidence_numbers"))).alias("evidence_numbers"), F.count_if(~F.coalesce("there", F.lit(False))).alias("missing"))
    joined = claims.select("claim_id", "text").join(numbers, "claim_id", "left").join(best, "claim_id", "left")
    extra = F.size(F.array_except(T.numbers(F.col("text")), F.col("evidence_numbers"))) > 0
    coverage, extractive = F.coalesce("best.o.coverage", F.lit(0.0)), F.coalesce("best.o.extractive", F.lit(False))
    linked = F.col("missing") == 0
    status = (
        F.when(~F.coalesce(linked, F.lit(False)), "insufficient")
        .when(extra, F.when(F.size("evidence_numbers") > 0, "contradicted").otherwise("insufficient"))
        .when((coverage >= partial) & (T.negated(F.col("text")) != T.negated(F.coalesce("best.span", F.lit("")))), "contradicted")
        .when((coverage >= supported) & extractive, "supported")
        .when(coverage >= partial, "partial")
        .otherwise("insufficient")
    )
    out = joined.select("claim_id", status.alias("status"), F.when(F.coalesce(linked, F.lit(False)), F.round(coverage, 6)).otherwise(F.lit(0.0)).alias("coverage"), F.when(linked, F.col("best.evidence_id")).alias("evidence_id"), F.coalesce(extra, F.lit(False)).alias("_extra"), F.coalesce(linked, F.lit(False)).alias("_linked"))
    return out.withColumn("hard_gate_passed", F.col("_linked") & ~F.col("_extra") & (F.col("status") != "contradicted")).drop("_extra", "_linked")


def with_semantics(base: DataFrame, semantic: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    """Replace statuses by semantic verdicts (claim_id, label, confidence) where the gate was passed and the claim isn't supported yet.

    Unknown labels, missing verdicts and a confidence below `least` leave the deterministic status: it fails closed.
    """
    known = semantic.where(F.col("label").isin("supported", "partial", "contradicted", "insufficient") & F.col("confidence").between(0, 1))
    one = known.groupBy("claim_id").agg(F.max_by(F.struct("label", "confidence"), F.struct("confidence", "label")).alias("v"))
    joined = base.join(one, "claim_id", "left")
    use = F.col("hard_gate_passed") & (F.col("status") != "supported") & (F.col("v.confidence") >= least)
    return joined.withColumn("method", F.when(use, "semantic").otherwise("deterministic")).withColumn("status", F.when(use, F.col("v.label")).otherwise(F.col("status"))).drop("v")
