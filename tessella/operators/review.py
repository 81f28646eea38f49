"""Two-round review of questions and the gold release made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import ids

GAP = "INTERVAL 24 HOURS"


def review_errors(reviews: DataFrame) -> DataFrame:
    """reviews with errors: the names of all rules that a review breaks.

    reviews: decision, checks array<boolean>, issues array<string>, notes, revision struct<question, answer>, round1_at,
    round2_at (RFC 3339 with a zone), reviewer1, reviewer2, mode (single or independent), decision2, resolution, rationale, final_source.
    """
    d, issues = F.col("decision"), F.size(F.coalesce("issues", F.array().cast("array<string>")))
    good = F.forall(F.coalesce("checks", F.array().cast("array<boolean>")), lambda x: F.coalesce(x, F.lit(False)))
    noted = F.coalesce(F.trim("notes"), F.lit("")) != ""
    full = (F.coalesce(F.trim("revision.question"), F.lit("")) != "") & (F.coalesce(F.trim("revision.answer"), F.lit("")) != "")
    empty = (F.coalesce(F.trim("revision.question"), F.lit("")) == "") & (F.coalesce(F.trim("revision.answer"), F.lit("")) == "")
    zoned = lambda c: F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    t1, t2 = F.try_to_timestamp("round1_at"), F.try_to_timestamp("round2_at")
    agree = F.col("decision") == F.col("decision2")
    rules = [
        ("keep_is_clean", (d == "keep") & ~(good & (issues == 0) & empty)), ("edit_is_complete", (d == "edit") & ~(~good & (issues > 0) & full)),
        ("reject_is_reasoned", d.isin("reject", "needs_adjudication") & ~((issues > 0) & noted)), ("reject_has_no_revision", (d == "reject") & ~empty),
        ("other_needs_notes", F.array_contains(F.coalesce("issues", F.array().cast("array<string>")), "OTHER") & ~noted),
        ("zoned_times", ~(zoned("round1_at") & zoned("round2_at"))), ("round_order", t2 < t1), ("single_reviewer_gap", (F.col("mode") == "single") & ((F.col("reviewer1") != F.col("reviewer2")) | (t2 < t1 + F.expr(GAP)))),
        ("independent_reviewers", (F.col("mode") == "independent") & (F.col("reviewer1") == F.col("reviewer2"))), ("agreement", (F.col("resolution") == "not_required") & ~agree),
        ("resolved_with_reason", (F.col("resolution") != "not_required") & (F.coalesce(F.trim("rationale"), F.lit("")) == "")),
        ("final_source", F.col("final_source") != F.when(d == "keep", "silver").when(d == "edit", "final_revision").otherwise("none")),
    ]
    return reviews.withColumn("errors", F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules))))


def gold(reviews: DataFrame, questions: DataFrame, release: str) -> DataFrame:
    """(gold_id, question_id, question, answer, decision) of kept and edited questions without errors."""
    ok = review_errors(reviews).where(F.size("errors") == 0).where(F.col("decision").isin("keep", "edit"))
    joined = ok.join(questions.select("question_id", F.col("question").alias("_q"), F.col("answer").alias("_a")), "question_id")
    edit = F.col("decision") == "edit"
    return joined.select(ids.release_id("gold", F.lit(release), F.col("question_id")).alias("gold_id"), "question_id", F.when(edit, F.col("revision.question")).otherwise(F.col("_q")).alias("question"), F.when(edit, F.col("revision.answer")).otherwise(F.col("_a")).alias("answer"), "decision")


def located(answers: DataFrame, blocks: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """answers(question_id, paper_id, block_ids, answer, bbox) with page_number, matches and box_matches, recomputed from the blocks."""
    ids_ = answers.select("question_id", "paper_id", F.explode("block_ids").alias("block_id"))
    found = ids_.join(blocks, ["paper_id", "block_id"])
    by = found.groupBy("question_id").agg(F.countDistinct("page_number").alias("_pages"), F.min("page_number").alias("page_number"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "text"))), lambda x: x["text"]), " ").alias("_t"), F.array(*(c for c in (F.min(F.col("bbox")[0]), F.min(F.col("bbox")[1]), F.max(F.col("bbox")[2]), F.max(F.col("bbox")[3])))).alias("_box"))
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    near = F.forall(F.zip_with("bbox", "_box", lambda a, b: F.abs(a - b) <= tolerance), lambda x: x)
    return answers.join(by, "question_id", "left").withColumn("matches", (F.col("_pages") == 1) & (flat(F.col("answer")) == flat(F.col("_t")))).withColumn("box_matches", near).drop("_pages", "_t", "_box")


def decision_counts(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("decision").agg(F.count("*").alias("n"))
