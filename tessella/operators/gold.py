"""The gold release: every reviewed question is checked against its rules and its evidence is worked out anew from the document's blocks.

A review has question_id, annotation_record_id, source (dataset_release, question_id, paper_id, work_id and the digests of
the frozen files), review_protocol, record_status, round_1, round_2, resolution and gold_export. A round has
reviewer_alias, reviewed_at_utc, decision, confidence, checks, issue_codes, notes and proposed_revision; a revision has
question_type, question, answer, acceptable_answers and evidence (page_number, text, block_ids, bbox,
bbox_normalized_top_left). A question has question_id, paper_id, work_id, question_type, question, answer and evidence.

Nothing stops at the first fault: each question comes out with all rules that it breaks, or with its gold record. All
rules about one review are one expression; the evidence is one join of the chosen block ids with the blocks and one
aggregation by question.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import ids
from tessella.functions import text as T
from tessella.functions import vectors as V
from tessella.operators.validate import compiled, met

# Names and numbers of the review protocol.
SINGLE, INDEPENDENT = "single_reviewer_interval_recheck", "independent_two_reviewer"
GAP, BOX_SLACK, NORMALIZED_SLACK = "INTERVAL 24 HOURS", 0.05, 0.00001
ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _none(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def _any(*rules: Column) -> Column:
    return reduce(Column.__or__, rules)


def _empty(r: Column) -> Column:
    """A revision that says nothing."""
    e = r["evidence"]
    return r["question_type"].isNull() & r["question"].isNull() & r["answer"].isNull() & _none(r["acceptable_answers"]) & e["page_number"].isNull() & e["text"].isNull() & _none(e["block_ids"]) & e["bbox"].isNull() & e["bbox_normalized_top_left"].isNull()


def _complete(r: Column) -> Column:
    """A revision that says all it must."""
    return ~_any(_blank(r["question_type"]), _blank(r["question"]), _blank(r["answer"]), ~_none(r["acceptable_answers"]), _blank(r["evidence"]["text"]), _none(r["evidence"]["block_ids"]))


def _time(c: Column) -> Column:
    return F.when(c.rlike(ZONED), F.try_to_timestamp(c))


def round_rules(r: Column, name: str) -> dict[str, Column]:
    """What one round of a review must not be."""
    d, issues, noted = r["decision"], ~_none(r["issue_codes"]), ~_blank(r["notes"])
    asked = F.coalesce(r["checks"], F.array().cast("array<boolean>"))
    good, is_ = F.forall(asked, lambda x: F.coalesce(x, F.lit(False))), lambda *v: F.coalesce(d.isin(*v), F.lit(False))
    return {
        f"{name}_reviewer": _blank(r["reviewer_alias"]), f"{name}_incomplete": d.isNull() | r["confidence"].isNull() | (F.size(asked) == 0) | F.exists(asked, lambda x: x.isNull()), f"{name}_time": _time(r["reviewed_at_utc"]).isNull(),
        f"{name}_keep": is_("keep") & ~(good & ~issues & _empty(r["proposed_revision"])), f"{name}_edit": is_("edit") & ~(~good & issues & _complete(r["proposed_revision"])),
        f"{name}_reasons": is_("reject", "needs_adjudication") & ~(issues & noted), f"{name}_reject_revision": is_("reject") & ~_empty(r["proposed_revision"]),
        f"{name}_other": F.coalesce(F.array_contains(r["issue_codes"], "OTHER"), F.lit(False)) & ~noted,
    }


def resolution_rules() -> dict[str, Column]:
    """What the two rounds and the resolution of a review must not be."""
    a, b, end = F.col("round_1"), F.col("round_2"), F.col("resolution")
    ta, tb, te = _time(a["reviewed_at_utc"]), _time(b["reviewed_at_utc"]), _time(end["resolved_at_utc"])
    protocol, d, settled_ = F.col("review_protocol"), end["final_decision"], end["status"]
    is_ = lambda c, v: F.coalesce(c == v, F.lit(False))
    known = lambda c: F.coalesce(c, F.lit(False))
    source = F.when(d == "keep", "silver").when(d == "edit", "final_revision").when(d == "reject", "none")
    plain, judged = is_(settled_, "not_required"), is_(settled_, "resolved")
    return {
        "record_status": ~is_(F.col("record_status"), "resolved"), **round_rules(a, "round_1"), **round_rules(b, "round_2"), "round_order": known(tb < ta),
        "protocol": ~F.coalesce(protocol.isin(SINGLE, INDEPENDENT), F.lit(False)), "same_reviewer": is_(protocol, SINGLE) & ~a["reviewer_alias"].eqNullSafe(b["reviewer_alias"]),
        "recheck_gap": is_(protocol, SINGLE) & known(tb < ta + F.expr(GAP)), "other_reviewer": is_(protocol, INDEPENDENT) & a["reviewer_alias"].eqNullSafe(b["reviewer_alias"]),
        "resolution_incomplete": ~(plain | judged) | ~F.coalesce(d.isin("keep", "edit", "reject"), F.lit(False)), "resolution_time": te.isNull(), "resolution_order": known(te < tb), "payload_source": ~end["final_payload_source"].eqNullSafe(source),
        "final_revision": F.when(is_(d, "edit"), ~_complete(end["final_revision"])).otherwise(~_empty(end["final_revision"])),
        "disagreement": plain & ~(a["decision"].eqNullSafe(b["decision"]) & d.eqNullSafe(a["decision"])),
        "differing_edits": plain & is_(d, "edit") & ~(a["proposed_revision"].eqNullSafe(b["proposed_revision"]) & end["final_revision"].eqNullSafe(a["proposed_revision"])),
        "resolver": judged & _blank(end["resolver_alias"]), "rationale": judged & _blank(end["rationale"]),
    }


def located(payloads: DataFrame, blocks: DataFrame) -> DataFrame:
    """(question_id, n_blocks, n_found, n_pages, repeated, found): the evidence of payloads(question_id, paper_id, block_ids) from blocks(paper_id, page_number, width, height, block_id, reading_order, text, bbox).

    found: page_number, text in reading order, block_ids in that order, the box around the blocks and its share of the page.
    """
    wanted = payloads.select("question_id", "paper_id", F.explode("block_ids").alias("block_id"))
    rows = wanted.join(blocks, ["paper_id", "block_id"], "left")
    one = F.struct(F.col("reading_order").alias("o"), F.col("block_id").alias("b"), F.col("text").alias("t"))
    box = F.array(F.min(F.col("bbox")[0]), F.min(F.col("bbox")[1]), F.max(F.col("bbox")[2]), F.max(F.col("bbox")[3]))
    by = rows.groupBy("question_id").agg(
        F.countDistinct("block_id").alias("n_blocks"), F.countDistinct(F.when(F.col("page_number").isNotNull(), F.col("block_id"))).alias("n_found"), F.countDistinct("page_number").alias("n_pages"),
        (F.count("page_number") > F.countDistinct(F.when(F.col("page_number").isNotNull(), F.col("block_id")))).alias("repeated"), F.min("page_number").alias("page_number"), F.max("width").alias("width"), F.max("height").alias("height"),
        F.array_sort(F.collect_set(F.when(F.col("page_number").isNotNull(), one))).alias("parts"), F.transform(box, lambda x: F.round(x, 2)).alias("bbox"),
    )
    text = T.normalized(F.array_join(F.transform("parts", lambda p: p["t"]), " "))
    found = F.struct("page_number", text.alias("text"), F.transform("parts", lambda p: p["b"]).alias("block_ids"), "bbox", V.normalized_box(F.col("bbox"), F.col("width"), F.col("height")).alias("bbox_normalized_top_left"))
    return by.select("question_id", "n_blocks", "n_found", "n_pages", "repeated", found.alias("found"))


def evidence_rules() -> dict[str, Column]:
    """What a payload must not be, given what its blocks say (`found`)."""
    e, f, one = F.col("payload.evidence"), F.col("found"), (F.col("n_found") == F.col("n_blocks")) & (F.col("n_pages") == 1) & ~F.col("repeated")
    there = F.coalesce(one, F.lit(False))
    far = lambda box, own, slack: there & box.isNotNull() & ~F.coalesce(V.boxes_close(box, own, slack), F.lit(False))
    return {
        "type_locked": ~F.col("payload.question_type").eqNullSafe(F.col("question_type")), "no_blocks": _none(e["block_ids"]), "unknown_blocks": F.coalesce(F.col("n_found") < F.col("n_blocks"), F.lit(False)), "repeated_block": F.coalesce("repeated", F.lit(False)),
        "several_pages": F.coalesce(F.col("n_pages") > 1, F.lit(False)), "evidence_text": there & ~T.normalized(F.coalesce(e["text"], F.lit(""))).eqNullSafe(f["text"]), "evidence_page": there & e["page_number"].isNotNull() & ~e["page_number"].eqNullSafe(f["page_number"]),
        "evidence_box": far(e["bbox"], f["bbox"], BOX_SLACK), "evidence_normalized_box": far(e["bbox_normalized_top_left"], f["bbox_normalized_top_left"], NORMALIZED_SLACK),
        "answer_extractive": there & ~T.normalized(F.coalesce(F.col("payload.answer"), F.lit(""))).eqNullSafe(f["text"]), "acceptable_answers": ~_none(F.col("payload.acceptable_answers")),
    }


def built(reviews: DataFrame, questions: DataFrame, blocks: DataFrame, release: str, version: str, silver_sha: str, checksums_sha: str) -> DataFrame:
    """(question_id, decision, errors, gold) for every question or review; gold is null where there are errors or the question is rejected.

    Reviews and questions meet by question_id: `no_review`, `no_question`, `repeated_review` and `repeated_question` tell what is amiss
    there, `repeated_annotation` a record id that several reviews have.
    """
    sides = met("question_id", review=reviews, question=questions)
    shared = reviews.groupBy(F.col("annotation_record_id").alias("_a")).agg(F.count("*").alias("_n")).where("_n > 1")
    rows = sides.join(shared, F.col("review.annotation_record_id") == F.col("_a"), "left")
    papers = blocks.groupBy(F.col("paper_id").alias("_p")).agg(F.min("work_id").alias("_w"), F.max("work_id").alias("_w2"))
    rows = rows.join(papers, F.col("question.paper_id") == F.col("_p"), "left")
    names = ("annotation_record_id", "source", "review_protocol", "record_status", "round_1", "round_2", "resolution", "gold_export")
    rows = rows.select(F.col("key").alias("question_id"), "n_review", "n_question", "_n", "_p", "_w", "_w2", "question", *(F.col(f"review.{c}").alias(c) for c in names), F.col("question.question_type").alias("question_type"), F.col("question.paper_id").alias("paper_id"))
    q, d = F.col("question"), F.col("resolution.final_decision")
    silver = F.struct(q["question_type"].alias("question_type"), q["question"].alias("question"), q["answer"].alias("answer"), F.array().cast("array<string>").alias("acceptable_answers"), q["evidence"].alias("evidence"))
    payload = F.when(d == "edit", F.col("resolution.final_revision")).when(d == "keep", silver)
    rows = rows.withColumn("payload", payload)
    seen = located(rows.select("question_id", "paper_id", F.col("payload.evidence.block_ids").alias("block_ids")), blocks)
    rows = rows.join(seen, "question_id", "left")
    gold_id = F.when(d.isin("keep", "edit"), ids.release_id("gold", F.lit(version), F.col("question_id")))
    status = F.when(d == "edit", "corrected").when(d == "keep", "accepted")
    derived = F.when(d == "edit", "corrected").when(d == "keep", "unchanged")
    export = F.struct(F.coalesce(d.isin("keep", "edit"), F.lit(False)).alias("eligible"), gold_id.alias("gold_question_id"), F.when(gold_id.isNotNull(), "human_verified_gold").alias("label_quality"), status.alias("review_status"), derived.alias("derivation"))
    filled = F.coalesce(F.col("gold_export.eligible"), F.lit(False)) | F.coalesce(*(F.col(f"gold_export.{c}") for c in ("gold_question_id", "label_quality", "review_status", "derivation"))).isNotNull()
    own = F.struct(F.lit(release).alias("dataset_release"), F.col("question_id"), q["paper_id"].alias("paper_id"), q["work_id"].alias("work_id"), F.lit(silver_sha).alias("questions_silver_file_sha256"), F.lit(checksums_sha).alias("source_checksums_file_sha256"))
    same_source = reduce(Column.__and__, [F.col(f"source.{c}").eqNullSafe(own[c]) for c in ("dataset_release", "question_id", "paper_id", "work_id", "questions_silver_file_sha256", "source_checksums_file_sha256")])
    both, kept = (F.col("n_review") > 0) & (F.col("n_question") > 0), F.coalesce(d.isin("keep", "edit"), F.lit(False))
    rules = {
        "no_review": F.col("n_review") == 0, "no_question": F.col("n_question") == 0, "repeated_review": F.col("n_review") > 1, "repeated_question": F.col("n_question") > 1, "repeated_annotation": F.col("_n").isNotNull(),
        **{k: both & bad for k, bad in {
            "source_identity": ~same_source, "annotation_id": ~F.col("annotation_record_id").eqNullSafe(ids.release_id("annotation", F.lit(release), F.col("question_id"))), "document_identity": F.col("_p").isNull() | ~F.col("_w").eqNullSafe(q["work_id"]) | ~F.col("_w2").eqNullSafe(q["work_id"]),
            **resolution_rules(), "export_conflict": filled & ~F.col("gold_export").eqNullSafe(export), **{k: kept & bad for k, bad in evidence_rules().items()}}.items()},
    }
    aliases = F.array_sort(F.array_distinct(F.array("round_1.reviewer_alias", "round_2.reviewer_alias")))
    gold = F.struct(
        gold_id.alias("gold_question_id"), F.col("question_id").alias("source_question_id"), "paper_id", q["work_id"].alias("work_id"), F.col("payload.question_type").alias("question_type"), T.normalized(F.col("payload.question")).alias("question"), F.col("found.text").alias("answer"),
        F.col("found").alias("evidence"), F.lit("human_verified_gold").alias("label_quality"), status.alias("review_status"), derived.alias("derivation"), F.lit(False).alias("tuning_allowed"), F.col("review_protocol").alias("review_protocol"), F.size(aliases).alias("reviewer_count"), aliases.alias("reviewer_aliases"),
        F.col("annotation_record_id").alias("source_review_record_id"), F.col("resolution.status").alias("resolution_status"), F.col("resolution.resolver_alias").alias("resolver_alias"), F.col("resolution.resolved_at_utc").alias("resolved_at_utc"),
    )
    out = rows.select("question_id", d.alias("decision"), compiled(rules).alias("errors"), gold.alias("gold"))
    return out.withColumn("gold", F.when((F.size("errors") == 0) & (F.col("decision") != "reject"), F.col("gold")))


def release_counts(rows: DataFrame) -> DataFrame:
    """One row (reviews, kept, edited, rejected, gold_questions, gold_works, faulty) of `built`; a release is published if nothing is faulty."""
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    d = F.col("decision")
    return rows.agg(F.count("*").alias("reviews"), n(d == "keep", "kept"), n(d == "edit", "edited"), n(d == "reject", "rejected"), F.count("gold").alias("gold_questions"), F.countDistinct("gold.work_id").alias("gold_works"), n(F.size("errors") > 0, "faulty"))
