"""The gold release: sound reviews of each decision, then one fault at a time."""

from __future__ import annotations

import copy
import hashlib
import json

import pytest

from tessella.operators import gold

EVIDENCE = "struct<page_number:int,text:string,block_ids:array<string>,bbox:array<double>,bbox_normalized_top_left:array<double>>"
REVISION = f"struct<question_type:string,question:string,answer:string,acceptable_answers:array<string>,evidence:{EVIDENCE}>"
ROUND = f"struct<reviewer_alias:string,reviewed_at_utc:string,decision:string,confidence:string,checks:array<boolean>,issue_codes:array<string>,notes:string,proposed_revision:{REVISION}>"
REVIEWS = f"""question_id string, annotation_record_id string, source struct<dataset_release:string,question_id:string,paper_id:string,work_id:string,questions_silver_file_sha256:string,source_checksums_file_sha256:string>, review_protocol string, record_status string,
 round_1 {ROUND}, round_2 {ROUND}, resolution struct<status:string,final_decision:string,final_payload_source:string,resolved_at_utc:string,final_revision:{REVISION},resolver_alias:string,rationale:string>,
 gold_export struct<eligible:boolean,gold_question_id:string,label_quality:string,review_status:string,derivation:string>"""
QUESTIONS = f"question_id string, paper_id string, work_id string, question_type string, question string, answer string, evidence {EVIDENCE}"
BLOCKS = "paper_id string, work_id string, page_number int, width double, height double, block_id string, reading_order int, text string, bbox array<double>"
NOTHING = {"question_type": None, "question": None, "answer": None, "acceptable_answers": [], "evidence": {"page_number": None, "text": None, "block_ids": [], "bbox": None, "bbox_normalized_top_left": None}}
EDIT = {"question_type": "abstract", "question": "What  then?", "answer": "second block", "acceptable_answers": [], "evidence": {"page_number": None, "text": "second\nblock", "block_ids": ["b2"], "bbox": None, "bbox_normalized_top_left": None}}


def stable(kind, release, i):
    return f"{kind}-" + hashlib.sha256(f"{release}\0{i}".encode()).hexdigest()[:16]


def question(i):
    return {"question_id": i, "paper_id": f"p-{i}", "work_id": f"w-{i}", "question_type": "abstract", "question": "What?", "answer": "first block second block", "evidence": {"page_number": 1, "text": "first block  second block", "block_ids": ["b2", "b1"], "bbox": [10.0, 10.0, 60.0, 80.0], "bbox_normalized_top_left": [0.1, 0.05, 0.6, 0.4]}}


def blocks(i):
    rows = [("b1", 1, 1, "first   block", [10.0, 10.0, 50.0, 40.0]), ("b2", 1, 2, "second block", [20.0, 50.0, 60.0, 80.0]), ("b3", 2, 3, "elsewhere", [0.0, 0.0, 1.0, 1.0])]
    return [(f"p-{i}", f"w-{i}", page, 100.0, 200.0, b, o, t, box) for b, page, o, t, box in rows]


def review(i, decision):
    good = {"keep": {"checks": [True, True], "issue_codes": []}, "edit": {"checks": [True, False], "issue_codes": ["WORDING"]}, "reject": {"checks": [False, True], "issue_codes": ["OTHER"], "notes": "no use"}}[decision]
    one = {"reviewer_alias": "ann", "reviewed_at_utc": "2026-01-01T10:00:00Z", "decision": decision, "confidence": "high", "notes": None, "proposed_revision": EDIT if decision == "edit" else NOTHING} | good
    source = {"dataset_release": "r1", "question_id": i, "paper_id": f"p-{i}", "work_id": f"w-{i}", "questions_silver_file_sha256": "s", "source_checksums_file_sha256": "c"}
    end = {"status": "not_required", "final_decision": decision, "final_payload_source": {"keep": "silver", "edit": "final_revision", "reject": "none"}[decision], "resolved_at_utc": "2026-01-03T10:00:00+01:00", "final_revision": EDIT if decision == "edit" else NOTHING, "resolver_alias": None, "rationale": None}
    export = {"eligible": False, "gold_question_id": None, "label_quality": None, "review_status": None, "derivation": None}
    return json.loads(json.dumps({"question_id": i, "annotation_record_id": stable("annotation", "r1", i), "source": source, "review_protocol": gold.SINGLE, "record_status": "resolved", "round_1": one, "round_2": one | {"reviewed_at_utc": "2026-01-02T10:00:00Z"}, "resolution": end, "gold_export": export}))


def put(record, path, value):
    *way, last = path.split(".")
    for k in way:
        record = record[k]
    record[last] = value


FAULTS = [
    ("keep", "source.work_id", "w", {"source_identity"}), ("keep", "annotation_record_id", "annotation-0", {"annotation_id"}), ("keep", "record_status", "open", {"record_status"}), ("keep", "review_protocol", "none", {"protocol"}),
    ("keep", "round_1.reviewer_alias", " ", {"round_1_reviewer", "same_reviewer"}), ("keep", "round_2.confidence", None, {"round_2_incomplete"}), ("keep", "round_1.checks", [True, None], {"round_1_incomplete", "round_1_keep"}),
    ("keep", "round_1.reviewed_at_utc", "2026-01-01T10:00:00", {"round_1_time"}), ("keep", "round_1.issue_codes", ["WORDING"], {"round_1_keep"}), ("keep", "round_2.proposed_revision", EDIT, {"round_2_keep"}),
    ("edit", "round_1.checks", [True, True], {"round_1_edit"}), ("reject", "round_1.notes", "", {"round_1_reasons", "round_1_other"}), ("reject", "round_2.proposed_revision", EDIT, {"round_2_reject_revision"}),
    ("keep", "round_2.reviewed_at_utc", "2026-01-01T12:00:00Z", {"recheck_gap"}), ("keep", "round_2.reviewed_at_utc", "2025-01-01T12:00:00Z", {"recheck_gap", "round_order"}), ("keep", "round_2.reviewer_alias", "bob", {"same_reviewer"}), ("keep", "review_protocol", gold.INDEPENDENT, {"other_reviewer"}),
    ("keep", "resolution.status", "open", {"resolution_incomplete"}), ("keep", "resolution.resolved_at_utc", "2026-01-02T09:59:59Z", {"resolution_order"}), ("keep", "resolution.resolved_at_utc", None, {"resolution_time"}), ("keep", "resolution.final_payload_source", "none", {"payload_source"}),
    ("keep", "resolution.final_revision", EDIT, {"final_revision"}), ("edit", "resolution.final_revision.question", " ", {"final_revision", "differing_edits"}), ("keep", "round_2.decision", None, {"round_2_incomplete", "disagreement"}),
    ("edit", "round_2.proposed_revision.question", "Other?", {"differing_edits"}), ("keep", "resolution.status", "resolved", {"resolver", "rationale"}), ("keep", "gold_export.eligible", True, {"export_conflict"}),
    ("edit", "resolution.final_revision.question_type", "method", {"type_locked", "differing_edits"}), ("edit", "resolution.final_revision.evidence.block_ids", [], {"no_blocks", "final_revision", "differing_edits"}), ("edit", "resolution.final_revision.evidence.block_ids", ["b2", "b9"], {"unknown_blocks", "differing_edits"}),
    ("edit", "resolution.final_revision.evidence.block_ids", ["b2", "b3"], {"several_pages", "differing_edits"}), ("edit", "resolution.final_revision.evidence.text", "second", {"evidence_text", "differing_edits"}), ("edit", "resolution.final_revision.evidence.page_number", 2, {"evidence_page", "differing_edits"}),
    ("edit", "resolution.final_revision.answer", "block", {"answer_extractive", "differing_edits"}), ("edit", "resolution.final_revision.acceptable_answers", ["x"], {"acceptable_answers", "final_revision", "differing_edits"}),
    ("edit", "resolution.final_revision.evidence.bbox", [20.0, 50.0, 60.0, 80.2], {"evidence_box", "differing_edits"}), ("edit", "resolution.final_revision.evidence.bbox_normalized_top_left", [0.2, 0.25, 0.6], {"evidence_normalized_box", "differing_edits"}),
]


@pytest.fixture(scope="module")
def built(spark):
    reviews, questions, rows, want = [], [], [], {}

    def add(i, decision, errors=(), change=None, silver=None):
        r, q = review(i, decision), question(i)
        for record, c in ((r, change), (q, silver)):
            if c:
                put(record, *copy.deepcopy(c))
        reviews.append(r)
        questions.append(q)
        rows.extend(blocks(i))
        want[i] = set(errors)

    for d in ("keep", "edit", "reject"):
        add(d, d)
    for n, (d, path, value, errors) in enumerate(FAULTS):
        add(f"f{n}", d, errors, (path, value))
    add("answer", "keep", {"answer_extractive"}, silver=("answer", "first block"))
    add("box", "keep", {"evidence_box"}, silver=("evidence.bbox", [10.0, 10.0, 60.0, 81.0]))
    add("near", "keep", silver=("evidence.bbox", [10.04, 10.0, 60.0, 80.0]))
    add("filled", "keep", change=("gold_export", {"eligible": True, "gold_question_id": stable("gold", "v1", "filled"), "label_quality": "human_verified_gold", "review_status": "accepted", "derivation": "unchanged"}))
    add("moved", "keep", {"document_identity"}, silver=("work_id", "w"))
    want["moved"].add("source_identity")
    add("twice", "keep", {"repeated_review", "repeated_annotation"})
    reviews.append(review("twice", "keep"))
    reviews.append(review("alone", "keep"))
    want["alone"] = {"no_question"}
    questions.append(question("silent"))
    want["silent"] = {"no_review"}
    out = gold.built(spark.createDataFrame(reviews, REVIEWS), spark.createDataFrame(questions, QUESTIONS), spark.createDataFrame(rows, BLOCKS), "r1", "v1", "s", "c")
    return {r["question_id"]: r for r in out.collect()}, want, out


def test_each_fault_is_named(built):
    rows, want, _ = built
    assert {i: set(r["errors"]) for i, r in rows.items()} == want


def test_gold_records(built):
    rows, want, out = built
    assert {i for i, r in rows.items() if r["gold"]} == {"keep", "edit", "near", "filled"}
    keep, edit = rows["keep"]["gold"], rows["edit"]["gold"]
    assert keep["gold_question_id"] == stable("gold", "v1", "keep") and keep["answer"] == "first block second block" and keep["evidence"]["block_ids"] == ["b1", "b2"]
    assert (keep["evidence"]["bbox"], keep["evidence"]["bbox_normalized_top_left"], keep["evidence"]["page_number"]) == ([10.0, 10.0, 60.0, 80.0], [0.1, 0.05, 0.6, 0.4], 1)
    assert (edit["question"], edit["answer"], edit["review_status"], edit["derivation"], edit["tuning_allowed"], edit["reviewer_count"]) == ("What then?", "second block", "corrected", "corrected", False, 1)
    n = gold.release_counts(out).first()
    assert (n["gold_questions"], n["gold_works"], n["faulty"], n["reviews"]) == (4, 4, sum(map(bool, want.values())), len(want))
