"""Works, their members and the counts of a dataset against loops over the same rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from tessella.operators import corpus

SCHEMA = "file_id string, relative_path string, sha256 string, paper_id string, work_id string, is_exact_duplicate boolean, document_type string, language string, index_policy string, indexable boolean, translation_of string, title string, category string, year int, dataset_split string, tuning_allowed boolean, pages bigint"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(3), []
    for i in range(200):
        work, dup, kind = f"w{min(rng.randrange(30), 20)}", rng.random() < 0.3, rng.choice(["original", "translation"])
        if work == "w7":
            dup = True  # a work of duplicates only
        policy = None if dup else rng.choice(["primary", "primary_translation_only", "auxiliary_translation", "skip_semantic_variant"])
        path = rng.choice(["baseline/", "", "a/b/"]) + f"{i}.pdf"
        out.append((f"f{i:03}", path, f"h{rng.randrange(150)}", f"p{rng.randrange(90)}", work, dup, kind, rng.choice(["en", "zh"]), policy, None if dup else policy != "skip_semantic_variant", rng.choice([None, "p1"]), f"t{i}", rng.choice("xyz"), 2000 + i % 9, "test" if work < "w2" else "development", work >= "w2", i % 6))
    return [dict(zip(NAMES, r, strict=True)) for r in out]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], SCHEMA)


def first_of(group):
    """The primary of a work by a plain sort."""
    own = [r for r in group if not r["is_exact_duplicate"]]
    place = lambda r: (r["index_policy"] not in ("primary", "primary_translation_only"), "baseline" in r["relative_path"].split("/"), r["relative_path"].count("/"), r["relative_path"])
    return min(own, key=place) if own else dict.fromkeys(NAMES)


def test_works_and_members_against_a_loop(spark, rows):
    got = {r["work_id"]: r.asDict() for r in corpus.work_records(frame(spark, rows)).collect()}
    members = Counter(tuple(r) for r in corpus.work_members(frame(spark, rows)).collect())
    assert set(got) == {r["work_id"] for r in rows} and set(members.values()) == {1}
    for work, g in got.items():
        group = [r for r in rows if r["work_id"] == work]
        own, best = [r for r in group if not r["is_exact_duplicate"]], first_of(group)
        sets = {
            "languages": {r["language"] for r in group}, "source_file_ids": {r["file_id"] for r in group}, "indexable_paper_ids": {r["paper_id"] for r in own if r["indexable"]},
            "original_paper_ids": {r["paper_id"] for r in own if r["document_type"] == "original"}, "translation_paper_ids": {r["paper_id"] for r in own if r["document_type"] == "translation"},
        }
        assert g == {"work_id": work, "source_file_count": len(group), "unique_content_count": len({r["paper_id"] for r in own}), "primary_paper_id": best["paper_id"]} | {c: best[c] for c in ("title", "category", "year", "dataset_split", "tuning_allowed")} | {k: sorted(v) for k, v in sets.items()}
        assert {k: {m for w, kind, m in members if (w, kind) == (work, k)} for k in sets} == sets
    assert got["w7"]["primary_paper_id"] is None and got["w7"]["unique_content_count"] == 0


def test_counts_against_a_loop(spark, rows):
    m = frame(spark, rows)
    chunks = spark.createDataFrame([("test", True), ("development", None), ("development", False), (None, True)], "dataset_split string, indexable boolean")
    got = corpus.corpus_counts(m, chunks, m.where("dataset_split = 'test'"), chunks).first().asDict()
    own = [r for r in rows if not r["is_exact_duplicate"]]
    variants, linked = [r for r in own if r["index_policy"] == "skip_semantic_variant"], [r for r in own if r["translation_of"]]
    works = {w: first_of([r for r in rows if r["work_id"] == w])["category"] for w in {r["work_id"] for r in rows}}
    counted = lambda values: sorted(Counter(values).items(), key=lambda e: (e[0] is not None, e[0]))
    assert [tuple(e) for e in got.pop("category_counts")] == counted(works.values()) and [tuple(e) for e in got.pop("language_counts")] == counted(r["language"] for r in own)
    assert got == {
        "source_pdf_count": 200, "source_total_pages": sum(r["pages"] for r in rows), "canonical_pdf_count": len(own), "canonical_total_pages": sum(r["pages"] for r in own), "logical_work_count": len(works),
        "indexable_content_count": sum(r["indexable"] for r in own), "semantic_variant_content_count": len(variants), "semantic_variant_work_count": len({r["work_id"] for r in variants}), "exact_duplicate_file_count": 200 - len(own),
        "exact_duplicate_group_count": sum(n > 1 for n in Counter(r["sha256"] for r in rows).values()), "translation_file_count": sum(r["document_type"] == "translation" for r in rows),
        "canonical_translation_content_count": sum(r["document_type"] == "translation" for r in own), "linked_translation_content_count": len(linked), "linked_translation_work_count": len({r["work_id"] for r in linked}),
        "chunk_count": 4, "development_chunk_count": 2, "evaluation_corpus_chunk_count": 1, "indexable_chunk_count": 2, "evaluation_paper_count": sum(r["dataset_split"] == "test" for r in rows), "evaluation_question_count": 4,
    }


def test_an_empty_dataset(spark, rows):
    none = frame(spark, rows).limit(0)
    assert corpus.work_records(none).count() == corpus.work_members(none).count() == 0
    got = corpus.corpus_counts(none, none, none, none).first().asDict()
    assert got["logical_work_count"] == got["chunk_count"] == got["evaluation_question_count"] == 0 and got["category_counts"] == []
