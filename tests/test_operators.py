"""Operators against plain Python on small fixtures."""

from __future__ import annotations

import hashlib
import math
import random
import uuid
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import ids
from tessella.functions import text as T
from tessella.functions import vectors as V
from tessella.operators import agentlog, chunking, corpus, evaluate, ports, quality, research, retrieval, review, store, validate, verify, web
from tessella.plans import flows
from tessella.sources import adapters, files, sinks


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


# ---- text and identifiers

def test_tokenizers(spark):
    assert one(spark, T.retrieval_tokens(F.lit("RAG 异常检测, v2 图"))) == ["rag", "异", "常", "检", "测", "v2", "图", "异常", "常检", "检测"]
    assert one(spark, T.retrieval_tokens(F.lit("异, 常"))) == ["异", "常", "异常"]
    assert one(spark, T.verifier_tokens(F.lit("The state-of-the-art isn't 12.5% of the 异 art"))) == ["state-of-the-art", "isn't", "12.5%", "异", "art"]
    assert one(spark, T.numbers(F.lit("12% and -3.5 but v2.1, 7. x +4 4 12%"))) == ["12%", "-3.5", "+4", "4"]
    assert one(spark, T.sentences(F.lit("One. Two!  \nThree？ 四。"))) == ["One.", "Two!", "Three？", "四。"]
    assert [one(spark, T.negated(F.lit(x))) for x in ("It did not", "nothing", "没有结果", "Failed")] == [True, False, True, True]


def test_best_sentence(spark):
    text = "Introduction. The method detects anomalies using a graph model. We saw rain over the green valley there. [1] Smith, A. Proceedings of X 2020."
    assert one(spark, T.best_sentence(F.lit(text), F.lit("what is seen over the valley"))) == "We saw rain over the green valley there."
    assert one(spark, T.best_sentence(F.lit(text), F.lit("zzz"))) == "The method detects anomalies using a graph model."
    assert one(spark, T.best_sentence(F.lit("too short."), F.lit("x"))) is None


def test_identifiers(spark):
    def slow(kind, *parts):
        import json

        return f"{kind}-" + hashlib.sha256(json.dumps(parts, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:20]

    assert one(spark, ids.content_id("claim", F.lit('a "q" \\ ü\n异'), F.lit("b"))) == slow("claim", 'a "q" \\ ü\n异', "b")
    assert one(spark, ids.name_id("work", F.lit("a/ü.pdf"))) == "work-" + uuid.uuid5(uuid.NAMESPACE_URL, "tessella:work:a/ü.pdf").hex[:16]
    assert one(spark, ids.claim_id(F.lit("  The  Claim\n"))) == slow("claim", "the claim")
    assert one(spark, ids.release_id("gold", F.lit("v1"), F.lit("q"))) == "gold-" + hashlib.sha256(b"v1\0q").hexdigest()[:16]


def test_hashing_embedding(spark):
    words = ["a", "b", "a", "c"]
    v = [0.0] * 8
    for w, n in Counter(words).items():
        v[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % 8] += 1 + math.log(n)
    size = math.sqrt(sum(x * x for x in v))
    got = one(spark, V.hashing_embedding(F.array(*map(F.lit, words)), 8))
    assert all(abs(a - b / size) < 1e-12 for a, b in zip(got, v, strict=True))
    assert one(spark, V.l2_normalized(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0] and not one(spark, V.valid_vector(F.array(F.lit(float("nan")))))


# ---- corpus

def test_five_files_of_two_works(spark):
    rows = [("f1", "2026/Shared_Work.pdf", "a"), ("f2", "baseline/Shared_Work.pdf", "a"), ("f3", "revised/Shared_Work.pdf", "b"), ("f4", "translations/Shared_Work_翻译结果.pdf", "c"), ("f5", "other/Independent_Work.PDF", "d")]
    df = spark.createDataFrame(rows, "file_id string, relative_path string, sha256 string")
    canon = corpus.canonical(df)
    assert [(r["file_id"], r["duplicate_of"]) for r in canon.where("is_exact_duplicate").collect()] == [("f2", "f1")]
    rec = canon.where("not is_exact_duplicate").select("*", corpus.title_key(F.col("relative_path")).alias("work_id"), F.concat(F.lit("p"), "sha256").alias("paper_id"), corpus.document_type(F.col("relative_path")).alias("document_type"))
    got = {r["file_id"]: (r["index_policy"], r["translation_of"], r["variant_of"]) for r in corpus.index_policies(rec).collect()}
    assert got == {"f1": ("primary", None, None), "f3": ("skip_semantic_variant", None, "pa"), "f4": ("auxiliary_translation", "pa", None), "f5": ("primary", None, None)}


def test_holdout_is_round_robin(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), f"{rng.random()}", str(i)) for i in range(40)]
    groups = {c: sorted((h, p) for k, h, p in rows if k == c) for c in "abc"}
    want, k = [], 0
    while len(want) < 25:
        for c in "abc":
            if k < len(groups[c]) and len(want) < 25:
                want.append(groups[c][k][1])
        k += 1
    df = spark.createDataFrame(rows, "category string, sha256 string, relative_path string")
    assert [r["relative_path"] for r in corpus.holdout(df, 25).collect()] == want


# ---- retrieval

def test_bm25_against_a_loop(spark):
    rng = random.Random(2)
    docs = {i: [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))] for i in range(60)}
    queries = {q: [rng.choice("abcdefghz") for _ in range(4)] for q in range(5)}
    avg, df = sum(map(len, docs.values())) / len(docs), Counter(w for d in docs.values() for w in set(d))
    want = []
    for q, terms in queries.items():
        scores = []
        for i, d in docs.items():
            s = sum(n * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t, n in Counter(terms).items() if t in d)
            if s > 0:
                scores.append((-round(s, 6), i))
        want += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scores)[:5], 1)]
    got = retrieval.bm25(spark.createDataFrame([(q, " ".join(t)) for q, t in queries.items()], "query_id int, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id int, text string"), 5)
    assert sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in got.collect()) == sorted(want)


def test_fusion_prefers_shared_second_places(spark):
    lists = [spark.createDataFrame([(1, a, 1), (1, 9, 2), (1, 9, 3)], "query_id int, doc_id int, rank int") for a in (1, 2)]
    rows = retrieval.fused([(x, 1.0) for x in lists], 3, rrf_k=10).collect()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["rank"])] == [9, 1, 2]


@pytest.mark.parametrize("block", [3, 1024])
def test_dense_against_all_pairs_and_ties_go_to_the_smaller_id(spark, block):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(80)]
    v = spark.createDataFrame([*rows, (500, None), (501, [float("nan")] * 3)], "doc_id int, vector array<double>")
    q = v.where("doc_id < 6").withColumnRenamed("doc_id", "query_id")
    for positive in (True, False):
        got = sorted(tuple(r) for r in retrieval.dense(q, v, 4, positive, block).select("query_id", "rank", "doc_id", "score").collect())
        want = []
        for i, a in rows[:6]:
            score = {}
            for j, b in rows:
                n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
                score[j] = round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6) if n else 0.0
            best = sorted((-s, j) for j, s in score.items() if s > 0 or not positive)[:4]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, sorted(want), strict=True))
    named = retrieval.dense(q.withColumn("query_id", F.concat(F.lit("q"), "query_id")), v.withColumn("doc_id", F.col("doc_id").cast("string")), 2)
    assert {type(r["doc_id"]) for r in named.collect()} == {str}


def test_quality_reasons(spark):
    long = "A substantive passage about the behaviour of distributed systems under load, with enough different words to be worth citing, and an ordinary ending at the close of it all here."
    rows = [(1, "Heading", "Intro", 1), (2, long, "References", 1), (3, "[1] Alpha beta 2001. [2] Gamma delta 2002. " + long, "x", 1), (4, long, "Intro", None), (5, long, "Intro", 1), (6, long, "", 1), (7, "#" * 200, "Intro", 1), (8, None, None, None)]
    got = {r["i"]: r for r in quality.assessed(spark.createDataFrame(rows, "i int, text string, section string, page_number int")).collect()}
    assert {"too_short", "heading_only"} <= set(got[1]["reasons"]) and got[2]["reasons"] == ["reference_section"] and {"reference_entry", "reference_list"} <= set(got[3]["reasons"])
    assert got[4]["reasons"] == ["missing_page"] and got[5]["accepted"] and got[5]["quality_score"] == 1.0 and got[6]["quality_score"] == 0.95 and "low_text_density" in got[7]["reasons"] and not got[8]["accepted"]


# ---- verification and research

CASES = [
    ("c1", "Latency fell by 12% in the trial.", ["e1"], "supported"), ("c2", "Latency fell by 15% in the trial.", ["e1"], "contradicted"), ("c3", "Latency did not fall by 12% in the trial.", ["e1"], "contradicted"),
    ("c4", "Latency fell in every trial of the year and costs fell too", ["e1"], "insufficient"), ("c5", "Bananas are yellow.", ["e1"], "insufficient"), ("c6", "anything", [], "insufficient"), ("c7", "Latency fell by 12% in the trial.", ["e1", "gone"], "insufficient"),
    ("c8", "latency  FELL by 12% in the trial.", ["e2", "e1", "e1"], "supported"), ("c9", "We counted 7 birds here", ["e2"], "insufficient"), ("c10", "Latency fell by 12% in the city trial.", ["e1"], "partial"),
]


def test_verdicts(spark):
    claims = spark.createDataFrame([c[:3] for c in CASES], "claim_id string, text string, evidence_ids array<string>")
    evidence = spark.createDataFrame([("e1", "We ran it. Latency fell by 12% in the trial. Costs rose."), ("e2", "Nothing to see here.")], "evidence_id string, text string")
    got = {r["claim_id"]: r for r in verify.verdicts(claims, evidence).collect()}
    assert {k: r["status"] for k, r in got.items()} == {c[0]: c[3] for c in CASES}
    assert got["c1"]["hard_gate_passed"] and not got["c2"]["hard_gate_passed"] and not got["c7"]["hard_gate_passed"] and got["c8"]["evidence_id"] == "e1"
    semantic = spark.createDataFrame([("c10", "supported", 0.9), ("c2", "supported", 0.99), ("c5", "supported", 0.5)], "claim_id string, label string, confidence double")
    after = {r["claim_id"]: (r["status"], r["method"]) for r in verify.with_semantics(verify.verdicts(claims, evidence), semantic).collect()}
    assert after["c10"] == ("supported", "semantic") and after["c2"][0] == "contradicted" and after["c5"] == ("insufficient", "deterministic")


def test_answers_are_cited_or_failed(spark):
    text = "The river model detects anomalies in microservice traces using graph attention over spans. It was tested widely in three different regions of the network during the whole year."
    p = spark.createDataFrame([(1, text, "Method", 3, "River"), (2, "Unrelated words about cooking rice and beans at home every single day of the week, with salt and oil and patience and time for everyone who eats it.", "Food", 1, "Rice")], "doc_id long, text string, section string, page_number int, title string")
    q = spark.createDataFrame([(1, "which model detects anomalies in traces"), (2, "zzz qqq")], "query_id long, text string")
    got = {r["query_id"]: r for r in flows.answer(q, p, 1, "hybrid").collect()}
    assert got[1]["status"] == "success" and got[1]["report"] == "# Local evidence report\n\n**Question:** which model detects anomalies in traces\n\n- The river model detects anomalies in microservice traces using graph attention over spans. [River, p. 3]"
    with pytest.raises(ValueError):
        flows.search(q, p, 0)
    with pytest.raises(ValueError):
        flows.search(q, p, 5, "other")


# ---- store

def test_vectors_of_changed_texts_are_stale(spark):
    ev = spark.createDataFrame([("a", "h2", "t"), ("b", "h1", "t")], "evidence_id string, content_sha256 string, text string")
    emb = spark.createDataFrame([("a", "h1", "m"), ("b", "h1", "m"), ("b", "h1", "n")], "evidence_id string, content_sha256 string, model string")
    skipped, pending = store.resume(ev, emb, "m")
    assert [r[0] for r in skipped.collect()] == ["b"] and [r["evidence_id"] for r in pending.collect()] == ["a"]


def test_bad_records_fail_alone(spark):
    ev = spark.createDataFrame([(str(i), "h", "bad" if i % 7 == 0 else "ok") for i in range(50)], "evidence_id string, content_sha256 string, text string")

    def embed(texts):
        if "bad" in texts:
            raise ValueError("bad text")
        return [[1.0, 2.0]] * len(texts)

    rows = store.index_vectors(ev, embed, 2).collect()
    assert {r["evidence_id"] for r in rows if r["error"]} == {str(i) for i in range(0, 50, 7)} and all((r["vector"] is None) == bool(r["error"]) for r in rows)


def test_tables_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for n in (3, 5):
        sinks.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert [p.name for p in tmp_path.iterdir() if p.suffix != ".crc"] == ["t"]
    sinks.append_log(spark.range(2), f"file://{tmp_path}/log", "r1")
    sinks.append_log(spark.range(3), f"file://{tmp_path}/log", "r1")
    assert spark.read.json(f"file://{tmp_path}/log").count() == 5


# ---- chunks

def slow_pack(rows, most):
    out = []
    for _, heading, text in sorted(rows):
        if out and not heading and len(out[-1]) + 2 + len(text) <= most:
            out[-1] += "\n\n" + text
        else:
            out.append(text)
    return out


def test_long_blocks_and_headings_are_split_before_packing(spark):
    rows = [(1, 1, 0, True, "Head\nline"), (1, 1, 1, False, "a " * 40), (1, 2, 0, False, "tail"), (1, 2, 1, False, " ")]
    got = chunking.packed(spark.createDataFrame(rows, "paper_id int, page_number int, reading_order int, is_heading boolean, text string"), 30).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(len(got))) and all(len(r["text"]) <= 30 for r in got)
    assert [r["section"] for r in got] == ["Head line"] * (len(got) - 1) + ["document"] and got[-1]["text"] == "tail"


def test_packing_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(p, g, i, rng.random() < 0.1, "x" * rng.randint(1, 300)) for p in range(3) for g in range(3) for i in range(rng.randint(1, 20))]
    got = chunking.packed(spark.createDataFrame(rows, "paper_id int, page_number int, reading_order int, is_heading boolean, text string"), 500).orderBy("paper_id", "page_number", "ordinal").collect()
    for p in range(3):
        for g in range(3):
            assert [r["text"] for r in got if (r["paper_id"], r["page_number"]) == (p, g)] == slow_pack([(i, h, t) for a, b, i, h, t in rows if (a, b) == (p, g)], 500)


def slow_parts(text, most):
    """Character by character: where may a text be cut, and which of these places does a part take?"""
    places, i = set(), 0
    while i < len(text):
        if text[i] == "\n":
            i += 1
        elif text[i] in ".!?。！？；;" or text[i].isspace():
            i += 1
            while i < len(text) and text[i].isspace():
                i += 1
        else:
            i += 1
            continue
        places.add(i)
    out, at, end = [], len(text) - len(text.lstrip()), len(text.rstrip())
    while at < end:
        stop = end if end - at <= most else max((p for p in range(at + max(1, int(most * 0.55)), at + most + 1) if p in places), default=at + most)
        out.append(text[at:stop].strip())
        at = stop
        while at < end and text[at].isspace():
            at += 1
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab .!\n。\t", max_size=200), st.integers(1, 40))
def test_parts_of_a_text_against_a_slow_walk(text, most):
    parts = [text[a:b] for a, b in chunking.part_offsets(text, most)]
    assert all(0 < len(p) <= most for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())
    assert parts == slow_parts(text, most)


def test_limit_of_parts_and_long_texts():
    for wrong in (0, -1, True):
        with pytest.raises(ValueError):
            chunking.part_offsets("text", wrong)
    text = ("Alpha beta gamma. " * 100_000).strip()
    assert " ".join(text[a:b] for a, b in chunking.part_offsets(text, 500)) == text


# ---- checks, reviews, logs, web

def test_validation_and_review(spark):
    q = spark.createDataFrame([("q1", "p1", 1, ["b1", "b2"], "hello big world"), ("q2", "p1", 9, ["b9"], "x"), ("q3", "p2", 1, ["b1"], "x")], "question_id string, paper_id string, page_number int, block_ids array<string>, answer string")
    p = spark.createDataFrame([("p1", "test", 3)], "paper_id string, dataset_split string, pages int")
    b = spark.createDataFrame([("p1", 1, "b1", "hello  big"), ("p1", 1, "b2", "world")], "paper_id string, page_number int, block_id string, text string")
    got = sorted((r["rule"], r["key"]) for r in validate.question_rules(q, p, b).collect())
    assert got == [("answer_in_blocks", "q2"), ("answer_in_blocks", "q3"), ("question_blocks", "q2"), ("question_blocks", "q3"), ("question_page", "q2"), ("question_paper", "q3")]
    a = spark.createDataFrame([("q1", "p1", ["b1", "b2"], "hello big world", [0.0, 0.0, 2.0, 2.0])], "question_id string, paper_id string, block_ids array<string>, answer string, bbox array<double>")
    blocks = spark.createDataFrame([("p1", 1, "b1", "hello  big", 0, [0.0, 0.0, 1.0, 1.0]), ("p1", 1, "b2", "world", 1, [1.0, 1.0, 2.0, 2.0])], "paper_id string, page_number int, block_id string, text string, reading_order int, bbox array<double>")
    r = review.located(a, blocks).first()
    assert r["matches"] and r["box_matches"] and r["page_number"] == 1


def test_links_between_records(spark):
    rows = [("a", "w", "original", "primary", None, None), ("b", "w", "translation", "auxiliary_translation", "a", None), ("c", "v", "translation", "auxiliary_translation", "a", None), ("d", "v", "original", "skip_semantic_variant", None, "zz")]
    df = spark.createDataFrame(rows, "paper_id string, work_id string, document_type string, index_policy string, translation_of string, variant_of string")
    assert sorted((r["rule"], r["key"]) for r in validate.link_target_rules(df).collect()) == [("target_exists", "d"), ("target_same_work", "c")]


def test_files_and_checksums(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "d" / "sub" / "B.PDF").write_bytes(b"x")
    (tmp_path / "d" / "c.txt").write_bytes(b"x")
    seen = files.file_scan(spark, f"file://{tmp_path}/d")
    assert sorted((r["relative_path"], r["byte_size"]) for r in seen.collect()) == [("a.pdf", 6), ("sub/B.PDF", 1)]
    h = hashlib.sha256(b"%PDF-1").hexdigest()
    (tmp_path / "sums").write_text(f"{h}  a.pdf\n{h}  sub/B.PDF\n{h}  ../up\nbroken\n{h}  gone.pdf\n")
    listed = files.checksums(spark, f"file://{tmp_path}/sums")
    assert sorted((r["relative_path"], r["problem"]) for r in listed.where("problem is not null").collect()) == [("", "malformed"), ("../up", "unsafe_path")]
    assert {r["relative_path"]: r["state"] for r in files.verified(listed.where("problem is null"), seen).collect()} == {"a.pdf": "ok", "sub/B.PDF": "changed", "gone.pdf": "missing"}
    raw = spark.read.format("binaryFile").load(f"file://{tmp_path}/d/*.pdf")
    assert files.pdf_inspection(raw).first()["problem"] is not None


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": 2}\n{oops}\n')
    rows, errors = files.jsonl_strict(spark, f"file://{tmp_path}/x.jsonl", "a int")
    assert sorted((r["line_no"], r["a"]) for r in rows.collect()) == [(1, 1), (4, 2)] and sorted((r["line_no"], r["reason"]) for r in errors.collect()) == [(2, "blank line"), (3, "not a JSON object"), (5, "not a JSON object")]
    lines = spark.createDataFrame([("# HELP x",), ('hits_total{a="b"} 3',), ("hits_total 4.5",), ("other 9",)], "value string")
    assert [(r["name"], r["total"]) for r in files.counters(lines, ["hits_total"]).collect()] == [("hits_total", 7.5)]


def test_adapters(spark):
    chunks = spark.createDataFrame([("c1", "p1", "a\0b", 1, "s\0"), ("c2", "px", "t", 1, None)], "chunk_id string, paper_id string, text string, page_number int, section string")
    src = spark.createDataFrame([("p1", "source-1")], "paper_id string, source_id string")
    good, unknown = adapters.evidence_from_chunks(chunks, src)
    r = good.first()
    assert (r["text"], r["nul_removed"], r["section"]) == ("ab", 1, "s") and [x["chunk_id"] for x in unknown.collect()] == ["c2"]
    ok, bad = adapters.quarantine(good.unionByName(good.withColumn("content_sha256", F.lit("0"))))
    assert ok.count() == 1 and bad.count() == 1
    man = spark.createDataFrame([("h", "b.pdf", "p", "w", "T", False), ("h", "a.pdf", "p", "w", "T", True)], "sha256 string, relative_path string, paper_id string, work_id string, title string, is_exact_duplicate boolean")
    assert [r["uri"] for r in adapters.sources_from_manifest(man).collect()] == ["b.pdf"]


def test_web_and_runs(spark):
    r = spark.createDataFrame([(1, "u", "first"), (2, "v", "x"), (3, "u", "last")], "ordinal int, url string, c string")
    assert [(x["url"], x["c"], x["position"]) for x in web.dedup_by_url(r, "last").orderBy("position").collect()] == [("u", "last", 1), ("v", "x", 2)]
    with pytest.raises(ValueError):
        web.dedup_by_url(r, "none")
    state = spark.createDataFrame([("k", 1, "append", ["a"]), ("k", 3, "append", ["c"]), ("k", 2, "override", ["b"])], "key string, seq int, op string, items array<string>")
    assert agentlog.reduced(state).first()["items"] == ["b", "c"]
    assert one(spark, research.research_status(F.lit(3), F.lit(3), F.lit(3), F.lit(0))) == "success" and one(spark, research.research_status(F.lit(3), F.lit(3), F.lit(1), F.lit(0))) == "partial"
    rows = spark.createDataFrame([("supported", "supported"), ("supported", "partial"), ("supported", "insufficient"), ("partial", "partial")], "expected string, predicted string")
    m = evaluate.publication(rows).first()
    assert (m["accuracy"], m["precision"], m["recall"]) == (0.5, 1.0, 0.333333)


def test_command_line(spark, tmp_path):
    from tessella import cli

    text = "The river model detects anomalies in microservice traces using graph attention over spans. It was tested widely in three different regions of the network during the whole year."
    p, v = f"file://{tmp_path}/p", f"file://{tmp_path}/v"
    spark.createDataFrame([(1, text, "Method", 3, "River", "development"), (2, text, "Method", 3, "River", "test")], "doc_id long, text string, section string, page_number int, title string, dataset_split string").write.parquet(p)
    run = lambda *argv: cli.run(spark, cli.parser().parse_args(argv))
    assert run("index", "--passages", p, "--vectors", v, "--dry-run") == (0, '{"requested": 1, "pending": 1}')
    for _ in range(2):
        assert run("index", "--passages", p, "--vectors", v) == (0, '{"requested": 1, "vectors": 1}')
    assert run("doctor", "--passages", p, "--vectors", v)[0] == 0 and run("doctor", "--passages", p, "--vectors", v, "--embedding-dimension", "3")[0] == 2
    assert '"doc_id":1' in run("search", "anomalies in traces", "--passages", p, "--top-k", "1", "--retrieval-mode", "dense")[1]
    assert run("research", "which model detects anomalies", "--passages", p)[0] == 0 and run("research", "zzz", "--passages", p, "--retrieval-mode", "hybrid")[0] in (0, 2)


def test_first_sentence_and_abstract(spark):
    long = "word " * 20
    assert one(spark, T.first_sentence(F.lit(f"{long}ends here. Next one."))) == f"{long}ends here."
    assert one(spark, T.first_sentence(F.lit("Short. " + "x" * 600))) == "Short. " + "x" * 493
    assert one(spark, T.abstract(F.lit(f"T\nAbstract\n{long * 2}\n\n1. Introduction\nmore"))) == (long * 2).strip()
    assert one(spark, T.abstract(F.lit("Abstract: short\nKeywords: x"))) is None


def test_entailment_port_fails_closed(spark):
    from tessella.operators import ports

    def judge(text, texts):
        if text == "boom":
            raise RuntimeError("down")
        return {"label": "supported", "confidence": 0.9}

    claims = spark.createDataFrame([("a", "ok", ["t"]), ("b", "boom", ["t"])], "claim_id string, text string, texts array<string>")
    assert [r["claim_id"] for r in ports.entailment(claims, judge).collect()] == ["a"]


def test_upsert_without_order_and_owners_without_edges(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    out = store.upsert(table, spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "k int, v string"), "k").collect()
    assert sorted(r["k"] for r in out) == [1, 2, 3] and {r["v"] for r in out if r["k"] == 2} <= {"x", "y"}
    edges = spark.createDataFrame([("c1", "e1"), ("c2", "e2"), ("c3", "e3")], "claim string, edge string")
    batch, owners = edges.where("claim = 'c1'").withColumn("edge", F.lit("e9")), spark.createDataFrame([("c1",), ("c2",)], "claim string")
    assert sorted(map(tuple, store.replace_edges(edges, batch, "claim", owners).collect())) == [("c1", "e9"), ("c3", "e3")]


def test_folding_and_tokens_of_odd_letters(spark):
    words = ["Straße", "STRASSE", "Kelvin \u212a5", "\u017fix", "ﬁne Ǆ", "ΣΊΣΥΦΟΣ ς", "plain", "١٢ 3.5%"]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select("t", T.folded(F.col("t")).alias("f"), T.retrieval_tokens(F.col("t")).alias("r"), T.verifier_tokens(F.col("t")).alias("v")).collect()
    import re

    for r in rows:
        assert r["f"] == r["t"].casefold()
        assert r["r"] == [x.casefold() for x in re.findall(r"[a-z0-9]+|[一-鿿]", r["t"], re.IGNORECASE)]
        want = [x.casefold() for x in re.findall(r"[a-zA-Z]+(?:[-'][a-zA-Z]+)*|\d+(?:\.\d+)?%?|[一-鿿]", r["t"])]
        assert sorted(r["v"]) == sorted(set(want) - set(T.VERIFIER_STOPWORDS))


def test_vectors_of_different_lengths_are_an_error(spark):
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>").select(V.cosine(F.col("a"), F.col("b"))).collect()


def test_an_error_of_a_model_stays_with_its_text(spark):
    def embed(texts):
        if "bad" in texts:
            raise ValueError("refused")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(i, "bad" if i == 5 else "x" * i) for i in range(12)], "id int, text string").coalesce(1)
    got = {r["id"]: r for r in ports.embedded(rows, embed, "id").collect()}
    assert got[5]["error"] == "refused" and all((r["error"] is None) == (i != 5) for i, r in got.items())
