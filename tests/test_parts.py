"""Recursive splitting against a slow walk over strings, nearest parts against all pairs, canonical JSON against the standard library."""

from __future__ import annotations

import datetime as dt
import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import vectors as V
from tessella.operators import chunking, retrieval


def slow_pieces(text, separator):
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in [head, *(separator + r for r in rest)] if p]


def slow_joins(pieces, size, overlap):
    """Every piece is added to a list; a full list is given out and loses pieces at its front."""
    now, out = [], []
    for p in pieces:
        if now and len("".join(now)) + len(p) > size:
            out.append("".join(now))
            while now and (len("".join(now)) > overlap or len("".join(now)) + len(p) > size):
                now.pop(0)
        now.append(p)
    return [*out, "".join(now)] if now else out


def slow_parts(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    separator = next(s for s in separators if s in text)
    out, small = [], []
    for p in slow_pieces(text, separator):
        if len(p) < size:
            small.append(p)
            continue
        out, small = out + slow_joins(small, size, overlap), []
        out += slow_parts(p, size, overlap, separators[separators.index(separator) + 1 :]) if separator else [p]
    return [p for p in out + slow_joins(small, size, overlap)]


@settings(max_examples=500, deadline=None)
@given(st.text("ab \n ", max_size=120), st.integers(2, 20), st.data())
def test_recursive_parts_against_a_slow_walk(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    found = [text[a:b] for a, b in chunking.recursive_offsets(text, size, overlap)]
    assert found == [p.strip() for p in slow_parts(text, size, overlap) if p.strip()]
    assert all(len(p) <= size for p in found)
    spans = chunking.recursive_offsets(text, size, overlap)
    assert spans == sorted(spans) and not text.strip() or {i for i, c in enumerate(text) if not c.isspace()} <= {i for a, b in spans for i in range(a, b)}


def test_long_texts_nulls_and_wrong_sizes(spark):
    runs = chunking.recursive_offsets("x" * 3_000_000)
    assert runs[0] == (0, 1500) and runs[1] == (1300, 2800) and runs[-1][1] == 3_000_000 and len(runs) == math.ceil((3_000_000 - 200) / 1300)
    words = chunking.recursive_offsets("word " * 400_000)
    assert all(b - a <= 1500 for a, b in words) and words[-1][1] == 1_999_999
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "one")], "i int, text string").select("i", chunking.recursive_split(F.col("text")).alias("p"))
    assert {r["i"]: [tuple(x) for x in r["p"]] for r in rows.collect()} == {1: [], 2: [], 3: [], 4: [(0, "one")]}
    for size, overlap in ((5, 5), (5, -1), (0, 0)):
        with pytest.raises(ValueError, match="overlap"):
            chunking.recursive_offsets("a", size, overlap)
        with pytest.raises(ValueError, match="overlap"):
            chunking.recursive_split(F.lit("a"), size, overlap)


def test_nearest_parts_against_all_pairs(spark):
    texts = {1: "alpha beta gamma delta\n\nalpha epsilon zeta", 2: "beta beta eta theta\niota kappa alpha alpha", 3: None, 4: "alpha beta gamma delta\n\nalpha epsilon zeta", 5: "alpha alpha alpha"}
    questions = {10: "alpha beta", 11: "kappa", 12: "nothing here"}
    found = [(10, 1), (10, 2), (10, 3), (10, 4), (10, 1), (11, 2), (11, 4), (12, 9)]
    asked = spark.createDataFrame(list(questions.items()), "query_id long, text string")
    vectors = asked.select("query_id", V.hashing_embedding(T.retrieval_tokens(F.col("text"))).alias("vector"))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    results = spark.createDataFrame(found, "query_id long, doc_id long")
    got = retrieval.best_parts(results, docs, vectors, 3, 20, 6).collect()
    parts = [(d, a, t[a:b]) for d, t in texts.items() if t for a, b in chunking.recursive_offsets(t, 20, 6)]
    embed = lambda rows: {r["k"]: list(r["v"]) for r in spark.createDataFrame(rows, "k string, t string").select("k", V.hashing_embedding(T.retrieval_tokens(F.col("t"))).alias("v")).collect()}
    pv, qv = embed([(f"{d}:{a}", t) for d, a, t in parts]), embed([(str(q), t) for q, t in questions.items()])
    expected = []
    for q in questions:
        scored = sorted((-round(sum(x * y for x, y in zip(qv[str(q)], pv[f"{d}:{a}"], strict=True)), 6) + 0.0, d, a, t) for d, a, t in parts if (q, d) in found)
        expected += [(q, d, a, t, -s + 0.0, r) for r, (s, d, a, t) in enumerate(scored[:3], 1)]
    assert sorted((r["query_id"], r["doc_id"], r["start"], r["part"], r["score"] + 0.0, r["rank"]) for r in got) == sorted(expected)
    assert {r["query_id"] for r in got} == {10, 11}  # 5 is nobody's result, 12 found no text


def test_canonical_json(spark):
    values = [
        {"b": 1, "a": [1.5, None, 1e22, 1e-7, 2e-3, 100], "é": {"z": "q\"\\\n\t\u001f /é", "A": True}, "m": {}},
        [3, {"y": None, "x": [[]]}, "t"], 7, 1.25, True, "text",
    ]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    got = {r["i"]: r["c"] for r in rows.select("i", T.canonical_text(F.parse_json("t")).alias("c")).collect()}
    assert got == {i: json.dumps(v, ensure_ascii=False, sort_keys=True) for i, v in enumerate(values)}
    typed = spark.createDataFrame([({"k2": [1, None], "k1": []}, ("x", None, 0.1)), (None, ("", 2, 100.0)), (None, None)], "m map<string,array<int>>, s struct<b:string,a:int,c:double>")
    got = [tuple(r) for r in typed.select(T.canonical_text(F.col("m")), T.canonical_text(F.col("s"))).collect()]
    assert got == [('{"k1": [], "k2": [1, null]}', '{"a": null, "b": "x", "c": 0.1}'), ("", '{"a": 2, "b": "", "c": 100.0}'), ("", "")]


def test_stripped_text(spark):
    texts = [None, "", "  a b\n", "　x \x1c", "\x0b\x85", "a\n\n", dt.date(2024, 1, 1).isoformat()]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert {r["i"]: r["c"] for r in rows.select("i", T.content_text(F.col("t")).alias("c")).collect()} == {i: (t or "").strip() for i, t in enumerate(texts)}
