"""Ports for models: functions of batches that become columns. A port gives a value or an error for every row, never both."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], key: str, text: str = "text", dimension: int | None = None, instruction: str = "") -> DataFrame:
    """(key, vector, error): `embed` takes the texts of an Arrow batch; an instruction is put before queries."""

    def run(batches: Iterator):
        import math

        import pyarrow as pa

        def one_by_one(texts: list[str]) -> list[tuple]:
            """(vector, error) of each text; a call that fails is made again for both halves, so an error stays with its text."""
            try:
                got = [list(map(float, v)) for v in embed(texts)]
                if len(got) != len(texts):
                    raise ValueError("wrong number of vectors")
            except ValueError as e:
                half = len(texts) // 2
                return one_by_one(texts[:half]) + one_by_one(texts[half:]) if half else [(None, str(e))] * len(texts)
            return [(v, None) if v and all(map(math.isfinite, v)) and dimension in (None, len(v)) else (None, "invalid vector") for v in got]

        for b in batches:
            out = one_by_one([instruction + (t or "") for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v for v, _ in out], pa.list_(pa.float64())), pa.array([e for _, e in out], pa.string())], [key, "vector", "error"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, vector array<double>, error string")


def rerank_scores(pairs: DataFrame, score: Callable[[str, list[str]], list[float]]) -> DataFrame:
    """(query_id, doc_id, rerank_score) of pairs(query_id, doc_id, query, text): all scores of a query, or an error for the task."""

    def run(key, table):
        import pyarrow as pa

        texts = table.column("text").to_pylist()
        got = list(map(float, score(table.column("query")[0].as_py(), texts)))
        if len(got) != len(texts):
            raise ValueError("a reranker must score every passage")
        return pa.table({"query_id": table.column("query_id"), "doc_id": table.column("doc_id"), "rerank_score": pa.array(got)})

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("query_id", "doc_id")}
    return pairs.select("query_id", "doc_id", "query", "text").groupBy("query_id").applyInArrow(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, rerank_score double")


def entailment(claims: DataFrame, judge: Callable[[str, list[str]], dict]) -> DataFrame:
    """(claim_id, label, confidence) of claims(claim_id, text, texts); an exception or a malformed answer gives no row, so that verification fails closed."""

    def run(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            out = []
            for i, text, texts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    r = judge(text, texts or [])
                    out.append((i, str(r["label"]), float(r["confidence"])))
                except Exception:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["claim_id", "label", "confidence"])

    return claims.select(F.col("claim_id").cast("string").alias("claim_id"), "text", "texts").mapInArrow(run, "claim_id string, label string, confidence double")
