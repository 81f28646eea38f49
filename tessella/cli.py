"""Command line: index, search, research and doctor over Parquet tables.

A passage table has doc_id, text, section, page_number, title; a vector table evidence_id, content_sha256, model, vector.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import ids
from tessella.plans import flows
from tessella.sources import adapters


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessella")
    sub = top.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="embed passages that have no fresh vector yet")
    index.add_argument("--passages", required=True)
    index.add_argument("--vectors", required=True)
    index.add_argument("--dataset-split", default="development")
    index.add_argument("--limit", type=int)
    index.add_argument("--model", default="hashing")
    index.add_argument("--embedding-dimension", type=int, default=64)
    index.add_argument("--force-reindex", action="store_true")
    index.add_argument("--dry-run", action="store_true")
    search = sub.add_parser("search")
    search.add_argument("query")
    search.add_argument("--passages", required=True)
    search.add_argument("--top-k", type=int, default=8)
    search.add_argument("--retrieval-mode", choices=flows.MODES, default="hybrid-rerank")
    research = sub.add_parser("research", help="exit code 0 if something could be published, else 2")
    research.add_argument("question")
    research.add_argument("--passages", required=True)
    research.add_argument("--top-k", type=int, default=5)
    research.add_argument("--retrieval-mode", choices=flows.MODES, default="hybrid-rerank")
    research.add_argument("--format", choices=("markdown", "json"), default="markdown")
    doctor = sub.add_parser("doctor", help="exit code 0 if all checks pass, else 2")
    doctor.add_argument("--passages", required=True)
    doctor.add_argument("--vectors", required=True)
    doctor.add_argument("--embedding-dimension", type=int, default=64)
    return top


def _one(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("q", text)], "query_id string, text string")


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[int, str]:
    """(exit code, what to print)."""
    passages = spark.read.parquet(args.passages)
    if args.command == "index":
        rows = passages if "dataset_split" not in passages.columns else adapters.selected(passages.withColumn("indexable", F.col("indexable") if "indexable" in passages.columns else F.lit(True)), args.dataset_split)
        rows = rows.select(F.col("doc_id").cast("string").alias("evidence_id"), "text", ids.text_sha256(F.col("text")).alias("content_sha256"))
        rows = rows.orderBy("evidence_id").limit(args.limit) if args.limit else rows
        schema = "evidence_id string, content_sha256 string, model string, vector array<double>"
        jvm = spark._jvm.org.apache.hadoop.fs.Path(args.vectors)
        there = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
        old = spark.read.parquet(args.vectors) if there and not args.force_reindex else spark.createDataFrame([], schema)
        new = flows.index(rows, old, args.model, args.embedding_dimension)
        if not args.dry_run:
            new.write.mode("overwrite" if args.force_reindex else "append").parquet(args.vectors)
            return 0, json.dumps({"requested": rows.count(), "vectors": spark.read.parquet(args.vectors).count()})
        return 0, json.dumps({"requested": rows.count(), "pending": new.count()})
    if args.command == "search":
        hits = flows.search(_one(spark, args.query), passages, args.top_k, args.retrieval_mode).orderBy("rank")
        return 0, "\n".join(hits.toJSON().collect())  # top_k rows
    if args.command == "research":
        r = flows.answer(_one(spark, args.question), passages, args.top_k, args.retrieval_mode).first()
        shown = json.dumps(r.asDict(), ensure_ascii=False) if args.format == "json" else r["report"] or f"status: {r['status']}"
        return (0 if r["status"] != "failed" else 2), shown
    checks = flows.health(passages, spark.read.parquet(args.vectors), args.embedding_dimension).collect()
    return (0 if all(c["ok"] for c in checks) else 2), json.dumps({c["check"]: c["ok"] for c in checks})


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessella").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    code, shown = run(spark, args)
    print(shown)
    return code


if __name__ == "__main__":
    sys.exit(main())
