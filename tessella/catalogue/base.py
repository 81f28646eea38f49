"""How queries are registered: a function of (spark, sf_dir), with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.layout import spread


class Registry:
    """The queries of one module."""

    def __init__(self):
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.SQL: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.QUERIES[f.__name__] = f
            if sql:
                self.SQL[f.__name__] = sql
            return f

        return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """A table for work that is heavy for each row."""
    return spread(read(spark, sf_dir, table), key)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in the role of files: a path, a digest, a type and a language each."""
    d = read(spark, sf_dir, "documents")
    folder = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("baseline/"), "source")).otherwise(F.col("source"))
    return d.select(
        F.format_string("file-%08d", F.col("doc_id")).alias("file_id"), F.concat(folder, F.format_string("/doc_%08d.pdf", F.col("doc_id"))).alias("relative_path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("byte_size"),
        F.format_string("paper-%08d", F.col("doc_id")).alias("paper_id"), F.concat(F.lit("work-"), (F.col("doc_id") % 97).cast("string")).alias("work_id"), F.when(F.col("lang") == "en", "original").otherwise("translation").alias("document_type"), F.col("lang").alias("language"),
        F.col("source").alias("category"), (F.col("n_chars") / 3000 + 1).cast("bigint").alias("pages"), "doc_id", "text",
    )


FILES = """files as (select printf('file-%08d', doc_id) file_id, case when doc_id % 5 = 0 then 'baseline/' else '' end || source || printf('/doc_%08d.pdf', doc_id) relative_path, sha256(text) sha256, n_chars byte_size,
 printf('paper-%08d', doc_id) paper_id, 'work-' || cast(doc_id % 97 as varchar) work_id, case when lang = 'en' then 'original' else 'translation' end document_type, lang as "language", source category,
 cast(floor(n_chars / 3000.0 + 1) as bigint) pages, doc_id, text from documents),
pref as (select *, case when list_has_any(string_split(lower(relative_path), '/'), ['baseline', 'baseline2']) then 1 else 0 end p1, len(string_split(relative_path, '/')) p2 from files)"""

CANON = FILES + """,
canon as (select *, first_value(relative_path) over w canonical_path, first_value(file_id) over w canonical_id from pref window w as (partition by sha256 order by p1, p2, relative_path)),
marked as (select *, file_id <> canonical_id is_exact_duplicate from canon)"""

POLICY = CANON + """,
rec as (select *, row_number() over (partition by work_id, document_type order by p1, p2, relative_path) n, max(case when document_type = 'original' then 1 else 0 end) over (partition by work_id) originals from marked where not is_exact_duplicate),
prim as (select *, max(case when n = 1 and (document_type = 'original' or originals = 0) then paper_id end) over (partition by work_id) prim from rec),
pol as (select *, case when document_type = 'original' and n = 1 then 'primary' when n = 1 and originals = 0 then 'primary_translation_only' when document_type <> 'original' and n = 1 then 'auxiliary_translation' else 'skip_semantic_variant' end index_policy from prim),
records as (select *, index_policy <> 'skip_semantic_variant' indexable, case when document_type <> 'original' and originals = 1 then prim end translation_of, case when index_policy = 'skip_semantic_variant' then prim end variant_of from pol)"""
