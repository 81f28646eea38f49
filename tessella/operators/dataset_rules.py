"""The rules between the tables of a prepared dataset; each function compares its tables in one aggregation by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.validate import broken, gathered, met

#: What documents and chunks take over from the canonical record of their paper.
INHERITED = ("work_id", "dataset_split", "tuning_allowed", "indexable", "index_policy")


def _there(side: str) -> Column:
    return F.col(f"n_{side}") > 0


def _differs(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def canonical_rules(manifest: DataFrame, canonical: DataFrame) -> DataFrame:
    """The canonical table is exactly the manifest without its exact duplicates; both have the same columns, with file_id and is_exact_duplicate."""
    columns = manifest.columns
    rows = met("file_id", manifest=manifest, canonical=canonical.select(*columns))
    expected = _there("manifest") & ~F.coalesce(F.col("manifest.is_exact_duplicate"), F.lit(True))
    both = _there("manifest") & _there("canonical")
    return broken(rows, "key", {
        "file_id_unique": F.col("n_manifest") > 1, "canonical_is_duplicate": _there("canonical") & F.coalesce(F.col("canonical.is_exact_duplicate"), F.lit(True)),
        "canonical_missing": expected & ~_there("canonical"), "canonical_extra": _there("canonical") & ~expected, "canonical_differs": both & _differs("manifest", "canonical"),
    })


def duplicate_group_rules(manifest: DataFrame, groups: DataFrame) -> DataFrame:
    """Files that share a digest: one is canonical and the others follow it; groups(sha256, paper_id, canonical_relative_path, aliases) name exactly them.

    manifest: file_id, sha256, relative_path, canonical_relative_path, paper_id, is_exact_duplicate, duplicate_of_file_id,
    index_policy and the columns of INHERITED. Paths of a group are compared as rows, so a group may be of any size.
    """
    own = ["file_id", "relative_path", "paper_id", "duplicate_of_file_id", *INHERITED]
    first = manifest.where(~F.col("is_exact_duplicate")).select("sha256", F.struct(*own).alias("first"))
    by = manifest.groupBy("sha256").agg(F.count("*").alias("files"), F.count_if(~F.col("is_exact_duplicate")).alias("firsts"))
    one = by.join(first.groupBy("sha256").agg(F.max("first").alias("first")), "sha256", "left")
    rows = manifest.join(one.where("firsts = 1").select("sha256", "first"), "sha256")
    follows = F.col("is_exact_duplicate") & F.col("duplicate_of_file_id").eqNullSafe(F.col("first.file_id")) & F.col("index_policy").eqNullSafe(F.lit("skip_exact_duplicate")) & ~F.col("indexable")
    is_first = F.col("file_id") == F.col("first.file_id")
    each = broken(rows, "file_id", {
        "canonical_points_nowhere": is_first & F.col("duplicate_of_file_id").isNotNull(), "canonical_path": _differs("canonical_relative_path", "first.relative_path"), "same_paper": _differs("paper_id", "first.paper_id"),
        "duplicate_follows": ~is_first & ~F.coalesce(follows, F.lit(False)), **{f"duplicate_{c}": ~is_first & _differs(c, f"first.{c}") for c in INHERITED[:3]},
    })
    sides = met("sha256", digests=one, groups=groups)
    many = _there("digests") & (F.col("digests.files") > 1)
    listed = many & _there("groups")
    head = broken(sides, "key", {
        "one_canonical": _there("digests") & (F.col("digests.firsts") != 1), "group_unique": F.col("n_groups") > 1, "group_missing": many & ~_there("groups"), "group_extra": _there("groups") & ~many,
        "group_paper": listed & (F.col("digests.firsts") == 1) & _differs("groups.paper_id", "digests.first.paper_id"), "group_path": listed & (F.col("digests.firsts") == 1) & _differs("groups.canonical_relative_path", "digests.first.relative_path"),
        "aliases_sorted": _there("groups") & (F.col("groups.aliases") != F.array_sort("groups.aliases")),
    })
    named = lambda df, c: df.select("sha256", F.col(c).alias("path"), F.concat_ws(" ", "sha256", c).alias("both"))
    listed_paths = named(groups.select("sha256", F.explode("aliases").alias("alias")), "alias")
    paths = met("both", files=named(manifest.join(by.where("files > 1").select("sha256"), "sha256", "left_semi"), "relative_path"), aliases=listed_paths)
    return gathered(each, head, broken(paths, "key", {"alias_missing": _there("files") & ~_there("aliases"), "alias_extra": _there("aliases") & ~_there("files")}))


def document_rules(documents: DataFrame, canonical: DataFrame, chunks: DataFrame, max_chunk_chars: int) -> DataFrame:
    """documents(paper_id, filename, chunk_count, max_chunk_chars, INHERITED) are those of the canonical table, and have the chunks that they count."""
    rows = met("paper_id", documents=documents, canonical=canonical.select("paper_id", *INHERITED), chunks=chunks.groupBy("paper_id").agg(F.count("*").alias("n")))
    doc, both = _there("documents"), _there("documents") & _there("canonical")
    return broken(rows, "key", {
        "document_unique": F.col("n_documents") > 1, "paper_unique": F.col("n_canonical") > 1, "document_missing": _there("canonical") & ~doc, "document_extra": doc & ~_there("canonical"),
        "document_name": doc & ~F.col("documents.filename").eqNullSafe(F.concat("key", F.lit(".json"))), "chunk_without_document": _there("chunks") & ~doc,
        "chunk_count": doc & ~F.col("documents.chunk_count").cast("long").eqNullSafe(F.coalesce(F.col("chunks.n"), F.lit(0))), "document_max_chunk_chars": doc & ~F.col("documents.max_chunk_chars").cast("long").eqNullSafe(F.lit(max_chunk_chars).cast("long")),
        **{f"document_{c}": both & _differs(f"documents.{c}", f"canonical.{c}") for c in INHERITED},
    })


def work_rules(works: DataFrame, manifest: DataFrame, papers: DataFrame) -> DataFrame:
    """works(work_id, dataset_split, tuning_allowed) are those of the manifest; a work has one split and one flag, test is not tuned on, and the papers(work_id) to evaluate are of all held-out works."""
    of = manifest.groupBy("work_id").agg(F.min("dataset_split").alias("low"), F.max("dataset_split").alias("high"), F.min("tuning_allowed").alias("t0"), F.max("tuning_allowed").alias("t1"))
    rows = met("work_id", works=works, manifest=of, papers=papers.select("work_id").distinct())
    held_out = _there("manifest") & (F.col("manifest.low") == "test") & (F.col("manifest.high") == "test")
    return broken(rows, "key", {
        "work_unique": F.col("n_works") > 1, "work_missing": _there("manifest") & ~_there("works"), "work_extra": _there("works") & ~_there("manifest"),
        "one_split": _there("manifest") & _differs("manifest.low", "manifest.high"), "one_tuning_flag": _there("manifest") & _differs("manifest.t0", "manifest.t1"),
        "test_work_tuned": _there("works") & (F.col("works.dataset_split") == "test") & F.coalesce(F.col("works.tuning_allowed"), F.lit(True)),
        "held_out_without_paper": F.coalesce(held_out, F.lit(False)) & ~_there("papers"), "paper_of_other_work": _there("papers") & ~F.coalesce(held_out, F.lit(False)),
    })


def paper_rules(papers: DataFrame, canonical: DataFrame) -> DataFrame:
    """papers(paper_id, work_id, split, tuning_allowed) to evaluate are canonical test records."""
    rows = met("paper_id", papers=papers, canonical=canonical.select("paper_id", "work_id", "dataset_split"))
    record = _there("canonical") & F.col("canonical.work_id").eqNullSafe(F.col("papers.work_id")) & F.col("canonical.dataset_split").eqNullSafe(F.lit("test"))
    return broken(rows.where(_there("papers")), "key", {
        "paper_unique": F.col("n_papers") > 1, "paper_is_test_record": ~record, "paper_labelled_test": ~F.col("papers.split").eqNullSafe(F.lit("test")), "paper_not_tuned": F.coalesce(F.col("papers.tuning_allowed"), F.lit(True)),
    })


def partition_rules(chunks: DataFrame, development: DataFrame, evaluation: DataFrame) -> DataFrame:
    """development and evaluation are exactly the indexable chunks of their splits, the rows as they are in chunks.

    Rows are compared by a 64-bit digest of all their columns.
    """
    columns = chunks.columns
    brief = lambda df: df.select("chunk_id", F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("h"), "dataset_split", "tuning_allowed", "indexable")
    rows = met("chunk_id", chunks=brief(chunks), development=brief(development), evaluation=brief(evaluation))
    rules = {"chunk_unique": F.col("n_chunks") > 1, "partitions_overlap": _there("development") & _there("evaluation")}
    for side, split, tuned in (("development", "development", True), ("evaluation", "test", False)):
        expected = F.coalesce(_there("chunks") & (F.col("chunks.dataset_split") == split) & F.col("chunks.indexable"), F.lit(False))
        isolated = F.col(f"{side}.dataset_split").eqNullSafe(F.lit(split)) & F.col(f"{side}.tuning_allowed").eqNullSafe(F.lit(tuned)) & F.coalesce(F.col(f"{side}.indexable"), F.lit(False))
        rules |= {
            f"{side}_unique": F.col(f"n_{side}") > 1, f"{side}_missing": expected & ~_there(side), f"{side}_extra": _there(side) & ~expected,
            f"{side}_differs": _there(side) & ~F.col(f"{side}.h").eqNullSafe(F.col("chunks.h")), f"{side}_isolated": _there(side) & ~isolated,
        }
    return broken(rows, "key", rules)


def flag_rules(config: DataFrame, summary: DataFrame) -> DataFrame:
    """config(source_integrity_verified, max_chunk_chars) and summary(source_integrity_verified), a row each; a table without a row breaks all its rules."""
    one = lambda df, *cols: df.agg(*(F.max(c).alias(c) for c in cols)).withColumn("key", F.lit("dataset"))
    verified = {"source_integrity_verified": ~F.coalesce(F.col("source_integrity_verified"), F.lit(False))}
    c = broken(one(config, "source_integrity_verified", "max_chunk_chars").withColumn("key", F.lit("config")), "key", verified | {"max_chunk_chars": F.col("max_chunk_chars").isNull() | (F.col("max_chunk_chars") < 400)})
    return c.unionByName(broken(one(summary, "source_integrity_verified").withColumn("key", F.lit("summary")), "key", verified))
