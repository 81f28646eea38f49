"""Dataset validation: rules give (rule, key) for each violation.

Rules about the rows of one table are compiled into one expression, the array of the rules that a row breaks, which is
exploded once: a table is read once for all of them. Rules that compare tables meet in one aggregation by key (`met`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.layout import settled

MAX_ERRORS = 50


def _hits(rows: DataFrame, rule: str, key: str, bad: Column) -> DataFrame:
    return rows.where(F.coalesce(bad, F.lit(True))).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def compiled(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks; a rule is what must not be. Unknown counts as broken."""
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items())))


def broken(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) for every rule that a row breaks, in one pass."""
    return told(rows.select(F.col(key).cast("string").alias("key"), compiled(rules).alias("broken")), "key")


def told(rows: DataFrame, key: str, found: str = "broken") -> DataFrame:
    """(rule, key) of rows that hold the array of their broken rules. The outer form: the inner one would test the array, and so make it, twice."""
    return rows.select(F.explode_outer(found).alias("rule"), F.col(key).cast("string").alias("key")).where("rule is not null")


def met(key: str, **sides: DataFrame) -> DataFrame:
    """One row for each key of any side: n_<side>, its number of rows, and <side>, the columns of one (the greatest).

    All sides go through one aggregation, which is begun before the shuffle, so a key of many rows is no more than a row
    from each task.
    """
    parts = [df.select(F.col(key).alias("key"), F.lit(1).alias(f"n_{name}"), F.struct(*df.columns).alias(name)) for name, df in sides.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy("key").agg(*(F.coalesce(F.sum(f"n_{name}"), F.lit(0)).alias(f"n_{name}") for name in sides), *(F.max(name).alias(name) for name in sides))


def gathered(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def capped(violations: DataFrame, most: int = MAX_ERRORS) -> DataFrame:
    """The first `most` violations by rule and key, each with the number of all and whether some are left out."""
    n = violations.agg(F.count("*").alias("n_total"))
    return violations.orderBy("rule", "key").limit(most).crossJoin(F.broadcast(n)).withColumn("truncated", F.col("n_total") > most)  # one row


def unique(rows: DataFrame, rule: str, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def subset(rows: DataFrame, key: str, of: DataFrame, rule: str) -> DataFrame:
    return rows.join(of.select(key).distinct(), key, "left_anti").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def same_sets(a: DataFrame, b: DataFrame, key: str, rule: str) -> DataFrame:
    return gathered(subset(a, key, b, f"{rule}_missing"), subset(b, key, a, f"{rule}_extra"))


def chunk_facts(chunks: DataFrame, papers: DataFrame, most: int) -> DataFrame:
    """What the rules about chunks need, without their texts, kept in the shared folder; broken: the rules that a chunk breaks by itself."""
    joined = chunks.join(papers.select("paper_id", F.col("work_id").alias("_work"), F.col("pages").alias("_pages")), "paper_id", "left")
    known = F.col("_work").isNotNull()
    rules = {
        "char_count": (F.col("char_count") != F.length("text")) | (F.col("char_count") > most), "content_sha256": F.col("content_sha256") != F.sha2("text", 256), "known_paper": ~known,
        "inherited_work": known & ~F.col("work_id").eqNullSafe(F.col("_work")), "page_range": known & ~F.col("page_number").between(1, F.col("_pages")),
    }
    there = [c for c in ("previous_chunk_id", "next_chunk_id", "work_id", "dataset_split", "tuning_allowed") if c in chunks.columns]
    if "tuning_allowed" in there:
        rules["test_not_tuned"] = F.coalesce(F.col("dataset_split") == "test", F.lit(False)) & F.col("tuning_allowed")
    return settled(joined.select("chunk_id", *there, compiled(rules).alias("broken")))


def chunk_rules(chunks: DataFrame, papers: DataFrame, most: int) -> DataFrame:
    """All rules about chunks(chunk_id, paper_id, text, char_count, content_sha256, page_number, work_id, previous_chunk_id, next_chunk_id, dataset_split, tuning_allowed); each table is read once."""
    facts = chunk_facts(chunks, papers, most)
    return gathered(unique(facts, "chunk_id_unique", "chunk_id"), told(facts, "chunk_id"), link_rules(facts), split_rules(facts))


def link_rules(chunks: DataFrame) -> DataFrame:
    """Neighbours exist and point back."""
    ids = chunks.select(F.col("chunk_id").alias("_id"), F.col("previous_chunk_id").alias("previous_link"), F.col("next_chunk_id").alias("next_link"))
    links = chunks.select("chunk_id", F.explode(F.array(F.struct(F.lit("next_link").alias("rule"), F.col("next_chunk_id").alias("to")), F.struct(F.lit("previous_link").alias("rule"), F.col("previous_chunk_id").alias("to")))).alias("x")).select("chunk_id", "x.*").where("to is not null")
    back = F.when(F.col("rule") == "next_link", F.col("previous_link")).otherwise(F.col("next_link"))
    return links.join(ids, F.col("to") == F.col("_id"), "left").where(~back.eqNullSafe(F.col("chunk_id"))).select("rule", F.col("chunk_id").cast("string").alias("key"))


def split_rules(chunks: DataFrame) -> DataFrame:
    """One split and one tuning flag for a work."""
    by = chunks.groupBy("work_id").agg(F.min("dataset_split").alias("s"), F.max("dataset_split").alias("s2"), F.min("tuning_allowed").alias("t"), F.max("tuning_allowed").alias("t2"))
    return broken(by, "work_id", {"one_split": F.col("s") != F.col("s2"), "one_tuning_flag": F.col("t") != F.col("t2")})


def duplicate_rules(files: DataFrame) -> DataFrame:
    """Exactly one canonical file for a digest, and equal inherited fields."""
    by = files.groupBy("sha256").agg(F.count_if(~F.col("is_exact_duplicate")).alias("c"), F.countDistinct("work_id").alias("w"))
    return gathered(_hits(by, "one_canonical", "sha256", F.col("c") != 1), _hits(by, "duplicate_inherits", "sha256", F.col("w") != 1))


def link_target_rules(records: DataFrame) -> DataFrame:
    """Translations and variants point to an original of the same work; others point nowhere."""
    own = records.select(F.col("paper_id").alias("_t"), F.col("work_id").alias("_w"), F.col("document_type").alias("_d"))
    target = F.coalesce("translation_of", "variant_of")
    joined = records.withColumn("_target", target).join(own, F.col("_target") == F.col("_t"), "left")
    has = F.col("_target").isNotNull()
    return gathered(
        _hits(joined.where(has), "target_exists", "paper_id", F.col("_t").isNull()),
        _hits(joined.where(has & F.col("_t").isNotNull()), "target_same_work", "paper_id", F.col("_w") != F.col("work_id")),
        _hits(joined.where(F.col("translation_of").isNotNull() & F.col("_t").isNotNull()), "translation_of_original", "paper_id", (F.col("_d") != "original") | (F.col("document_type") != "translation")),
        _hits(joined.where(F.col("index_policy") == "primary"), "primary_has_no_target", "paper_id", has),
    )


def path_rules(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """No absolute path in any of the columns."""
    return gathered(*(_hits(rows.where(F.col(c).isNotNull()), f"absolute_path_{c}", key, F.col(c).rlike(r"^(/|\\|[A-Za-z]:[\\/]|file:)")) for c in columns))


def count_rules(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(rule, key) of names whose numbers differ; both sides are (name, n)."""
    j = expected.join(actual.withColumnRenamed("n", "m"), "name", "full_outer")
    return _hits(j, "summary_count", "name", ~F.col("n").eqNullSafe(F.col("m")))


def question_rules(questions: DataFrame, papers: DataFrame, blocks: DataFrame) -> DataFrame:
    """questions(question_id, paper_id, page_number, block_ids, answer): held-out paper, known page, blocks on it, answer in their text."""
    q = questions.join(papers.select("paper_id", F.col("dataset_split").alias("_s"), F.col("pages").alias("_p")), "paper_id", "left")
    ids = questions.select("question_id", "paper_id", "page_number", F.posexplode("block_ids").alias("n", "block_id"))
    found = ids.join(blocks.select("paper_id", "page_number", "block_id", F.col("text").alias("_t")), ["paper_id", "page_number", "block_id"], "left")
    text = found.groupBy("question_id").agg(F.count_if(F.col("_t").isNull()).alias("lost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "_t"))), lambda x: x["_t"]), " ").alias("whole"))
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return gathered(
        _hits(q, "question_paper", "question_id", F.col("_s").isNull()),
        _hits(q.where("_s is not null"), "question_held_out", "question_id", F.col("_s") != "test"),
        _hits(q.where("_s is not null"), "question_page", "question_id", ~F.col("page_number").between(1, F.col("_p"))),
        _hits(text, "question_blocks", "question_id", F.col("lost") > 0),
        _hits(questions.join(text, "question_id"), "answer_in_blocks", "question_id", ~F.contains(flat(F.col("whole")), flat(F.col("answer")))),
    )


def schema_rules(rows: DataFrame, key: str, required: list[str], patterns: dict[str, str], allowed: dict[str, list[str]]) -> DataFrame:
    """Declared checks in place of a schema language: required fields, patterns, allowed values."""
    parts = [_hits(rows, f"required_{c}", key, F.col(c).isNull() | (F.col(c).cast("string") == "")) for c in required]
    parts += [_hits(rows.where(F.col(c).isNotNull()), f"pattern_{c}", key, ~F.col(c).rlike(p)) for c, p in patterns.items()]
    parts += [_hits(rows.where(F.col(c).isNotNull()), f"allowed_{c}", key, ~F.col(c).isin(*v)) for c, v in allowed.items()]
    return gathered(*parts)
