"""Evaluation: retrieval metrics, confusion, label metrics, ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T


def first_relevant(ranked: DataFrame, relevant: Column) -> DataFrame:
    """(query_id, first_rank): the rank of the first relevant hit, null if there is none."""
    return ranked.groupBy("query_id").agg(F.min(F.when(relevant, F.col("rank"))).alias("first_rank"))


def recall_mrr(questions: DataFrame, firsts: DataFrame, k: int) -> DataFrame:
    """One row (n_queries, recall, mrr) over all questions; those without hits count as misses."""
    joined = questions.select("query_id").join(firsts, "query_id", "left")
    hit = F.coalesce(F.col("first_rank") <= k, F.lit(False))
    return joined.agg(F.count("*").alias("n_queries"), F.round(F.avg(hit.cast("double")), 6).alias("recall"), F.round(F.avg(F.when(hit, 1 / F.col("first_rank")).otherwise(F.lit(0.0))), 6).alias("mrr"))


def label_contained(a: Column, b: Column) -> Column:
    """Whether one text holds the other, whatever the case and the white space; false for null."""
    flat = [F.trim(F.regexp_replace(T.folded(c), r"(?U)\s+", " ")) for c in (a, b)]
    return F.coalesce(F.contains(*flat) | F.contains(*flat[::-1]), F.lit(False))


def retrieval_levels(cases: DataFrame, results: DataFrame) -> DataFrame:
    """One row of recall and mean reciprocal rank by source, page and exact text, with the share of rejected hits and the mean time.

    cases(query_id, source_id, page_number, label, seconds); results(query_id, rank, source_id, page_number, text, rejected).
    A page counts on its source only, a text on its page only; cases without hits are misses. No case gives nulls.
    """
    hits = results.select("query_id", "rank", F.col("source_id").alias("_s"), F.col("page_number").alias("_p"), F.col("text").alias("_t"), "rejected")
    source = F.col("source_id") == F.col("_s")
    page = source & (F.col("page_number") == F.col("_p"))
    first = lambda ok, name: F.min(F.when(ok, F.col("rank"))).alias(name)
    each = cases.join(hits, "query_id", "left").groupBy("query_id").agg(
        F.first("seconds").alias("seconds"), F.count("rank").alias("n"), F.count_if(F.coalesce("rejected", F.lit(False))).alias("bad"), first(source, "source"), first(page, "page"), first(page & label_contained(F.col("label"), F.col("_t")), "exact"),
    )
    levels = ("source", "page", "exact")
    return each.agg(
        F.count("*").alias("case_count"), *(F.round(F.avg(F.col(c).isNotNull().cast("double")), 6).alias(f"{c}_recall") for c in levels), *(F.round(F.avg(F.coalesce(1 / F.col(c), F.lit(0.0))), 6).alias(f"{c}_mrr") for c in levels),
        F.round(F.coalesce(F.sum("bad") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)), 6).alias("rejected_rate"), F.round(F.avg("seconds"), 3).alias("mean_seconds"),
    )


def confusion(rows: DataFrame, labels: list[str]) -> DataFrame:
    """One row for each expected label, one column for each predicted one."""
    return rows.groupBy("expected").pivot("predicted", labels).agg(F.count(F.lit(1))).na.fill(0, labels)


def publication(rows: DataFrame, positive: str = "supported") -> DataFrame:
    """One row (n, accuracy, precision, recall) for the label that is published."""
    right, said, so = F.col("expected") == F.col("predicted"), F.col("predicted") == positive, F.col("expected") == positive
    ratio = lambda a, b: F.round(F.coalesce(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), F.lit(0.0)), 6)
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"), ratio(said & so, said).alias("precision"), ratio(said & so, so).alias("recall"))


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole with two digits, 0 for nothing."""
    return F.coalesce(F.round(100 * part / F.nullif(whole, F.lit(0)), 2), F.lit(0.0))


def label_metrics(labels: DataFrame) -> DataFrame:
    """One row of percentages over claims labelled with the words true and false; citation_support says `supported`.

    Facts and scope count against all claims, times and numbers against those that have a label.
    """
    has = lambda c, v="true": F.coalesce(F.col(c) == v, F.lit(False))
    known = lambda c: F.count_if(F.coalesce(F.col(c).isin("true", "false"), F.lit(False)))
    cited, all_ = F.count_if(has("citation_present")), F.count("*")
    return labels.agg(
        all_.alias("n_claims"), percentage(F.count_if(has("citation_present") & has("citation_support", "supported")), cited).alias("citation_precision"), percentage(cited, all_).alias("citation_coverage"), percentage(F.count_if(has("citation_present") & has("source_exists")), cited).alias("source_validity"),
        *(percentage(F.count_if(has(c)), all_).alias(c) for c in ("factual_correct", "scope_complete")), *(percentage(F.count_if(has(c)), known(c)).alias(c) for c in ("temporal_correct", "numeric_correct")),
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """One row over the latest attempts: cases, mean duration, tokens and sources, searches, degraded cases."""
    latest = latest_attempts(runs)
    return latest.agg(
        F.count("*").alias("n_cases"), F.coalesce(F.bround(F.avg("duration_ms")), F.lit(0.0)).alias("mean_duration_ms"), F.coalesce(F.bround(F.avg("tokens")), F.lit(0.0)).alias("mean_tokens"), F.coalesce(F.bround(F.avg("sources"), 2), F.lit(0.0)).alias("mean_sources"),
        F.coalesce(F.sum("searches"), F.lit(0)).alias("n_searches"), F.count_if(F.coalesce("degraded", F.lit(False))).alias("n_degraded"),
    )


def error_histogram(labels: DataFrame) -> DataFrame:
    """(error_type, n) of the types that stand between bars."""
    return labels.select(F.explode(F.split("error_types", r"\|")).alias("error_type")).where("error_type <> ''").groupBy("error_type").agg(F.count("*").alias("n"))


def latest_attempts(runs: DataFrame) -> DataFrame:
    """The last attempt of each case; of equal attempts the one with the larger ordinal."""
    best = runs.groupBy("case_id").agg(F.max(F.struct("attempt", "ordinal")).alias("_b"))
    return runs.join(best, "case_id").where((F.col("attempt") == F.col("_b.attempt")) & (F.col("ordinal") == F.col("_b.ordinal"))).drop("_b")


def next_attempts(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """(case_id, next_attempt) of every case."""
    return cases.select("case_id").join(runs.groupBy("case_id").agg(F.max("attempt").alias("m")), "case_id", "left").select("case_id", (F.coalesce("m", F.lit(0)) + 1).alias("next_attempt"))


def batches(questions: DataFrame, quotas: dict[str, list[int]]) -> DataFrame:
    """questions with batch_no: of each type the first quota goes to batch 1, the next to 2 ...; what is over has none."""
    rank = F.row_number().over(Window.partitionBy("question_type").orderBy("question_id"))
    out = F.lit(None).cast("int")
    for kind, sizes in quotas.items():
        for i in range(len(sizes), 0, -1):
            out = F.when((F.col("question_type") == kind) & (F.col("_r") <= sum(sizes[:i])) & (F.col("_r") > sum(sizes[: i - 1])), i).otherwise(out)
    return questions.withColumn("_r", rank).withColumn("batch_no", out).drop("_r")


def ratings(scores: DataFrame) -> DataFrame:
    """(key, mean): scores of 1 to 5 as shares of 5."""
    return scores.groupBy("key").agg(F.round(F.avg(F.col("score") / 5), 6).alias("mean"))


def groundedness(claims: DataFrame) -> DataFrame:
    """One row (grounded, total, share)."""
    return claims.agg(F.count_if("grounded").alias("grounded"), F.count("*").alias("total"), F.round(F.coalesce(F.count_if("grounded") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6).alias("share"))


def preference_points(pairs: DataFrame) -> DataFrame:
    """(system, points): 1 for a preferred answer of a pair, 0 for the other, one half each for a tie."""
    side = lambda a, b, own: pairs.select(F.col(a).alias("system"), F.when(F.col("preferred") == own, 1.0).when(F.col("preferred") == 0, 0.5).otherwise(0.0).alias("p"))
    return side("first", "second", 1).unionByName(side("second", "first", 2)).groupBy("system").agg(F.sum("p").alias("points"))
