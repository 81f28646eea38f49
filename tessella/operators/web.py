"""Web results: deduplication, ranks, snippets, source lists, connector shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_by_url(results: DataFrame, keep: str = "first") -> DataFrame:
    """One row for each url, the first or last by ordinal; it stands where the url came first (position)."""
    if keep not in ("first", "last"):
        raise ValueError("keep must be first or last")
    w = Window.partitionBy("url")
    n = F.row_number().over(w.orderBy(F.asc("ordinal") if keep == "first" else F.desc("ordinal")))
    return results.withColumn("position", F.min("ordinal").over(w)).withColumn("_n", n).where("_n = 1").drop("_n")


def rank_decay(results: DataFrame) -> DataFrame:
    """results(query_id, ordinal) with score 1 - i / (n + 1)."""
    w = Window.partitionBy("query_id")
    return results.withColumn("score", F.round(1 - (F.row_number().over(w.orderBy("ordinal")) - 1) / (F.count("*").over(w) + 1), 6))


def linear_decay(results: DataFrame, step: float = 0.1) -> DataFrame:
    """results(query_id, ordinal) with score 1 - step * i."""
    w = Window.partitionBy("query_id").orderBy("ordinal")
    return results.withColumn("score", F.round(1 - F.lit(step) * (F.row_number().over(w) - 1), 6))


def consecutive_groups(rows: DataFrame) -> DataFrame:
    """rows(ordinal, grp, stream) with island: neighbours with the same grp share one number within their stream."""
    w = Window.partitionBy("stream").orderBy("ordinal")
    start = F.when(F.lag("grp").over(w).eqNullSafe(F.col("grp")) & F.lag("ordinal").over(w).isNotNull(), 0).otherwise(1)
    return rows.withColumn("_s", start).withColumn("island", F.sum("_s").over(w)).drop("_s")


def stitched(snippets: DataFrame) -> DataFrame:
    """(url, stitched): the distinct snippets of a url in order, each between dots, with blank lines between."""
    first = snippets.groupBy("url", F.sha2("snippet", 256).alias("h")).agg(F.min("ordinal").alias("o"), F.first("snippet").alias("s"))
    return first.groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "s"))), lambda x: F.concat(F.lit("..."), x["s"], F.lit("..."))), "\n\n").alias("stitched"))


def capped(text: Column, tokens: int, characters_per_token: int = 4) -> Column:
    """The first tokens * 4 characters, with a mark where something was cut off."""
    n = tokens * characters_per_token
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("... [truncated]"))).otherwise(text)


def source_list(results: DataFrame) -> DataFrame:
    """(query_id, sources): numbered blocks of title, url and summary in order."""
    w = Window.partitionBy("query_id").orderBy("ordinal")
    rule = F.lit("\n\n\n\n" + "-" * 80 + "\n")
    block = F.concat(F.lit("\n\n--- SOURCE "), F.row_number().over(w).cast("string"), F.lit(": "), "title", F.lit(" ---\nURL: "), "url", F.lit("\n\nSUMMARY:\n"), "content", rule)
    rows = results.select("query_id", F.struct("ordinal", block.alias("b")).alias("x"))
    return rows.groupBy("query_id").agg(F.concat(F.lit("Search results: \n\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "")).alias("sources"))


def content_list(results: DataFrame, tokens: int = 1000, raw: bool = True) -> DataFrame:
    """(query_id, sources): ruled blocks of title, url, content and the capped raw content, in order."""
    thick, thin = "=" * 80 + "\n", "-" * 80 + "\n"
    parts = [F.lit(thick + "Source: "), F.col("title"), F.lit("\n" + thin + "URL: "), F.col("url"), F.lit("\n===\nMost relevant content from source: "), F.col("content"), F.lit("\n===\n")]
    if raw:
        parts += [F.lit(f"Full source content limited to {tokens} tokens: "), capped(F.coalesce("raw_content", F.lit("")), tokens), F.lit("\n\n")]
    rows = results.select("query_id", F.struct("ordinal", F.concat(*parts, F.lit(thick + "\n")).alias("b")).alias("x"))
    return rows.groupBy("query_id").agg(F.rtrim(F.trim(F.concat(F.lit("Content from sources:\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), ""))), F.lit("\n ")).alias("sources"))


def loopback(url: Column) -> Column:
    """Whether the host is this machine."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).isin("localhost", "127.0.0.1", "[::1]", "::1"), F.lit(False))


# ---- captured responses of search services, each brought to (query, ordinal, title, url, content, score, raw_content)

def cited_answer(rows: DataFrame) -> DataFrame:
    """rows(query, answer, citations): the first citation carries the answer (1.0), the others a note (0.5)."""
    r = rows.select("query", "answer", F.posexplode("citations").alias("ordinal", "url"))
    first = F.col("ordinal") == 0
    return r.select("query", "ordinal", F.concat(F.lit("Perplexity Search, Source "), (F.col("ordinal") + 1).cast("string")).alias("title"), "url", F.when(first, F.col("answer")).otherwise("See primary source for full content").alias("content"), F.when(first, 1.0).otherwise(0.5).alias("score"), F.when(first, F.col("answer")).alias("raw_content"))


def pages_with_subpages(rows: DataFrame) -> DataFrame:
    """rows(query, is_subpage, pos, title, url, summary, text, score): one row for each url of a query, main pages first; summary, blank line, text."""
    w = Window.partitionBy("query", "url").orderBy("is_subpage", "pos")
    kept = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    content = F.array_join(F.array_compact(F.array(F.nullif("summary", F.lit("")), F.nullif("text", F.lit("")))), "\n\n")
    order = F.row_number().over(Window.partitionBy("query").orderBy("is_subpage", "pos")) - 1
    return kept.select("query", order.alias("ordinal"), "title", "url", content.alias("content"), "score", F.col("text").alias("raw_content"))


def labelled_lines(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """rows(query, ordinal, title, url, ...): content of `label: value` lines for the fields that are there, decayed score."""
    lines = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for c, label in fields.items()]
    made = rows.select(F.col("query").alias("query_id"), "ordinal", "title", "url", F.array_join(F.array_compact(F.array(*lines)), "\n").alias("content"))
    return rank_decay(made).withColumn("raw_content", F.col("content")).withColumnRenamed("query_id", "query")


def first_links(rows: DataFrame, most: int) -> DataFrame:
    """rows(query, page, pos, url, title, snippet): each link once, the first `most` of a query; binary files get a note."""
    w = Window.partitionBy("query", "url").orderBy("page", "pos")
    kept = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    order = F.row_number().over(Window.partitionBy("query").orderBy("page", "pos"))
    binary = F.lower("url").rlike(r"\.(pdf|zip|png|jpe?g|docx?|xlsx?|pptx?)$")
    return kept.withColumn("ordinal", order - 1).where(F.col("ordinal") < most).select("query", "ordinal", "title", "url", F.when(binary, "[Binary content not shown]").otherwise(F.col("snippet")).alias("content"), F.lit(1.0).alias("score"))


def renamed_scores(rows: DataFrame, **names: str) -> DataFrame:
    """Rename a service's fields; score is its reranker's."""
    return rows.select(*(F.col(old).alias(new) for new, old in names.items()))


def summarized(rows: DataFrame) -> DataFrame:
    """rows(url, content, raw_content, summary): the summary where there is one, else the content; rows without raw content keep it."""
    return rows.withColumn("content", F.when(F.col("raw_content").isNull(), F.col("content")).otherwise(F.coalesce("summary", "content")))
