"""Report sections: plan order, completion order, headings, grading, message routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_plan_order(plan: DataFrame, done: DataFrame) -> DataFrame:
    """(report_id, report): the contents of done(report_id, name, content) in the order of plan(report_id, name, position)."""
    rows = plan.join(done, ["report_id", "name"]).select("report_id", F.struct("position", "content").alias("x"))
    return rows.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["content"]), "\n\n").alias("report"))


def with_heading(name: Column, content: Column, mark: str = "## ") -> Column:
    """The content with its heading; one that is there already stays."""
    return F.when(F.startswith(F.ltrim(content), F.lit("#")), content).otherwise(F.concat(F.lit(mark), name, F.lit("\n\n"), content))


def assembled(parts: DataFrame) -> DataFrame:
    """(report_id, report): introduction, body sections in the order of completion, conclusion; parts(report_id, kind, seq, name, content)."""
    order = F.when(F.col("kind") == "introduction", 0).when(F.col("kind") == "conclusion", 2).otherwise(1)
    rows = parts.select("report_id", F.struct(order.alias("o"), "seq", with_heading(F.col("name"), F.col("content")).alias("c")).alias("x"))
    return rows.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]), "\n\n").alias("report"))


def graded(attempts: DataFrame, depth: int) -> DataFrame:
    """(section_id, attempt, outcome): the first passing attempt, else attempt number `depth` (exhausted), else the last so far (open)."""
    by = attempts.groupBy("section_id").agg(F.min(F.when(F.col("grade") == "pass", F.col("attempt"))).alias("p"), F.max("attempt").alias("m"))
    outcome = F.when(F.col("p").isNotNull() & (F.col("p") <= depth), "passed").when(F.col("m") >= depth, "exhausted").otherwise("open")
    return by.select("section_id", F.when(F.col("p") <= depth, F.col("p")).otherwise(F.least(F.col("m"), F.lit(depth))).alias("attempt"), outcome.alias("outcome"))


def joined_examples(runs: DataFrame, examples: DataFrame) -> DataFrame:
    """runs with the expected output of the example they were made for."""
    return runs.join(examples, "example_id")


def pending_cases(cases: DataFrame, runs: DataFrame, run_id: str) -> DataFrame:
    """Cases that a run has no record of yet."""
    return cases.join(runs.where(F.col("run_id") == run_id).select("case_id"), "case_id", "left_anti")


def live_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    """Tokens (created_at, expires_in seconds) that haven't run out."""
    return tokens.where(F.unix_seconds(now) < F.unix_seconds("created_at") + F.col("expires_in"))


def native_search(provider: Column, response: Column) -> Column:
    """Whether a response's metadata says that the provider searched by itself."""
    anthropic = F.get_json_object(response, "$.usage.server_tool_use.web_search_requests").cast("int") > 0
    open_ai = F.contains(response, F.lit('"web_search_call"'))
    return F.coalesce(F.when(provider == "anthropic", anthropic).when(provider == "openai", open_ai), F.lit(False))


def chain_violations(answers: DataFrame, claims: DataFrame, evidence: DataFrame, citations: DataFrame) -> DataFrame:
    """(rule, key): citations lead to claims and evidence of their answer, evidence has pages, counts agree, failed answers are empty."""
    from tessella.operators.validate import gathered

    hit = lambda rows, rule, key: rows.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    c = citations.select("query_id", "citation_id", "claim_id", "evidence_id")
    n = claims.groupBy("query_id").agg(F.count("*").alias("c"))
    counted = answers.join(n, "query_id", "left").where(F.col("n_claims") != F.coalesce("c", F.lit(0)))
    return gathered(
        hit(c.join(claims.select("query_id", "claim_id"), ["query_id", "claim_id"], "left_anti"), "citation_claim", "citation_id"), hit(c.join(evidence.select("query_id", "evidence_id"), ["query_id", "evidence_id"], "left_anti"), "citation_evidence", "citation_id"),
        hit(evidence.where("page_number is null"), "evidence_page", "evidence_id"), hit(counted, "claim_count", "query_id"), hit(answers.where("status = 'failed' and (report is not null or n_claims > 0)"), "failed_is_empty", "query_id"),
    )
