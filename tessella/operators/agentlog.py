"""Agent runs: tool evidence, status rules, event metrics, capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import ids

# Beginnings of placeholder contents, and of reports that could not be made.
ERROR_PREFIXES = ["error executing tool:", "error synthesizing research report:", "tool error:"]
FAILED_REPORT = "Error generating final report"


def valid_content(content: Column) -> Column:
    """Not blank, not a JSON object of the type tool_error that holds an error object, and without an error prefix."""
    low = F.lower(F.trim(content))
    bad = F.coalesce((F.get_json_object(content, "$.type") == "tool_error") & F.startswith(F.get_json_object(content, "$.error"), F.lit("{")), F.lit(False))
    for p in ERROR_PREFIXES:
        bad = bad | F.startswith(low, F.lit(p))
    return F.coalesce((F.length(low) > 0) & ~bad, F.lit(False))


def untampered(rows: DataFrame) -> DataFrame:
    """Rows (source, tool, call_id, content, content_hash, evidence_id, ordinal) whose digest and id are right, the first of each id."""
    digest = F.sha2(F.col("content"), 256)
    good = rows.where((digest == F.col("content_hash")) & (ids.tool_evidence_id(F.col("source"), F.col("tool"), F.col("call_id"), F.col("content_hash")) == F.col("evidence_id")))
    return good.withColumn("_n", F.row_number().over(Window.partitionBy("evidence_id").orderBy("ordinal"))).where("_n = 1").drop("_n")


def interim_status(evidence: Column, errors: Column) -> Column:
    """success with evidence and no error, partial with both, failed without evidence."""
    return F.when(evidence == 0, "failed").when(errors > 0, "partial").otherwise("success")


def final_status(notes: Column, evidence: Column, failures: Column) -> Column:
    return F.when((notes == 0) | (evidence == 0), "failed").when(failures > 0, "partial").otherwise("success")


def run_status(runtime_error: Column, structured: Column, report: Column) -> Column:
    """The status of a run record: a runtime error fails it; a structured status stands, but success needs a report; without one the report decides."""
    missing = (F.coalesce(report, F.lit("")) == "") | F.startswith(F.coalesce(report, F.lit("")), F.lit(FAILED_REPORT))
    stands = F.coalesce(structured.isin("partial", "failed"), F.lit(False))
    return F.when(F.coalesce(runtime_error, F.lit("")) != "", "failed").when(stands, structured).when(missing, "report_error").otherwise("success")


def capacity(units: DataFrame, most: int) -> DataFrame:
    """units(group_id, ordinal) with accepted: the first `most` of each group run, the rest is overflow."""
    return units.withColumn("accepted", F.row_number().over(Window.partitionBy("group_id").orderBy("ordinal")) <= most)


def durations(events: DataFrame) -> DataFrame:
    """(run_id, node, ms): starts and ends of a run paired by an aggregate, so order doesn't matter."""
    paired = events.groupBy("run_id", "node").agg(F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("a"), F.max(F.when(F.col("kind") == "end", F.col("ts"))).alias("b"))
    ms = (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 1000
    return paired.where("a is not null and b is not null and b >= a").select("run_id", "node", F.floor(ms).alias("ms"))


def run_metrics(events: DataFrame) -> DataFrame:
    """One row for each group: events, errors, and a map of counts by type."""
    by = events.groupBy("group_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return by.groupBy("group_id").agg(F.sum("n").alias("n_events"), F.sum(F.when(F.col("event_type") == "error", F.col("n")).otherwise(0)).alias("n_errors"), F.round(F.sum("value"), 2).alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n")))).alias("by_type"))


def reduced(state: DataFrame) -> DataFrame:
    """Fold updates (key, seq, op, items): appends after the last override, in order of seq."""
    last = Window.partitionBy("key")
    cut = state.withColumn("_from", F.max(F.when(F.col("op") == "override", F.col("seq"))).over(last)).where("_from is null or seq >= _from")
    return cut.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "items"))), lambda x: x["items"])).alias("items"))


def truncated(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role) before the last one of the assistant; conversations without one stay whole."""
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return messages.withColumn("_l", last).where("_l is null or turn < _l").drop("_l")


def allowed_tools(tools: DataFrame, allowed: DataFrame, taken: DataFrame) -> DataFrame:
    """Tools on the list whose names nothing else has taken."""
    return tools.join(allowed, "name", "left_semi").join(taken, "name", "left_anti")


def model_limit(names: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """names with token_limit: of the first key, in the list's order, that the name contains."""
    out = F.lit(None).cast("long")
    for key, limit in reversed(limits):
        out = F.when(F.contains(F.col("name"), F.lit(key)), limit).otherwise(out)
    return names.withColumn("token_limit", out)


def token_limit_exceeded(provider: Column, error_class: Column, message: Column, code: Column | None = None, kind: Column | None = None) -> Column:
    """Whether an error says that the model's context is too small; code and kind are those of structured errors."""
    structured = F.lit(False) if code is None or kind is None else (provider == "openai") & ((code == "context_length_exceeded") | (kind == "invalid_request_error"))
    low = F.lower(message)
    open_ai = (provider == "openai") & error_class.isin("BadRequestError", "InvalidRequestError") & low.rlike("token|context|length|maximum context|reduce")
    anthropic = (provider == "anthropic") & (error_class == "BadRequestError") & F.contains(low, F.lit("prompt is too long"))
    google = (provider == "google") & (error_class.isin("ResourceExhausted", "GoogleGenerativeAIFetchError"))
    return F.coalesce(open_ai, F.lit(False)) | F.coalesce(anthropic, F.lit(False)) | F.coalesce(google, F.lit(False)) | F.coalesce(structured, F.lit(False))
