"""Passage quality: hard reasons to reject, soft reasons that cost points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T

MIN_CHARACTERS, MIN_SCORE = 48, 0.45
# Patterns of reference sections, entries and markers.
REFERENCE_SECTION = r"(?iU)\b(?:references|bibliography|works cited)\b|参考文献"
REFERENCE_ENTRY = r"(?i)^(?:\[\d{1,4}\]|\d{1,4}\.)\s+.{0,100}\b(?:19|20)\d{2}\b"
REFERENCE_MARKER = r"(?:^|\s)\[\d{1,4}\]\s+(?=[A-Z])"


def assessment(text: Column, section: Column, page: Column, minimum_characters: int = MIN_CHARACTERS, minimum_score: float = MIN_SCORE, tokens: Column | None = None) -> Column:
    """A struct (accepted, score, reasons); hard reasons come first. tokens: the text's, where they are known already."""
    if minimum_characters < 1 or not 0 <= minimum_score <= 1:
        raise ValueError("minimum_characters must be positive and minimum_score in 0..1")

    def judge(x: Column) -> Column:
        t, s, tokens = x["t"], x["s"], x["tokens"]
        n, cjk = F.length(t), F.regexp_count(t, F.lit(f"[{T.CJK}]"))
        ends = t.rlike(T.TERMINAL)
        readable = n - F.length(F.regexp_replace(t, r"[\p{L}\p{N}]", ""))
        hard = [
            ("too_short", n < minimum_characters), ("missing_page", x["page"].isNull()), ("reference_section", (s != "") & s.rlike(REFERENCE_SECTION)),
            ("reference_entry", F.substring(t, 1, 240).rlike(REFERENCE_ENTRY)), ("reference_list", F.regexp_count(t, F.lit(REFERENCE_MARKER)) >= 2),
            ("heading_only", (n < 120) & (F.size(tokens) < 14) & (cjk < 14) & ~ends), ("low_text_density", (n > 0) & (readable / n < F.lit(0.35)) & (cjk < 14)),
        ]
        soft = [
            ("missing_section", s == "", 0.05), ("running_header_section", (s != "") & s.rlike(r"^\d+:\d+\s+"), 0.15), ("short_passage", n < 160, 0.15),
            ("no_terminal_sentence", ~ends, 0.10), ("low_token_diversity", (F.size(F.array_distinct(tokens)) < 8) & (cjk < 14), 0.15),
        ]
        rejected = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in hard)))
        weak = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c, _ in soft)))
        score = F.lit(1.0)
        for _, c, cost in soft:
            score = score - F.when(c, F.lit(cost)).otherwise(F.lit(0.0))
        score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)
        return F.struct(((F.size(rejected) == 0) & (score >= minimum_score)).alias("accepted"), score.alias("score"), F.concat(rejected, weak).alias("reasons"))

    flat = T.normalized(text)
    packed = F.struct(flat.alias("t"), T.normalized(F.coalesce(section, F.lit(""))).alias("s"), page.alias("page"), (T.retrieval_tokens(flat) if tokens is None else tokens).alias("tokens"))
    return F.transform(F.array(packed), judge)[0]


def assessed(passages: DataFrame, text: str = "text", section: str = "section", page: str = "page_number") -> DataFrame:
    """passages with accepted, score and reasons."""
    return passages.withColumn("_q", assessment(F.col(text), F.col(section), F.col(page))).select(*passages.columns, F.col("_q.accepted").alias("accepted"), F.col("_q.score").alias("quality_score"), F.col("_q.reasons").alias("reasons"))
