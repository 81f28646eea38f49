"""Claims and verdicts, labels, reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.catalogue.base import Registry, read, read_spread
from tessella.functions import text as T
from tessella.operators import evaluate, research, review, verify

query = Registry()

STOP = "['" + "','".join(T.VERIFIER_STOPWORDS) + "']"
NEG = r"(?i)\b(?:no|not|never|neither|without|failed?|cannot|can''t|didn''t|doesn''t|isn''t|wasn''t|weren''t)\b|(?:不|未|无|没有|并非|不能|失败)"


def toks(x: str) -> str:
    return rf"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z]+(?:[-''][a-z]+)*|\p{{Nd}}+(?:\.\p{{Nd}}+)?%?|[一-鿿]')), lambda w: not list_contains({STOP}, w))"


def flat(x: str) -> str:
    return rf"replace(lower(trim(regexp_replace({x}, '[\s\x{{A0}}\x{{85}}\x{{2028}}\x{{2029}}\x{{3000}}\x0B]+', ' ', 'g'))), 'ß', 'ss')"


WS = r"[\s\x{A0}\x{85}\x{2028}\x{2029}\x{3000}\x0B]"


def pieces(x: str) -> str:
    """The sentences of a text, those of white space left out."""
    return rf"list_filter(string_split(regexp_replace({x}, '([.!?。！？]){WS}+', '\1' || chr(31), 'g'), chr(31)), lambda s: trim(regexp_replace(s, '{WS}+', ' ', 'g')) <> '')"


def numbers(x: str) -> str:
    """The numbers of a text without looking around: each maximal run of word characters and full stops that is a number, with what stands before and after it.

    A sign counts if two characters other than these stand before the run, so the text gets two blanks before it and one
    behind each percent sign.
    """
    word, figure = r"[\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}.]", r"[^\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}.]*\p{Nd}+(?:\.\p{Nd}+)?%?"
    other = "[^" + word[1:]
    found = f"regexp_extract_all('  ' || replace({x}, '%', '% '), '{other}{{0,2}}{word}+%?')"
    return rf"list_distinct(list_transform(list_filter({found}, lambda m: regexp_full_match(m, '{figure}')), lambda m: regexp_extract(m, '(?:^{other}([-+]))?(\p{{Nd}}.*)$', 1) || regexp_extract(m, '\p{{Nd}}.*$')))"


#: Claims are first sentences of documents, some of them changed; their links are the document and the next, in whole texts.
CLAIMS = rf"""ev as (select 'e' || doc_id evidence_id, doc_id, text from documents), fs as (select doc_id i, coalesce({pieces("text")}[1], text, '') s from documents), nx as (select doc_id n from documents),
cl as (select 'c' || i claim_id, i doc_id, case i % 5 when 0 then 'not ' || s when 1 then s || ' 42% more' when 2 then s || ' wholly invented words follow here' else s end text,
 case when i % 17 = 0 then [] when i % 19 = 0 then ['e' || i, 'none'] when n is null then ['e' || i] else ['e' || i, 'e' || n] end evidence_ids from fs left join nx on n = i + 1)"""

VERDICTS = CLAIMS + rf""", lk as (select claim_id, unnest(evidence_ids) evidence_id, generate_subscripts(evidence_ids, 1) ln from cl), fo as (select lk.*, ev.text et from lk left join ev using (evidence_id)),
es as (select evidence_id, unnest(p) span, generate_subscripts(p, 1) sn from (select evidence_id, {pieces("text")} p from ev)), et as (select *, {toks("span")} stk, {flat("span")} fspan from es),
ct as (select claim_id, text, {toks("text")} tk, {flat("text")} ft from cl),
sc as (select claim_id, ln, evidence_id, span, sn, case when len(tk) > 0 then len(list_intersect(tk, stk)) / len(tk) else 0 end cov, length(ft) > 0 and contains(fspan, ft) ext from fo join et using (evidence_id) join ct using (claim_id)),
best as (select * from sc qualify row_number() over (partition by claim_id order by ext desc, cov desc, length(span), ln, sn) = 1),
en as (select evidence_id, {numbers("text")} nums from ev), nm as (select claim_id, count(*) filter (et is null) missing, coalesce(list_distinct(flatten(list(nums))), []) nums from fo left join en using (evidence_id) group by 1),
v as (select cl.claim_id, cl.text, coalesce(missing = 0, false) linked, coalesce(len(list_filter({numbers("cl.text")}, lambda x: not list_contains(nums, x))) > 0, false) extra, len(nums) > 0 some_number, coalesce(cov, 0) cov, coalesce(ext, false) ext, coalesce(span, '') span, b.evidence_id from cl left join nm using (claim_id) left join best b using (claim_id))"""


def claims(spark, sf):
    """The first whole sentence of every document, some changed, linked to its document and the next; evidence is whole texts."""
    d, i = read_spread(spark, sf, "documents", "doc_id").select("doc_id", "text"), F.col("doc_id")
    e = lambda x: F.concat(F.lit("e"), x.cast("string"))
    first = F.coalesce(F.get(T.sentences(F.col("text")), F.lit(0)), "text", F.lit(""))
    text = F.when(i % 5 == 0, F.concat(F.lit("not "), first)).when(i % 5 == 1, F.concat(first, F.lit(" 42% more"))).when(i % 5 == 2, F.concat(first, F.lit(" wholly invented words follow here"))).otherwise(first)
    after = d.select((i - 1).alias("doc_id"), e(i).alias("after")).dropDuplicates(["doc_id"])
    links = F.when(i % 17 == 0, F.array().cast("array<string>")).when(i % 19 == 0, F.array(e(i), F.lit("none"))).otherwise(F.array_compact(F.array(e(i), F.col("after"))))
    c = d.join(after, "doc_id", "left").select(F.concat(F.lit("c"), i.cast("string")).alias("claim_id"), text.alias("text"), links.alias("evidence_ids"), "doc_id")
    return c, d.select(e(i).alias("evidence_id"), "text", "doc_id")


@query(rf"""with {VERDICTS} select claim_id, case when not linked then 0 else round(cov, 6) end coverage, case when linked then evidence_id end evidence_id from v""")
def claim_spans(spark, sf):
    return verify.verdicts(*claims(spark, sf)).select("claim_id", "coverage", "evidence_id")


STATUS = rf"""case when not linked then 'insufficient' when extra then case when some_number then 'contradicted' else 'insufficient' end when cov >= 0.45 and regexp_matches(text, '{NEG}') <> regexp_matches(span, '{NEG}') then 'contradicted' when cov >= 0.8 and ext then 'supported' when cov >= 0.45 then 'partial' else 'insufficient' end"""


@query(f"with {VERDICTS} select claim_id, {STATUS} status from v")
def claim_verdicts(spark, sf):
    return verify.verdicts(*claims(spark, sf)).select("claim_id", "status")


@query(f"with {VERDICTS}, w as (select *, {STATUS} status from v) select claim_id, status, case when linked then round(cov, 6) else 0 end coverage, case when linked then evidence_id end evidence_id, linked and not extra and status <> 'contradicted' hard_gate_passed from w")
def claim_gates(spark, sf):
    return verify.verdicts(*claims(spark, sf))


@query("""with b as (select item_id, case item_id % 4 when 0 then 'partial' when 1 then 'insufficient' when 2 then 'supported' else 'contradicted' end status, item_id % 4 <> 3 gate, case when item_id % 3 = 0 then 'supported' when item_id % 3 = 1 then 'bogus' end label, (item_id % 10) / 10.0::double conf from benchmark)
select item_id claim_id, case when gate and status <> 'supported' and label = 'supported' and conf >= 0.75 then 'supported' else status end status, case when gate and status <> 'supported' and label = 'supported' and conf >= 0.75 then 'semantic' else 'deterministic' end method from b""")
def semantic_verdicts(spark, sf):
    b, i = read(spark, sf, "benchmark"), F.col("item_id")
    base = b.select(i.alias("claim_id"), F.when(i % 4 == 0, "partial").when(i % 4 == 1, "insufficient").when(i % 4 == 2, "supported").otherwise("contradicted").alias("status"), (i % 4 != 3).alias("hard_gate_passed"))
    sem = b.where(i % 3 != 2).select(i.alias("claim_id"), F.when(i % 3 == 0, "supported").otherwise("bogus").alias("label"), ((i % 10) / F.lit(10.0)).alias("confidence"))
    return verify.with_semantics(base, sem).select("claim_id", "status", "method")


@query()
def claim_drafts(spark, sf):
    hits = read_spread(spark, sf, "documents", "doc_id").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").cast("string").alias("evidence_id"), F.col("doc_id").alias("rank"), "text")
    return research.drafts(hits, read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query("""with h as (select doc_id % 40 query_id, doc_id % 90 evidence_id, doc_id as "rank", case when doc_id % 3 = 0 then null else 1 end page_number from documents) select query_id, evidence_id, min("rank") as "rank" from h where page_number is not null group by all""")
def page_located(spark, sf):
    d, i = read(spark, sf, "documents"), F.col("doc_id")
    return research.located(d.select((i % 40).alias("query_id"), (i % 90).alias("evidence_id"), i.alias("rank"), F.when(i % 3 != 0, 1).alias("page_number"))).select("query_id", "evidence_id", "rank")


@query("""with c as (select doc_id % 40 query_id, doc_id draft_no, 'c' || doc_id claim_id, source claim_text, case when doc_id % 3 = 0 then 'supported' else 'partial' end status, 'e' || doc_id evidence_id, 1 + doc_id % 4 p, case when doc_id % 2 = 0 then 3 + doc_id % 4 end pe from documents),
l as (select *, '[' || source_t || case when pe is not null and pe <> p then ', pp. ' || p || '-' || pe else ', p. ' || p end || ']' lab from (select *, 'T' || draft_no % 7 source_t from c))
select query_id, string_agg('- ' || claim_text || ' ' || lab, chr(10) order by draft_no) report from l where status = 'supported' group by 1""")
def claim_report(spark, sf):
    d, i = read(spark, sf, "documents"), F.col("doc_id")
    c = d.select((i % 40).alias("query_id"), i.alias("draft_no"), F.concat(F.lit("c"), i.cast("string")).alias("claim_id"), F.col("source").alias("claim_text"), F.when(i % 3 == 0, "supported").otherwise("partial").alias("status"), F.concat(F.lit("e"), i.cast("string")).alias("evidence_id"))
    e = d.select(F.concat(F.lit("e"), i.cast("string")).alias("evidence_id"), F.concat(F.lit("T"), (i % 7).cast("string")).alias("title"), (1 + i % 4).cast("int").alias("page_number"), F.when(i % 2 == 0, 3 + i % 4).cast("int").alias("page_end"))
    return research.reports(c, research.citations(c.select("claim_id", "evidence_id", "status"), e))


@query("""with c as (select doc_id % 45 query_id, count(*) n, count(*) filter (doc_id % 9 < 5 and doc_id % 45 <> 7) p from documents group by 1), q as (select item_id query_id from benchmark)
select query_id, coalesce(n, 0) n_claims, coalesce(p, 0) n_published, case when coalesce(p, 0) = 0 then 'failed' when p = n then 'success' else 'partial' end status from q left join c using (query_id)""")
def research_outcomes(spark, sf):
    d, i = read(spark, sf, "documents"), F.col("doc_id")
    c = d.select((i % 45).alias("query_id"), F.when((i % 9 < 5) & (i % 45 != 7), "supported").otherwise("partial").alias("status"))
    return research.outcomes(read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")), c)


LAB = """lab as (select doc_id, case when toxic = 1 then 'true' else 'false' end citation_present, case when doc_id % 3 = 0 then 'true' else 'false' end source_exists, case when quality = 1 then 'supported' else 'unsupported' end citation_support, case when doc_id % 4 = 0 then '' when doc_id % 4 = 1 then 'true' else 'false' end factual_correct,
 case when doc_id % 5 < 2 then 'true' when doc_id % 5 = 2 then '' else 'false' end temporal_correct, case when quality = 1 then 'true' else 'false' end numeric_correct, case when doc_id % 2 = 0 then 'true' else '' end scope_complete, case doc_id % 3 when 0 then 'numeric|scope' when 1 then 'temporal' else '' end error_types from labels)"""


def label_rows(spark, sf):
    i, w = F.col("doc_id"), lambda c: F.when(c, "true").otherwise("false")
    return read(spark, sf, "labels").select(
        w(F.col("toxic") == 1).alias("citation_present"), w(i % 3 == 0).alias("source_exists"), F.when(F.col("quality") == 1, "supported").otherwise("unsupported").alias("citation_support"), F.when(i % 4 == 0, "").when(i % 4 == 1, "true").otherwise("false").alias("factual_correct"),
        F.when(i % 5 < 2, "true").when(i % 5 == 2, "").otherwise("false").alias("temporal_correct"), w(F.col("quality") == 1).alias("numeric_correct"), F.when(i % 2 == 0, "true").otherwise("").alias("scope_complete"), F.when(i % 3 == 0, "numeric|scope").when(i % 3 == 1, "temporal").otherwise("").alias("error_types"),
    )


def pct(a: str, b: str) -> str:
    return f"coalesce(round(100.0::double * count(*) filter ({a}) / nullif(count(*) filter ({b}), 0), 2), 0)"


@query(f"""with {LAB} select count(*) n_claims, {pct("citation_present = 'true' and citation_support = 'supported'", "citation_present = 'true'")} citation_precision, {pct("citation_present = 'true'", "true")} citation_coverage, {pct("citation_present = 'true' and source_exists = 'true'", "citation_present = 'true'")} source_validity,
 {", ".join(pct(f"{c} = 'true'", "true") + " " + c for c in ("factual_correct", "scope_complete"))}, {", ".join(pct(f"{c} = 'true'", f"{c} in ('true', 'false')") + " " + c for c in ("temporal_correct", "numeric_correct"))} from lab""")
def label_metrics(spark, sf):
    return evaluate.label_metrics(label_rows(spark, sf))


@query(f"with {LAB}, e as (select unnest(string_split(error_types, '|')) error_type from lab) select error_type, count(*) n from e where error_type <> '' group by 1")
def error_histogram(spark, sf):
    return evaluate.error_histogram(label_rows(spark, sf))


CONF = "cf as (select case quality when 1 then 'supported' else 'partial' end expected, case when doc_id % 7 = 0 then 'partial' when toxic = 1 then 'contradicted' else 'supported' end predicted from labels)"


def pairs(spark, sf):
    return read(spark, sf, "labels").select(F.when(F.col("quality") == 1, "supported").otherwise("partial").alias("expected"), F.when(F.col("doc_id") % 7 == 0, "partial").when(F.col("toxic") == 1, "contradicted").otherwise("supported").alias("predicted"))


@query(f"with {CONF} select expected, count(*) filter (predicted = 'supported') supported, count(*) filter (predicted = 'partial') partial, count(*) filter (predicted = 'contradicted') contradicted from cf group by 1")
def confusion(spark, sf):
    return evaluate.confusion(pairs(spark, sf), ["supported", "partial", "contradicted"])


@query(f"with {CONF} select count(*) n, round(avg(case when expected = predicted then 1.0::double else 0 end), 6) accuracy, round(count(*) filter (expected = 'supported' and predicted = 'supported') / count(*) filter (predicted = 'supported'), 6) as precision, round(count(*) filter (expected = 'supported' and predicted = 'supported') / count(*) filter (expected = 'supported'), 6) recall from cf".replace("as precision", 'as "precision"'))
def publication_metrics(spark, sf):
    return evaluate.publication(pairs(spark, sf))


@query("""with q as (select item_id question_id, case when item_id % 2 = 0 then 'abstract' else 'method' end question_type from benchmark), r as (select *, row_number() over (partition by question_type order by question_id) r from q)
select question_id, cast(case when question_type = 'abstract' then case when r <= 2 then 1 when r <= 7 then 2 when r <= 13 then 3 when r <= 19 then 4 end else case when r <= 3 then 1 when r <= 10 then 2 when r <= 17 then 3 when r <= 23 then 4 end end as int) batch_no from r""")
def silver_batches(spark, sf):
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.when(F.col("item_id") % 2 == 0, "abstract").otherwise("method").alias("question_type"))
    return evaluate.batches(q, {"abstract": [2, 5, 6, 6], "method": [3, 7, 7, 6]}).select("question_id", "batch_no")


@query("select lang as \"key\", round(avg((1 + doc_id % 5) / 5.0::double), 6) mean from documents group by 1")
def ratings(spark, sf):
    return evaluate.ratings(read(spark, sf, "documents").select(F.col("lang").alias("key"), (1 + F.col("doc_id") % 5).alias("score")))


@query("select count(*) filter (toxic = 0) grounded, count(*) total, round(count(*) filter (toxic = 0) / count(*), 6) share from labels")
def groundedness(spark, sf):
    return evaluate.groundedness(read(spark, sf, "labels").select((F.col("toxic") == 0).alias("grounded")))


@query("""with p as (select 's' || doc_id % 4 a, 's' || (doc_id + 1) % 4 b, doc_id % 3 w from documents), s as (select a system, case when w = 1 then 1.0 when w = 0 then 0.5 else 0 end p from p union all select b, case when w = 2 then 1.0 when w = 0 then 0.5 else 0 end from p) select system, cast(sum(p) as double) points from s group by 1""")
def preference_points(spark, sf):
    i = F.col("doc_id")
    s = lambda x: F.concat(F.lit("s"), x.cast("string"))
    return evaluate.preference_points(read(spark, sf, "documents").select(s(i % 4).alias("first"), s((i + 1) % 4).alias("second"), (i % 3).alias("preferred")))


def reviews(spark, sf):
    i = F.col("item_id")
    blank = F.lit("")
    edit = i % 3 == 1
    return read(spark, sf, "benchmark").select(
        i.cast("string").alias("question_id"), F.when(i % 3 == 0, "keep").when(edit, "edit").otherwise("reject").alias("decision"), F.when(i % 3 == 0, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False))).alias("checks"),
        F.when((i % 3 == 0) & (i % 5 != 0), F.array().cast("array<string>")).otherwise(F.array(F.lit("WRONG_PAGE"))).alias("issues"), F.when(i % 4 == 3, "").otherwise("seen").alias("notes"),
        F.struct(F.when(edit, "q").otherwise(blank).alias("question"), F.when(edit & (i % 2 == 0), "a").otherwise(blank).alias("answer")).alias("revision"),
        F.lit("2024-01-01T10:00:00Z").alias("round1_at"), F.when(i % 7 == 0, "2024-01-01T20:00:00Z").otherwise("2024-01-02T10:00:00Z").alias("round2_at"), F.lit("r1").alias("reviewer1"), F.lit("r1").alias("reviewer2"), F.lit("single").alias("mode"),
        F.when(i % 3 == 0, "keep").when(edit, "edit").otherwise("reject").alias("decision2"), F.lit("not_required").alias("resolution"), blank.alias("rationale"), F.when(i % 3 == 0, "silver").when(edit, "final_revision").otherwise("none").alias("final_source"),
    )


REV = """rv as (select item_id, array_to_string(list_filter([case when item_id % 3 = 0 and item_id % 5 = 0 then 'keep_is_clean' end, case when item_id % 3 = 1 and item_id % 2 <> 0 then 'edit_is_complete' end, case when item_id % 3 = 2 and item_id % 4 = 3 then 'reject_is_reasoned' end, case when item_id % 7 = 0 then 'single_reviewer_gap' end], lambda x: x is not null), ',') errors,
 case item_id % 3 when 0 then 'keep' when 1 then 'edit' else 'reject' end decision from benchmark)"""


@query(f"with {REV} select cast(item_id as varchar) question_id, errors from rv")
def review_errors(spark, sf):
    return review.review_errors(reviews(spark, sf)).select("question_id", F.array_join("errors", ",").alias("errors"))


@query(f"""with {REV} select 'gold-' || substr(sha256(encode('v1') || unhex('00') || encode(cast(item_id as varchar))), 1, 16) gold_id, cast(item_id as varchar) question_id, case when decision = 'edit' then 'q' else 'Q' || item_id end question, case when decision = 'edit' then 'a' else 'A' end answer, decision from rv where errors = '' and decision <> 'reject'""")
def gold_release(spark, sf):
    q = read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), F.concat(F.lit("Q"), F.col("item_id").cast("string")).alias("question"), F.lit("A").alias("answer"))
    return review.gold(reviews(spark, sf), q, "v1")


@query(f"with {REV} select decision, count(*) n from rv group by 1")
def review_counts(spark, sf):
    return review.decision_counts(reviews(spark, sf))
