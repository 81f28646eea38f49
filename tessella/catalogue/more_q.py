"""Keyed reads, partitions, sections, cases, tokens, abstracts, ports, result chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.catalogue.base import Registry, read
from tessella.functions import text as T
from tessella.operators import ports, sections, tables

query = Registry()


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderkey % 7 = 0)")
def rows_by_id(spark, sf):
    wanted = read(spark, sf, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return tables.by_ids(read(spark, sf, "customer"), "c_custkey", wanted)[0].select("c_custkey", "c_name")


@query("select distinct o_custkey c_custkey from orders where o_custkey % 3 <> 0 and o_custkey not in (select c_custkey from customer where c_custkey % 5 <> 1)")
def missing_ids(spark, sf):
    wanted = read(spark, sf, "orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("c_custkey"))
    return tables.by_ids(read(spark, sf, "customer").where("c_custkey % 5 <> 1"), "c_custkey", wanted)[1]


@query("select doc_id, lang from documents where source = 'src3' order by doc_id")
def listed_rows(spark, sf):
    return tables.listed(read(spark, sf, "documents"), "doc_id", source="src3", lang=None).select("doc_id", "lang")


@query("select conv_id, turn from conversations where role = 'user'")
def owner_filter(spark, sf):
    return tables.owned(read(spark, sf, "conversations"), "user", "role").select("conv_id", "turn")


@query("select doc_id, case when lang <> 'en' then 'lang=' || lang || ';' else '' end || 'source=' || source meta from documents")
def metadata_projection(spark, sf):
    m = F.create_map(F.lit("lang"), F.when(F.col("lang") != "en", F.col("lang")), F.lit("source"), F.col("source"), F.lit("secret"), F.lit("x"))
    kept = F.array_sort(F.map_entries(tables.projected(m, ["source", "lang", "other"])))
    return read(spark, sf, "documents").select("doc_id", F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("meta"))


@query("""with w as (select doc_id from documents where doc_id % 10 <> 4), n as (select doc_id, count(*) n from (select doc_id from documents where doc_id % 2 = 0 union all select doc_id from documents where doc_id % 3 = 0) group by 1)
select doc_id, case when n is null then 'in_no_part' when w.doc_id is null then 'not_in_whole' else 'in_many_parts' end problem from w full outer join n using (doc_id) where n is null or w.doc_id is null or n > 1""")
def partition_equality(spark, sf):
    d = read(spark, sf, "documents").select("doc_id")
    return tables.partitions_agree(d.where("doc_id % 10 <> 4"), [d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0")], "doc_id")


@query("select conv_id report_id, string_agg(text, chr(10) || chr(10) order by turn desc) report from conversations where turn % 3 <> 1 group by 1")
def sections_in_plan_order(spark, sf):
    c = read(spark, sf, "conversations")
    plan = c.select(F.col("conv_id").alias("report_id"), F.col("turn").cast("string").alias("name"), (-F.col("turn")).alias("position"))
    done = c.where("turn % 3 <> 1").select(F.col("conv_id").alias("report_id"), F.col("turn").cast("string").alias("name"), F.col("text").alias("content"))
    return sections.in_plan_order(plan, done)


@query("""with p as (select conv_id report_id, case role when 'system' then 0 when 'assistant' then 2 else 1 end o, turn, case when turn % 2 = 0 then '# own' || turn else '## N' || turn || chr(10) || chr(10) || 'body' end c from conversations) select report_id, string_agg(c, chr(10) || chr(10) order by o, turn) report from p group by 1""")
def report_assembly(spark, sf):
    t = F.col("turn").cast("string")
    p = read(spark, sf, "conversations").select(F.col("conv_id").alias("report_id"), F.when(F.col("role") == "system", "introduction").when(F.col("role") == "assistant", "conclusion").otherwise("body").alias("kind"), F.col("turn").alias("seq"), F.concat(F.lit("N"), t).alias("name"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("# own"), t)).otherwise("body").alias("content"))
    return sections.assembled(p)


@query("""with g as (select user_id section_id, row_number() over (partition by user_id order by event_id) attempt, event_type from events), b as (select section_id, min(case when event_type = 'purchase' then attempt end) p, max(attempt) m from g group by 1)
select section_id, cast(case when p <= 3 then p else least(m, 3) end as bigint) attempt, case when p <= 3 then 'passed' when m >= 3 then 'exhausted' else 'open' end outcome from b""")
def section_grading(spark, sf):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint")
    a = read(spark, sf, "events").select(F.col("user_id").alias("section_id"), n.alias("attempt"), F.when(F.col("event_type") == "purchase", "pass").otherwise("fail").alias("grade"))
    return sections.graded(a, 3)


@query("select e.event_id, e.value, c.c_name expected from events e join customer c on c.c_custkey = e.user_id")
def runs_with_examples(spark, sf):
    runs = read(spark, sf, "events").select("event_id", "value", F.col("user_id").alias("example_id"))
    return sections.joined_examples(runs, read(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("example_id"), F.col("c_name").alias("expected"))).select("event_id", "value", "expected")


@query("select c_custkey case_id from customer where c_custkey not in (select user_id from events where event_type = 'click')")
def pending_cases(spark, sf):
    cases = read(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("case_id"))
    return sections.pending_cases(cases, read(spark, sf, "events").select(F.col("event_type").alias("run_id"), F.col("user_id").alias("case_id")), "click")


@query("select event_id from events where epoch_us(ts) // 1000000 + (event_id % 50) * 86400 > epoch_us(timestamp '2024-01-25 00:00:00') // 1000000")
def live_tokens(spark, sf):
    t = read(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("created_at"), ((F.col("event_id") % 50) * 86400).alias("expires_in"))
    return sections.live_tokens(t, F.to_timestamp(F.lit("2024-01-25 00:00:00"))).select("event_id")


@query("select event_id, (event_id % 2 = 0 and event_id % 3 > 0) or (event_id % 2 = 1 and event_id % 5 = 0) searched from events")
def native_search(spark, sf):
    i = F.col("event_id")
    r = F.when(i % 2 == 0, F.concat(F.lit('{"usage": {"server_tool_use": {"web_search_requests": '), (i % 3).cast("string"), F.lit("}}}"))).otherwise(F.when(i % 5 == 0, '{"output": [{"type": "web_search_call"}]}').otherwise("{}"))
    return read(spark, sf, "events").select("event_id", sections.native_search(F.when(i % 2 == 0, "anthropic").otherwise("openai"), r).alias("searched"))


@query(r"""with t as (select doc_id, 'Title' || chr(10) || 'Abstract: ' || regexp_replace(text, '[\s\x{A0}\x{85}\x{2028}\x{2029}\x{3000}\x0B]+', ' ', 'g') || chr(10) || 'Keywords: a, b' || chr(10) || '1 Introduction' x, trim(regexp_replace(text, '[\s\x{A0}\x{85}\x{2028}\x{2029}\x{3000}\x0B]+', ' ', 'g')) f from documents)
select doc_id, case when length(f) >= 80 then sha256(f) end abstract_sha256 from t""")
def abstracts(spark, sf):
    flat = F.regexp_replace("text", r"(?U)\s+", " ")
    t = F.concat(F.lit("Title\nAbstract: "), flat, F.lit("\nKeywords: a, b\n1 Introduction"))
    return read(spark, sf, "documents").select("doc_id", F.sha2(T.abstract(t), 256).alias("abstract_sha256"))


@query()
def first_sentences(spark, sf):
    """RE2 and Java differ in lazy matching over 700 characters; tested on a fixture."""
    return read(spark, sf, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("first_sentence"))


@query("select item_id query_id, cast(length(text) as double) / 100 length_score, cast(2 as int) dims from benchmark")
def provider_ports(spark, sf):
    """An embedding port and a reranking port with functions that SQL can follow."""
    b = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    v = ports.embedded(b, lambda texts: [[float(len(t)), 1.0] for t in texts], "query_id", dimension=2)
    pairs = b.select("query_id", F.lit(1).alias("doc_id"), F.lit("q").alias("query"), "text")
    s = ports.rerank_scores(pairs, lambda q, texts: [len(t) / 100 for t in texts])
    return v.join(s, "query_id").where("error is null").select("query_id", F.col("rerank_score").alias("length_score"), F.size("vector").alias("dims"))


@query("""with a as (select item_id q, case when item_id % 5 = 0 then 'failed' else 'success' end s, case when item_id % 10 = 0 then 'r' end r, item_id % 3 n from benchmark)
select 'claim_count' as rule, cast(q as varchar) as "key" from a where n <> case when q % 4 = 0 then 0 else q % 3 end union all select 'failed_is_empty', cast(q as varchar) from a where s = 'failed' and (r is not null or n > 0)
union all select 'citation_claim', 'x' || q from a where q % 4 = 0 or q % 3 = 0 union all select 'citation_evidence', 'x' || q from a where q % 6 = 0 union all select 'evidence_page', 'e' || q from a where q % 7 = 0 and q % 6 <> 0""")
def result_chain(spark, sf):
    i = F.col("item_id")
    s = lambda p: F.concat(F.lit(p), i.cast("string"))
    b = read(spark, sf, "benchmark")
    answers = b.select(i.alias("query_id"), F.when(i % 5 == 0, "failed").otherwise("success").alias("status"), F.when(i % 10 == 0, "r").alias("report"), (i % 3).alias("n_claims"))
    claims = b.where("item_id % 4 <> 0").select(i.alias("query_id"), F.explode(F.when(i % 3 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), (i % 3).cast("int")))).alias("k")).select("query_id", F.concat(F.lit("c"), F.col("k").cast("string")).alias("claim_id"))
    evidence = b.where("item_id % 6 <> 0").select(i.alias("query_id"), s("e").alias("evidence_id"), F.when(i % 7 != 0, 1).alias("page_number"))
    citations = b.select(i.alias("query_id"), s("x").alias("citation_id"), F.lit("c1").alias("claim_id"), s("e").alias("evidence_id"))
    return sections.chain_violations(answers, claims, evidence, citations)
