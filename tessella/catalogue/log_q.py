"""Runs, events, messages and web results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.catalogue.base import Registry, read, read_spread
from tessella.functions import ids
from tessella.functions import text as T
from tessella.operators import agentlog, evaluate, web

query = Registry()


@query("select user_id case_id, value, event_id from events qualify row_number() over (partition by user_id order by event_id % 5 desc, event_id desc) = 1")
def latest_attempt(spark, sf):
    r = read(spark, sf, "events").select(F.col("user_id").alias("case_id"), (F.col("event_id") % 5).alias("attempt"), F.col("event_id").alias("ordinal"), "value")
    return evaluate.latest_attempts(r).select("case_id", "value", F.col("ordinal").alias("event_id"))


@query("with m as (select user_id case_id, max(event_id % 5) m from events group by 1), c as (select c_custkey case_id from customer) select case_id, coalesce(m, 0) + 1 next_attempt from c left join m using (case_id)")
def next_attempt(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("case_id"))
    return evaluate.next_attempts(c, read(spark, sf, "events").select(F.col("user_id").alias("case_id"), (F.col("event_id") % 5).alias("attempt")))


@query("""with b as (select user_id group_id, event_type, count(*) n, round(sum(value), 4) v from events group by all) select group_id, cast(sum(n) as bigint) n_events, cast(sum(case when event_type = 'error' then n else 0 end) as bigint) n_errors, round(sum(v), 2) total, string_agg(event_type || '=' || n, ',' order by event_type) by_type from b group by 1""")
def run_metrics(spark, sf):
    m = agentlog.run_metrics(read(spark, sf, "events").select(F.col("user_id").alias("group_id"), "event_type", "value"))
    return m.withColumn("by_type", F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


EVP = "ep as (select event_id // 2 run_id, event_type node, case when event_id % 2 = 0 then 'start' else 'end' end kind, ts from (select *, first_value(event_type) over (partition by event_id // 2 order by event_id) event_type from events) x)"


@query("""with p as (select event_id // 2 run_id, event_id % 2 k, ts from events), d as (select run_id, min(case when k = 0 then ts end) a, max(case when k = 1 then ts end) b from p group by 1) select run_id, cast(floor((epoch_us(b) - epoch_us(a)) / 1000.0) as bigint) ms from d where a is not null and b >= a""")
def node_durations(spark, sf):
    e = read(spark, sf, "events").select(F.floor(F.col("event_id") / 2).alias("run_id"), F.lit("n").alias("node"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("kind"), "ts")
    return agentlog.durations(e).select("run_id", "ms")


@query("""with c as (select conv_id, turn, case turn % 4 when 0 then '{"type": "tool_error", "error": {"m": 1}}' when 1 then 'Tool Error: ' || text when 2 then '  ' else text end content from conversations)
select conv_id, turn, length(trim(content)) > 0 and not (starts_with(content, '{') and json_extract_string(case when json_valid(content) then content end, '$.type') is not distinct from 'tool_error') and not regexp_matches(lower(trim(content)), '^(error executing tool:|error synthesizing research report:|tool error:)') valid from c""")
def tool_content_valid(spark, sf):
    t = F.col("turn") % 4
    content = F.when(t == 0, '{"type": "tool_error", "error": {"m": 1}}').when(t == 1, F.concat(F.lit("Tool Error: "), "text")).when(t == 2, "  ").otherwise(F.col("text"))
    return read(spark, sf, "conversations").select("conv_id", "turn", agentlog.valid_content(content).alias("valid"))


@query("""with r as (select conv_id, turn, text, conv_id * 100000 + turn o, case when turn % 5 = 0 then sha256('x') else sha256(text) end h from conversations),
i as (select *, sha256(encode('chat') || unhex('00') || encode(cast(conv_id % 9 as varchar)) || unhex('00') || encode('c') || unhex('00') || encode(h)) id from r)
select id evidence_id, min(o) first_ordinal from i where h = sha256(text) group by 1""")
def tool_evidence_valid(spark, sf):
    o = read(spark, sf, "conversations").withColumn("ordinal", F.col("conv_id") * 100000 + F.col("turn"))
    h = F.when(F.col("turn") % 5 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("text", 256))
    r = o.select(F.lit("chat").alias("source"), (F.col("conv_id") % 9).cast("string").alias("tool"), F.lit("c").alias("call_id"), F.col("text").alias("content"), h.alias("content_hash"), "ordinal")
    r = r.withColumn("evidence_id", ids.tool_evidence_id(F.col("source"), F.col("tool"), F.col("call_id"), F.col("content_hash")))
    return agentlog.untampered(r).select("evidence_id", F.col("ordinal").alias("first_ordinal"))


@query("""with c as (select conv_id, count(*) filter (role = 'assistant') e, count(*) filter (turn % 3 = 2) x, count(*) filter (role = 'user') n from conversations group by 1)
select conv_id, case when e = 0 then 'failed' when x > 0 then 'partial' else 'success' end interim, case when n = 0 or e = 0 then 'failed' when x > 0 then 'partial' else 'success' end final, case when conv_id % 7 = 0 then 'failed' when conv_id % 3 = 0 then 'partial' when conv_id % 5 = 0 then 'report_error' else 'success' end run from c""")
def research_status(spark, sf):
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("e"), F.count_if(F.col("turn") % 3 == 2).alias("x"), F.count_if(F.col("role") == "user").alias("n"))
    i = F.col("conv_id")
    run = agentlog.run_status(F.when(i % 7 == 0, "boom"), F.when(i % 3 == 0, "partial").otherwise("success"), F.when(i % 10 == 0, "").when(i % 5 == 0, "Error generating final report: x").otherwise("report"))
    return c.select("conv_id", agentlog.interim_status(F.col("e"), F.col("x")).alias("interim"), agentlog.final_status(F.col("n"), F.col("e"), F.col("x")).alias("final"), run.alias("run"))


@query("select user_id, event_id, row_number() over (partition by user_id order by event_id) <= 5 accepted from events")
def concurrency_overflow(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("group_id"), F.col("event_id").alias("ordinal"))
    return agentlog.capacity(e, 5).select(F.col("group_id").alias("user_id"), F.col("ordinal").alias("event_id"), "accepted")


@query("""with s as (select conv_id, turn, case when turn % 5 = 3 then 'override' else 'append' end op, role from conversations), l as (select *, max(case when op = 'override' then turn end) over (partition by conv_id) f from s)
select conv_id, string_agg(role, ',' order by turn) items from l where f is null or turn >= f group by 1""")
def state_reducer(spark, sf):
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.when(F.col("turn") % 5 == 3, "override").otherwise("append").alias("op"), F.array("role").alias("items"))
    return agentlog.reduced(c).select(F.col("key").alias("conv_id"), F.array_join("items", ",").alias("items"))


@query("with l as (select *, max(case when role = 'assistant' then turn end) over (partition by conv_id) l from conversations) select conv_id, turn from l where l is null or turn < l")
def history_truncation(spark, sf):
    return agentlog.truncated(read(spark, sf, "conversations")).select("conv_id", "turn")


@query("with t as (select p_partkey, p_name from part) select p_partkey, p_name from t where p_partkey % 3 = 0 and p_partkey not in (select ps from (select l_partkey ps from lineitem where l_quantity > 45))")
def tool_allow_list(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_name", F.col("p_partkey").alias("name"))
    taken = read(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("name")).distinct()
    return agentlog.allowed_tools(p, p.where("p_partkey % 3 = 0").select("name"), taken).select("p_partkey", "p_name")


@query("with n as (select doc_id, lang || ':' || source || '-mini' as name from documents) select doc_id, case when contains(name, 'en:src1') then 1000 when contains(name, 'src1') then 500 when contains(name, 'mini') and contains(name, 'de:') then 100 when contains(name, 'fr') then 200 end token_limit from n")
def model_limits(spark, sf):
    n = read(spark, sf, "documents").select("doc_id", F.concat("lang", F.lit(":"), "source", F.lit("-mini")).alias("name"))
    return agentlog.model_limit(n, [("en:src1", 1000), ("src1", 500), ("de:", 100), ("fr", 200)]).select("doc_id", F.col("token_limit").cast("int").alias("token_limit"))


@query("""with e as (select event_id, case event_id % 3 when 0 then 'openai' when 1 then 'anthropic' else 'google' end p, case event_id % 4 when 0 then 'BadRequestError' when 1 then 'ResourceExhausted' else 'Other' end c, case when event_id % 5 < 3 then 'Prompt is too long for the context' else 'rate' end m from events)
select event_id, (p = 'openai' and c = 'BadRequestError' and regexp_matches(lower(m), 'token|context|length|reduce')) or (p = 'anthropic' and c = 'BadRequestError' and contains(lower(m), 'prompt is too long')) or (p = 'google' and c = 'ResourceExhausted') exceeded from e""")
def token_limit_errors(spark, sf):
    i = F.col("event_id")
    p = F.when(i % 3 == 0, "openai").when(i % 3 == 1, "anthropic").otherwise("google")
    c = F.when(i % 4 == 0, "BadRequestError").when(i % 4 == 1, "ResourceExhausted").otherwise("Other")
    return read(spark, sf, "events").select("event_id", agentlog.token_limit_exceeded(p, c, F.when(i % 5 < 3, "Prompt is too long for the context").otherwise("rate")).alias("exceeded"))


# ---- web

RES = "rs as (select page_id ordinal, page_id % 20 query_id, regexp_replace(url, '[?#].*$', '') url, regexp_extract(url, '://([^/]+)', 1) host, html from pages)"


def results(spark, sf):
    return read(spark, sf, "pages").select(F.col("page_id").alias("ordinal"), (F.col("page_id") % 20).alias("query_id"), F.regexp_replace("url", "[?#].*$", "").alias("url"), F.regexp_extract("url", "://([^/]+)", 1).alias("host"), "html")


@query(f"with {RES} select host url, min(ordinal) ordinal from rs group by 1")
def url_dedup_first(spark, sf):
    return web.dedup_by_url(results(spark, sf).select("ordinal", F.col("host").alias("url"))).select("url", "ordinal")


@query(f'with {RES} select host url, max(ordinal) ordinal, min(ordinal) as "position" from rs group by 1')
def url_dedup_last(spark, sf):
    return web.dedup_by_url(results(spark, sf).select("ordinal", F.col("host").alias("url")), "last").select("url", "ordinal", "position")


@query(f"with {RES} select query_id, ordinal, round(1 - (row_number() over (partition by query_id order by ordinal) - 1) / (count(*) over (partition by query_id) + 1)::double, 6) score from rs")
def rank_decay(spark, sf):
    return web.rank_decay(results(spark, sf)).select("query_id", "ordinal", "score")


@query(f"with {RES} select query_id, ordinal, round(1 - 0.1::double * (row_number() over (partition by query_id order by ordinal) - 1), 6) score from rs")
def linear_decay(spark, sf):
    return web.linear_decay(results(spark, sf)).select("query_id", "ordinal", "score")


@query("""with g as (select conv_id stream, turn ordinal, role grp, case when lag(role) over (partition by conv_id order by turn) = role then 0 else 1 end s from conversations) select stream, ordinal, cast(sum(s) over (partition by stream order by ordinal) as bigint) island from g""")
def consecutive_groups(spark, sf):
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("ordinal"), F.col("role").alias("grp"))
    return web.consecutive_groups(c).select("stream", "ordinal", F.col("island").cast("bigint").alias("island"))


@query("""with s as (select doc_id // 10 url, doc_id ordinal, text snippet from documents), f as (select url, snippet, min(ordinal) o from s group by all) select url, sha256(string_agg('...' || snippet || '...', chr(10) || chr(10) order by o)) stitched from f group by 1""")
def snippet_stitch(spark, sf):
    found = web.stitched(read_spread(spark, sf, "documents", "doc_id").select(F.floor(F.col("doc_id") / 10).alias("url"), F.col("doc_id").alias("ordinal"), F.col("text").alias("snippet")))
    return found.withColumn("stitched", F.sha2("stitched", 256))


@query(f"""with {RES}, b as (select query_id, ordinal, chr(10) || chr(10) || '--- SOURCE ' || row_number() over (partition by query_id order by ordinal) || ': ' || host || ' ---' || chr(10) || 'URL: ' || url || chr(10) || chr(10) || 'SUMMARY:' || chr(10) || length(html) || repeat(chr(10), 4) || repeat('-', 80) || chr(10) b from rs) select query_id, 'Search results: ' || chr(10) || chr(10) || string_agg(b, '' order by ordinal) sources from b group by 1""")
def source_list(spark, sf):
    r = results(spark, sf).select("query_id", "ordinal", "url", F.col("host").alias("title"), F.length("html").cast("string").alias("content"))
    return web.source_list(r)


@query(f"""with {RES}, b as (select query_id, ordinal, repeat('=', 80) || chr(10) || 'Source: ' || host || chr(10) || repeat('-', 80) || chr(10) || 'URL: ' || url || chr(10) || '===' || chr(10) || 'Most relevant content from source: c' || chr(10) || '===' || chr(10) || 'Full source content limited to 10 tokens: '
 || case when ordinal % 3 = 0 then '' else substr(html, 1, 40) || case when length(html) > 40 then '... [truncated]' else '' end end || chr(10) || chr(10) || repeat('=', 80) || chr(10) || chr(10) b from rs) select query_id, rtrim('Content from sources:' || chr(10) || string_agg(b, '' order by ordinal), chr(10) || ' ') sources from b group by 1""")
def content_list(spark, sf):
    r = results(spark, sf).select("query_id", "ordinal", "url", F.col("host").alias("title"), F.lit("c").alias("content"), F.when(F.col("ordinal") % 3 != 0, F.col("html")).alias("raw_content"))
    return web.content_list(r, 10)


@query("""with r as (select user_id case_id, event_id % 5 attempt, event_id, value * 10 d, event_id % 97 t, event_id % 7 s, event_id % 3 q, event_type = 'error' g from events), l as (select * from r qualify row_number() over (partition by case_id order by attempt desc, event_id desc) = 1)
select count(*) n_cases, cast(round_even(avg(d), 0) as double) mean_duration_ms, cast(round_even(avg(t), 0) as double) mean_tokens, cast(round_even(avg(s), 2) as double) mean_sources, cast(sum(q) as bigint) n_searches, count(*) filter (g) n_degraded from l""")
def run_summary(spark, sf):
    i = F.col("event_id")
    r = read(spark, sf, "events").select(F.col("user_id").alias("case_id"), (i % 5).alias("attempt"), i.alias("ordinal"), (F.col("value") * 10).alias("duration_ms"), (i % 97).alias("tokens"), (i % 7).alias("sources"), (i % 3).alias("searches"), (F.col("event_type") == "error").alias("degraded"))
    return evaluate.run_summary(r)


@query("with u as (select page_id, case when page_id % 9 = 0 then 'http://localhost:80/x' when page_id % 9 = 1 then 'http://127.0.0.1/' else url end u from pages) select page_id, lower(regexp_extract(u, '://([^/?#:]+)', 1)) in ('localhost', '127.0.0.1') loopback from u")
def loopback_urls(spark, sf):
    u = F.when(F.col("page_id") % 9 == 0, "http://localhost:80/x").when(F.col("page_id") % 9 == 1, "http://127.0.0.1/").otherwise(F.col("url"))
    return read(spark, sf, "pages").select("page_id", web.loopback(u).alias("loopback"))


@query(f"""with {RES}, c as (select query_id, list(url order by ordinal) cs from rs group by 1), e as (select query_id, unnest(cs) url, generate_subscripts(cs, 1) - 1 i from c)
select cast(query_id as varchar) query, cast(i as int) ordinal, url, case when i = 0 then 'A' else 'See primary source for full content' end content, case when i = 0 then 1.0::double else 0.5 end score from e""")
def connector_cited_answer(spark, sf):
    r = results(spark, sf).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "url"))), lambda x: x["url"]).alias("citations"))
    return web.cited_answer(r.select(F.col("query_id").cast("string").alias("query"), F.lit("A").alias("answer"), "citations")).select("query", "ordinal", "url", "content", "score")


@query(f"""with {RES}, k as (select query_id, host url, ordinal, ordinal % 2 sub from rs qualify row_number() over (partition by query_id, host order by ordinal % 2, ordinal) = 1) select cast(query_id as varchar) query, cast(row_number() over (partition by query_id order by sub, ordinal) - 1 as int) ordinal, url, 's' || chr(10) || chr(10) || 't' content from k""")
def connector_subpages(spark, sf):
    r = results(spark, sf).select(F.col("query_id").cast("string").alias("query"), (F.col("ordinal") % 2).alias("is_subpage"), F.col("ordinal").alias("pos"), F.col("host").alias("url"), F.lit("x").alias("title"), F.lit("s").alias("summary"), F.lit("t").alias("text"), F.lit(1.0).alias("score"))
    return web.pages_with_subpages(r).select("query", F.col("ordinal").cast("int").alias("ordinal"), "url", "content")


@query(f"""with {RES} select query_id query, ordinal, 'Host: ' || host || case when ordinal % 2 = 0 then chr(10) || 'Size: ' || length(html) else '' end content, round(1 - (row_number() over (partition by query_id order by ordinal) - 1) / (count(*) over (partition by query_id) + 1)::double, 6) score from rs""")
def connector_labelled_lines(spark, sf):
    r = results(spark, sf).select(F.col("query_id").alias("query"), "ordinal", F.col("host").alias("title"), "url", "host", F.when(F.col("ordinal") % 2 == 0, F.length("html").cast("string")).alias("size"))
    return web.labelled_lines(r, {"host": "Host", "size": "Size"}).select("query", "ordinal", "content", "score")


@query(f"""with {RES}, k as (select query_id, host url, ordinal from rs qualify row_number() over (partition by query_id, host order by ordinal) = 1) select cast(query_id as varchar) query, cast(row_number() over (partition by query_id order by ordinal) - 1 as int) ordinal, url from k qualify ordinal < 5""".replace("qualify ordinal < 5", "qualify row_number() over (partition by query_id order by k.ordinal) <= 5"))
def connector_first_links(spark, sf):
    r = results(spark, sf).select(F.col("query_id").cast("string").alias("query"), F.lit(0).alias("page"), F.col("ordinal").alias("pos"), F.col("host").alias("url"), F.lit("t").alias("title"), F.lit("s").alias("snippet"))
    return web.first_links(r, 5).select("query", F.col("ordinal").cast("int").alias("ordinal"), "url")


@query("select url, case when page_id % 3 = 0 then 'content' else coalesce(case when page_id % 2 = 0 then 'summary' end, 'content') end content from pages")
def connector_summaries(spark, sf):
    i = F.col("page_id")
    r = read(spark, sf, "pages").select("url", F.lit("content").alias("content"), F.when(i % 3 != 0, "raw").alias("raw_content"), F.when(i % 2 == 0, "summary").alias("summary"))
    return web.summarized(r).select("url", "content")


@query("select page_id query, url link, (page_id % 10) / 4.0::double score from pages")
def connector_renamed(spark, sf):
    r = read(spark, sf, "pages").select("page_id", "url", ((F.col("page_id") % 10) / F.lit(4.0)).alias("rr"))
    return web.renamed_scores(r, query="page_id", link="url", score="rr")


@query("""with c as (select conv_id, turn, '{"content": {"Role": ' || to_json(role) || ', "share": ' || cast(turn / 7.0::double as varchar) || ', "text": ' || case when turn % 3 = 2 then 'null' else to_json(text) end || '}, "ids": [' || conv_id || ', ' || turn || '], "tool": {' || case when turn % 2 = 0 then '' else '"a": true, "b": ' || length(text) end || '}}' t from conversations)
select conv_id, turn, sha256(t) content_sha256, length(t) n_chars from c""")
def canonical_content(spark, sf):
    """Turns as nested values whose fields and keys are not in order, the text null in every third turn."""
    c = read(spark, sf, "conversations")
    content = F.struct(F.when(F.col("turn") % 3 != 2, F.col("text")).alias("text"), (F.col("turn") / 7).alias("share"), F.col("role").alias("Role"))
    tool = F.when(F.col("turn") % 2 == 0, F.parse_json(F.lit("{}"))).otherwise(F.parse_json(F.concat(F.lit('{"b": '), F.length("text"), F.lit(', "a": true}'))))
    t = T.canonical_text(F.struct(tool.alias("tool"), F.array("conv_id", "turn").alias("ids"), content.alias("content")))
    return c.select("conv_id", "turn", t.alias("t")).select("conv_id", "turn", F.sha2("t", 256).alias("content_sha256"), F.length("t").alias("n_chars"))


@query("select conv_id, turn, sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13))) content_sha256 from (select conv_id, turn, chr(10) || ' ' || text || ' ' || chr(9) text from conversations)")
def stripped_content(spark, sf):
    c = read(spark, sf, "conversations").withColumn("text", F.concat(F.lit("\n "), "text", F.lit(" \t")))
    return c.select("conv_id", "turn", F.sha2(T.content_text(F.col("text")), 256).alias("content_sha256"))
