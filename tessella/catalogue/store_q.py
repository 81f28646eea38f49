"""Keyed tables: upserts, integrity, resume; conversations, events and the trade tables in their roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.catalogue.base import Registry, read
from tessella.operators import store, validate
from tessella.sources import adapters

query = Registry()

EV = "ev as (select 'e' || doc_id evidence_id, 's' || source source_id, sha256(text) content_sha256, doc_id, lang from documents)"


def evidence(spark, sf):
    d = read(spark, sf, "documents")
    return d.select(F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("evidence_id"), F.concat(F.lit("s"), "source").alias("source_id"), F.sha2("text", 256).alias("content_sha256"), "doc_id", "lang", "text")


EMB = EV + ", emb as (select evidence_id, case when doc_id % 5 = 0 then sha256('old') else content_sha256 end content_sha256, case when doc_id % 4 = 3 then 'b' else 'a' end model from ev where doc_id % 3 <> 0)"


def embedded(spark, sf):
    e = evidence(spark, sf).where("doc_id % 3 <> 0")
    return e.select("evidence_id", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.col("content_sha256")).alias("content_sha256"), F.when(F.col("doc_id") % 4 == 3, "b").otherwise("a").alias("model"))


@query(f"with {EMB} select evidence_id from ev where not exists (select 1 from emb where model = 'a' and emb.evidence_id = ev.evidence_id and emb.content_sha256 = ev.content_sha256)")
def resume_pending(spark, sf):
    return store.resume(evidence(spark, sf), embedded(spark, sf), "a")[1].select("evidence_id")


@query(f"with {EMB} select evidence_id from ev where exists (select 1 from emb where model = 'a' and emb.evidence_id = ev.evidence_id and emb.content_sha256 = ev.content_sha256)")
def resume_skipped(spark, sf):
    return store.resume(evidence(spark, sf), embedded(spark, sf), "a")[0].select("evidence_id")


@query(f"with {EMB} select evidence_id, model from emb where not exists (select 1 from ev where emb.evidence_id = ev.evidence_id and emb.content_sha256 = ev.content_sha256)")
def stale_vectors(spark, sf):
    return embedded(spark, sf).join(evidence(spark, sf).select("evidence_id", "content_sha256"), ["evidence_id", "content_sha256"], "left_anti").select("evidence_id", "model")


@query(f"""with {EMB}, c as (select count(*) requested, count(*) filter (exists (select 1 from emb where model = 'a' and emb.evidence_id = ev.evidence_id and emb.content_sha256 = ev.content_sha256)) skipped, count(*) filter (not exists (select 1 from emb where model = 'a' and emb.evidence_id = ev.evidence_id and emb.content_sha256 = ev.content_sha256) and doc_id % 10 <> 9) indexed from ev)
select requested, skipped, indexed, requested - skipped - indexed failed, requested = skipped + indexed complete from c""")
def indexing_counts(spark, sf):
    e = evidence(spark, sf)
    skipped, pending = store.resume(e, embedded(spark, sf), "a")
    return store.indexing_counts(e, skipped, pending.select(F.when(F.col("doc_id") % 10 == 9, "bad record").alias("error")))


@query("""with a as (select c_custkey, c_name, c_acctbal from customer where c_custkey % 4 <> 0), b as (select c_custkey, c_name, case when c_custkey % 6 = 0 then c_acctbal + 1 else c_acctbal end c_acctbal from customer where c_custkey % 3 = 0)
select c_custkey, case when a.c_custkey is null then 'insert' when (a.c_name, a.c_acctbal) is not distinct from (b.c_name, b.c_acctbal) then 'unchanged' else 'update' end outcome from b left join a using (c_custkey)""")
def upsert_outcome(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    batch = c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 6 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return store.upsert_outcome(c.where("c_custkey % 4 <> 0"), batch, "c_custkey", ["c_name", "c_acctbal"])


@query("""with a as (select o_custkey k, o_totalprice v from orders where o_orderkey % 2 = 0 qualify row_number() over (partition by o_custkey order by o_orderkey) = 1), b as (select o_custkey k, o_totalprice v from orders where o_orderkey % 2 = 1 qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1)
select k, v from b union all select k, v from a where k not in (select k from b)""")
def upsert_last_wins(spark, sf):
    o = read(spark, sf, "orders")
    old = store.upsert(o.limit(0).select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v")), o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), (-F.col("o_orderkey")).alias("n")), "k", "n")
    return store.upsert(old, o.where("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("n")), "k", "n")


@query("""with e as (select distinct l_orderkey, l_partkey from lineitem where l_linenumber <= 2), b as (select distinct l_orderkey, l_suppkey l_partkey from lineitem where l_orderkey % 5 = 0)
select * from e where l_orderkey not in (select l_orderkey from b) union all select * from b""")
def edge_sync(spark, sf):
    li = read(spark, sf, "lineitem")
    return store.replace_edges(li.where("l_linenumber <= 2").select("l_orderkey", "l_partkey").distinct(), li.where("l_orderkey % 5 = 0").select("l_orderkey", F.col("l_suppkey").alias("l_partkey")), "l_orderkey")


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_custkey % 10 <> 3)")
def fk_violations(spark, sf):
    return store.missing_keys(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", read(spark, sf, "customer").where("c_custkey % 10 <> 3"), "c_custkey")


CIT = EV + """, so as (select distinct source_id from ev where source_id <> 'ssrc3'), cl as (select 'c' || doc_id claim_id, [evidence_id, 'e' || (doc_id + 1)] evidence_ids from ev where doc_id % 2 = 0),
ci as (select 'c' || doc_id claim_id, 'e' || (doc_id + doc_id % 5) evidence_id, case when doc_id % 7 = 0 then 'ssrc0' else source_id end source_id, doc_id from ev where doc_id % 3 = 0),
j as (select ci.*, cl.evidence_ids, e.source_id es, so.source_id ss from ci left join cl using (claim_id) left join ev e using (evidence_id) left join so on so.source_id = ci.source_id)"""


@query(f"with {CIT} select claim_id, evidence_id, source_id, case when evidence_ids is null then 'unknown_claim' when es is null then 'unknown_evidence' when ss is null then 'unknown_source' when es <> source_id then 'source_mismatch' when not list_contains(evidence_ids, evidence_id) then 'not_linked' end reason from j")
def citation_violations(spark, sf):
    e = evidence(spark, sf)
    eid = lambda x: F.concat(F.lit("e"), x.cast("string"))
    d = F.col("doc_id")
    claims = e.where("doc_id % 2 = 0").select(F.concat(F.lit("c"), d.cast("string")).alias("claim_id"), F.array("evidence_id", eid(d + 1)).alias("evidence_ids"))
    cits = e.where("doc_id % 3 = 0").select(F.concat(F.lit("c"), d.cast("string")).alias("claim_id"), eid(d + d % 5).alias("evidence_id"), F.when(d % 7 == 0, "ssrc0").otherwise(F.col("source_id")).alias("source_id"))
    return store.citation_checks(cits, claims, e, e.where("source_id <> 'ssrc3'").select("source_id").distinct()).select("claim_id", "evidence_id", "source_id", "reason")


@query("select 'documents' as name, count(*) n from documents union all select 'pages', count(*) from pages union all select 'embeddings', count(*) from embeddings")
def table_statistics(spark, sf):
    return store.counts({t: read(spark, sf, t) for t in ("documents", "pages", "embeddings")})


@query(f"with {EV}, k as (select evidence_id, source_id from ev order by evidence_id limit 50) select source_id, count(*) n from k group by 1")
def pruned_sources(spark, sf):
    e = evidence(spark, sf)
    sources, kept = store.pruned_sources(e.select("source_id").distinct(), e, 50)
    return sources.join(kept, "source_id").groupBy("source_id").agg(F.count("*").alias("n"))


@query("""with a as (select doc_id, case when doc_id % 8 = 0 then '' else source end source, case when doc_id % 9 = 0 then null else lang end lang from documents) select doc_id, array_to_string(list_filter([case when coalesce(source, '') = '' then 'source' end, case when coalesce(lang, '') = '' then 'lang' end], lambda x: x is not null), ',') missing from a where coalesce(source, '') = '' or coalesce(lang, '') = ''""")
def required_fields(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 8 == 0, "").otherwise(F.col("source")).alias("source"), F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("lang"))
    return adapters.required(d, ["source", "lang"])[1].select("doc_id", F.array_join("missing", ",").alias("missing"))


@query("""with r as (select page_id, url, case page_id % 4 when 0 then html end raw, case when page_id % 4 in (1, 2) then 'text ' || page_id end content, case when page_id % 5 > 1 then 'snippet' end snippet from pages), t as (select url, coalesce(nullif(trim(raw), ''), nullif(trim(content), ''), nullif(trim(snippet), '')) t from r)
select distinct url uri, sha256(t) text_sha256, 'source-' || substr(sha256('["' || url || '"]'), 1, 20) source_id from t where t is not null""")
def search_evidence(spark, sf):
    p = read(spark, sf, "pages")
    m = F.col("page_id") % 4
    r = p.select("url", F.when(m == 0, F.col("html")).alias("raw_content"), F.when(m.isin(1, 2), F.concat(F.lit("text "), F.col("page_id").cast("string"))).alias("content"), F.when(F.col("page_id") % 5 > 1, "snippet").alias("snippet"))
    return adapters.evidence_from_search(r).select("uri", F.sha2("text", 256).alias("text_sha256"), "source_id").distinct()


CHUNKS = """ch as (select 'c' || doc_id chunk_id, 'p' || (doc_id % 40) paper_id, case when doc_id % 29 = 0 then text || '!' else text end text, n_chars char_count, case when doc_id % 31 = 0 then sha256('x') else sha256(text) end content_sha256, cast(doc_id % 6 as int) page_number, 'w' || (case when doc_id % 37 = 0 then 1 else doc_id % 40 end) work_id,
 'c' || (doc_id + 1) next_chunk_id, case when doc_id % 23 = 0 then 'c0' else 'c' || (doc_id - 1) end previous_chunk_id, case when doc_id % 40 < 8 then 'test' else 'development' end dataset_split, doc_id % 40 >= 8 or doc_id % 51 = 0 tuning_allowed from documents), pa as (select 'p' || n paper_id, 'w' || n work_id, 4 pages from range(38) t(n))"""


def chunk_table(spark, sf):
    d, i = read(spark, sf, "documents"), F.col("doc_id")
    s = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    chunks = d.select(
        s("c", i).alias("chunk_id"), s("p", i % 40).alias("paper_id"), F.when(i % 29 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), F.col("n_chars").alias("char_count"), F.when(i % 31 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("text", 256)).alias("content_sha256"), (i % 6).cast("int").alias("page_number"),
        s("w", F.when(i % 37 == 0, 1).otherwise(i % 40)).alias("work_id"), s("c", i + 1).alias("next_chunk_id"), F.when(i % 23 == 0, "c0").otherwise(s("c", i - 1)).alias("previous_chunk_id"), F.when(i % 40 < 8, "test").otherwise("development").alias("dataset_split"), ((i % 40 >= 8) | (i % 51 == 0)).alias("tuning_allowed"),
    )
    papers = spark.range(38).select(s("p", F.col("id")).alias("paper_id"), s("w", F.col("id")).alias("work_id"), F.lit(4).alias("pages"))
    return chunks, papers


@query(f"""with {CHUNKS}, j as (select ch.*, pa.work_id pw, pages from ch left join pa using (paper_id)),
w as (select work_id, count(distinct dataset_split) s, count(distinct tuning_allowed) t from ch group by 1)
select 'char_count' as rule, chunk_id as "key" from ch where char_count <> length(text) or char_count > 100000 union all select 'content_sha256', chunk_id from ch where content_sha256 <> sha256(text) union all select 'known_paper', chunk_id from j where pw is null
union all select 'inherited_work', chunk_id from j where pw <> work_id union all select 'page_range', chunk_id from j where pw is not null and not page_number between 1 and pages
union all select 'next_link', a.chunk_id from ch a left join ch b on b.chunk_id = a.next_chunk_id where b.previous_chunk_id is distinct from a.chunk_id union all select 'previous_link', a.chunk_id from ch a left join ch b on b.chunk_id = a.previous_chunk_id where b.next_chunk_id is distinct from a.chunk_id
union all select 'one_split', work_id from w where s <> 1 union all select 'one_tuning_flag', work_id from w where t <> 1 union all select 'test_not_tuned', chunk_id from ch where dataset_split = 'test' and tuning_allowed""")
def validator_rules(spark, sf):
    chunks, papers = chunk_table(spark, sf)
    return validate.chunk_rules(chunks, papers, 100000)


@query(f"""with {CHUNKS}, v as (select 'char_count' as rule, chunk_id as "key" from ch where char_count <> length(text) or char_count > 100000 union all select 'content_sha256', chunk_id from ch where content_sha256 <> sha256(text)), n as (select count(*) n_total from v)
select rule, "key", n_total, n_total > 50 truncated from v, n order by rule, "key" limit 50""")
def validator_capped(spark, sf):
    chunks, _ = chunk_table(spark, sf)
    bad = validate.gathered(validate._hits(chunks, "char_count", "chunk_id", (F.col("char_count") != F.length("text")) | (F.col("char_count") > 100000)), validate._hits(chunks, "content_sha256", "chunk_id", F.col("content_sha256") != F.sha2("text", 256)))
    return validate.capped(bad)


@query("""with t as (select page_id, case when page_id % 6 = 0 then '/home/' || url when page_id % 6 = 1 then 'C:\\x' else url end path from pages) select 'absolute_path_path' as rule, cast(page_id as varchar) as "key" from t where regexp_matches(path, '^(/|\\\\|[A-Za-z]:[\\\\/]|file:)')""")
def absolute_paths(spark, sf):
    p = read(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("/home/"), "url")).when(F.col("page_id") % 6 == 1, F.lit("C:\\x")).otherwise(F.col("url")).alias("path"))
    return validate.path_rules(p, "page_id", ["path"])


@query("""with d as (select doc_id, case when doc_id % 20 = 0 then null else source end source, case when doc_id % 15 = 0 then 'it' else lang end lang from documents)
select 'required_source' as rule, cast(doc_id as varchar) as "key" from d where source is null union all select 'pattern_source', cast(doc_id as varchar) from d where not regexp_matches(source, '^src1?[0-9]$') union all select 'allowed_lang', cast(doc_id as varchar) from d where lang not in ('en', 'de', 'fr', 'es')""")
def schema_checks(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 20 != 0, F.col("source")).alias("source"), F.when(F.col("doc_id") % 15 == 0, "it").otherwise(F.col("lang")).alias("lang"))
    return validate.schema_rules(d, "doc_id", ["source"], {"source": "^src1?[0-9]$"}, {"lang": ["en", "de", "fr", "es"]})
