"""Dataset rules, retrieval levels, headings, checksums, counters and payloads over whole tables in their roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.catalogue.base import Registry, read
from tessella.functions import vectors
from tessella.operators import evaluate, validate
from tessella.sources import adapters, files, sinks

query = Registry()


def named(prefix: str, number):
    return F.concat(F.lit(prefix), number.cast("string"))


@query("""with c as (select item_id, text, item_id % 7 s, item_id % 3 p, cast(item_id % 10 as double) sec from benchmark), r as (select *, unnest([1, 2, 3, 4, 5]) r from c),
h as (select item_id, sec, r, r >= 1 + item_id % 6 src, r >= 1 + item_id % 6 and r >= 2 + item_id % 3 pag, r >= 1 + item_id % 6 and r >= 2 + item_id % 3 and r % 2 = 0 ex, (item_id + r) % 11 = 0 rej from r),
f as (select item_id, any_value(sec) sec, min(r) filter (src) s, min(r) filter (pag) p, min(r) filter (ex) e, count(*) n, count(*) filter (rej) rej from h group by 1)
select count(*) case_count, round(count(s) / count(*), 6) source_recall, round(count(p) / count(*), 6) page_recall, round(count(e) / count(*), 6) exact_recall, round(sum(coalesce(1.0::double / s, 0)) / count(*), 6) source_mrr, round(sum(coalesce(1.0::double / p, 0)) / count(*), 6) page_mrr,
 round(sum(coalesce(1.0::double / e, 0)) / count(*), 6) exact_mrr, round(sum(rej) / sum(n), 6) rejected_rate, round(avg(sec), 3) mean_seconds from f""")
def retrieval_levels(spark, sf):
    i, r = F.col("item_id"), F.col("rank")
    b = read(spark, sf, "benchmark")
    cases = b.select(i.alias("query_id"), (i % 7).alias("source_id"), (i % 3).alias("page_number"), F.col("text").alias("label"), (i % 10).cast("double").alias("seconds"))
    ranked = b.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(5))))
    text = F.when(r % 2 == 0, F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("  ")), F.lit(" "))).otherwise("no such words")
    results = ranked.select(i.alias("query_id"), "rank", F.when(r >= 1 + i % 6, i % 7).otherwise(99).alias("source_id"), F.when(r >= 2 + i % 3, i % 3).otherwise(9).alias("page_number"), text.alias("text"), ((i + r) % 11 == 0).alias("rejected"))
    return evaluate.retrieval_levels(cases, results)


@query("""with f as (select sha256(text) k, doc_id % 5 = 1 dup, doc_id % 97 w from documents), g as (select k, count(*) filter (not dup) c, count(distinct w) w from f group by 1)
select 'one_canonical' as "rule", k as "key" from g where c <> 1 union all select 'duplicate_inherits', k from g where w <> 1""")
def duplicate_rules(spark, sf):
    d = read(spark, sf, "documents")
    return validate.duplicate_rules(d.select(F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 5 == 1).alias("is_exact_duplicate"), (F.col("doc_id") % 97).alias("work_id")))


@query("""with r as (select 'p' || doc_id id, doc_id % 10 w, case when lang = 'en' then 'original' else 'translation' end d, case when doc_id % 4 = 1 then 'p' || (doc_id - 10) end t, case when doc_id % 4 = 2 then 'p' || (doc_id - 7) end v, doc_id % 3 = 0 prim from documents),
j as (select r.*, coalesce(r.t, r.v) target, o.id oid, o.w ow, o.d od from r left join r o on coalesce(r.t, r.v) = o.id)
select 'target_exists' as "rule", id as "key" from j where target is not null and oid is null union all select 'target_same_work', id from j where oid is not null and ow <> w
union all select 'translation_of_original', id from j where t is not null and oid is not null and (od <> 'original' or d <> 'translation') union all select 'primary_has_no_target', id from j where prim and target is not null""")
def link_target_rules(spark, sf):
    i = F.col("doc_id")
    rows = read(spark, sf, "documents").select(
        named("p", i).alias("paper_id"), (i % 10).alias("work_id"), F.when(F.col("lang") == "en", "original").otherwise("translation").alias("document_type"), F.when(i % 4 == 1, named("p", i - 10)).alias("translation_of"),
        F.when(i % 4 == 2, named("p", i - 7)).alias("variant_of"), F.when(i % 3 == 0, "primary").otherwise("auxiliary_translation").alias("index_policy"),
    )
    return validate.link_target_rules(rows)


@query("""with a as (select source, count(*) n from documents group by 1) select 'summary_count' as "rule", source as "key" from a where source in ('src3', 'src5')""")
def summary_count_rules(spark, sf):
    n = read(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    return validate.count_rules(n.withColumn("n", F.when(F.col("name") == "src3", F.col("n") + 1).otherwise(F.col("n"))), n.where("name <> 'src5'"))


@query("""with p as (select 'p' || n_nationkey id, case when n_nationkey % 2 = 0 then 'test' else 'development' end s, 1 + n_nationkey % 4 pages from nation), b as (select 'p' || s_nationkey paper, 1 + s_suppkey % 4 page, 'b' || s_suppkey id, s_name text from supplier),
q as (select s_suppkey k, 'p' || (s_nationkey + case when s_suppkey % 11 = 0 then 30 else 0 end) paper, 1 + s_suppkey % 4 + case when s_suppkey % 9 = 0 then 4 else 0 end page, case when s_suppkey % 5 = 0 then ['b' || s_suppkey, 'b' || (s_suppkey + 1)] else ['b' || s_suppkey] end ids, case when s_suppkey % 4 = 0 then 'no such words' else s_name end answer from supplier),
j as (select q.*, p.s, p.pages from q left join p on q.paper = p.id), e as (select k, paper, page, answer, unnest(ids) id from q), t as (select e.k, e.answer, count(*) filter (b.id is null) lost, coalesce(string_agg(b.text, ' ' order by e.id), '') whole from e left join b on e.id = b.id and e.paper = b.paper and e.page = b.page group by 1, 2)
select 'question_paper' as "rule", cast(k as varchar) as "key" from j where s is null union all select 'question_held_out', cast(k as varchar) from j where s <> 'test' union all select 'question_page', cast(k as varchar) from j where s is not null and not page between 1 and pages
union all select 'question_blocks', cast(k as varchar) from t where lost > 0 union all select 'answer_in_blocks', cast(k as varchar) from t where not contains(whole, answer)""")
def question_rules(spark, sf):
    i = F.col("s_suppkey")
    n = F.col("n_nationkey")
    s = read(spark, sf, "supplier")
    papers = read(spark, sf, "nation").select(named("p", n).alias("paper_id"), F.when(n % 2 == 0, "test").otherwise("development").alias("dataset_split"), (1 + n % 4).alias("pages"))
    blocks = s.select(named("p", F.col("s_nationkey")).alias("paper_id"), (1 + i % 4).alias("page_number"), named("b", i).alias("block_id"), F.col("s_name").alias("text"))
    ids = F.when(i % 5 == 0, F.array(named("b", i), named("b", i + 1))).otherwise(F.array(named("b", i)))
    questions = s.select(
        i.alias("question_id"), named("p", F.col("s_nationkey") + F.when(i % 11 == 0, 30).otherwise(0)).alias("paper_id"), (1 + i % 4 + F.when(i % 9 == 0, 4).otherwise(0)).alias("page_number"), ids.alias("block_ids"),
        F.when(i % 4 == 0, "no such words").otherwise(F.col("s_name")).alias("answer"),
    )
    return validate.question_rules(questions, papers, blocks)


@query("""select 'reviews_missing' as "rule", cast(item_id as varchar) as "key" from benchmark where item_id % 9 <> 0 and item_id % 7 = 0 union all select 'reviews_extra', cast(item_id as varchar) from benchmark where item_id % 9 = 0 and item_id % 7 <> 0""")
def review_sets(spark, sf):
    b = read(spark, sf, "benchmark").select("item_id")
    return validate.same_sets(b.where("item_id % 9 <> 0"), b.where("item_id % 7 <> 0"), "item_id", "reviews")


@query("select doc_id from documents where doc_id % 6 <> 1 and doc_id % 2 = 0")
def indexable_rows(spark, sf):
    i = F.col("doc_id")
    rows = read(spark, sf, "documents").select("doc_id", F.when(i % 6 > 0, i % 6 != 1).alias("indexable"), F.when(i % 2 == 0, "development").otherwise("test").alias("dataset_split"))
    return adapters.selected(rows).select("doc_id")


@query(r"""with t as (select p_partkey, case when p_partkey % 3 = 0 then '1.2 ' || p_name else p_name end x from part) select p_partkey, regexp_matches(x, '(?i)^(?:\d+(?:\.\d+)*|[IVX]+)\s*[.、:]?\s*\S+') or (p_partkey % 2 = 0 and 8 + p_partkey % 6 >= 11.7) heading from t""")
def headings(spark, sf):
    i = F.col("p_partkey")
    text = F.when(i % 3 == 0, F.concat(F.lit("1.2 "), "p_name")).otherwise(F.col("p_name"))
    return read(spark, sf, "part").select("p_partkey", vectors.heading(text, (8 + i % 6).cast("double"), i % 2 == 0, F.lit(10.0)).alias("heading"))


@query("""select printf('d/%08d', doc_id) relative_path, case when doc_id % 7 = 0 then 'missing' when doc_id % 11 = 0 then 'extra' when doc_id % 10 = 3 then 'changed' else 'ok' end state from documents where not (doc_id % 7 = 0 and doc_id % 11 = 0)""")
def checksum_states(spark, sf):
    i = F.col("doc_id")
    d = read(spark, sf, "documents").select("doc_id", F.format_string("d/%08d", i).alias("relative_path"), F.sha2("text", 256).alias("sha256"))
    return files.verified(d.where("doc_id % 11 <> 0"), d.where("doc_id % 7 <> 0").withColumn("sha256", F.when(i % 10 == 3, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256"))))


@query("""select case event_id % 3 when 0 then 'requests_total' else 'tokens_total' end as "name", cast(sum(event_id % 5) as double) total from events where event_id % 3 < 2 group by 1""")
def counter_totals(spark, sf):
    i = F.col("event_id")
    n = (i % 5).cast("string")
    lines = read(spark, sf, "events").select(F.when(i % 3 == 0, F.concat(F.lit('requests_total{kind="a"} '), n)).when(i % 3 == 1, F.concat(F.lit("tokens_total "), n)).otherwise("# HELP tokens_total of all calls").alias("value"))
    return files.counters(lines, ["requests_total", "tokens_total"])


@query("""select c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' payload from customer""")
def json_payloads(spark, sf):
    return sinks.payloads(read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", ["c_acctbal"])
