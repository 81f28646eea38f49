"""Retrieval: BM25, dense, fusion, quality gate, reranking, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.catalogue.base import Registry, read, read_spread
from tessella.functions import text as T
from tessella.functions import vectors as V
from tessella.operators import evaluate, quality, retrieval
from tessella.operators.layout import settled
from tessella.plans import flows

query = Registry()
TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def asked(spark, sf):
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def corpus(spark, sf):
    return read_spread(spark, sf, "documents", "doc_id").select("doc_id", "text")


def passages(spark, sf):
    """documents as passages with their whole texts: the source is the section, every seventh has no page."""
    d = read_spread(spark, sf, "documents", "doc_id")
    section = F.when(F.col("doc_id") % 11 == 0, "References").when(F.col("doc_id") % 13 == 0, "12:3 running").when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source"))
    return d.select("doc_id", "text", section.alias("section"), F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(1).cast("int").alias("page_number"), F.col("source").alias("title"))


def bm25_sql(k: int, docs: str = "documents", queries: str = "benchmark") -> str:
    return f"""d as (select doc_id, {TOK} toks from {docs}), n as (select count(*) n_docs, avg(len(toks)) avgdl from d),
tf as (select doc_id, dl, term, count(*) tf from (select doc_id, len(toks) dl, unnest(toks) term from d) group by all), df as (select term, count(*) df from tf group by 1),
q as (select item_id query_id, term, count(*) qtf from (select item_id, unnest({TOK}) term from {queries}) group by all),
sc as (select query_id, doc_id, round(sum(qtf * ln(1 + (n_docs - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 6) score from tf join df using (term) join q using (term), n group by all),
bm as (select *, row_number() over (partition by query_id order by score desc, doc_id) as "rank" from sc where score > 0 qualify "rank" <= {k})"""


@query(f'with {bm25_sql(5)} select query_id, doc_id, score, cast("rank" as int) as "rank" from bm')
def bm25_topk(spark, sf):
    return retrieval.bm25(asked(spark, sf), corpus(spark, sf), 5)


UNIT = """u as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings), uu as (select vec_id, sqrt(list_sum(list_transform(v, lambda x: x * x))) s, v from u), un as (select vec_id, list_transform(v, lambda x: case when s > 0 then x / s else x end) v from uu)"""
SCORES = "ds as (select a.vec_id query_id, b.vec_id doc_id, round(list_dot_product(a.v, b.v), 6) score from un a, un b"
DENSE = f"{UNIT},\n{SCORES} where a.vec_id % 20 = 0)"


def vectors(spark, sf):
    return read_spread(spark, sf, "embeddings", "vec_id").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def vector_queries(spark, sf):
    return vectors(spark, sf).where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")


@query(f'with {UNIT}, {SCORES}) select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as "rank" from ds where score > 0 qualify "rank" <= 5')
def dense_topk_positive(spark, sf):
    """Every vector asks for its five nearest."""
    return retrieval.dense(vectors(spark, sf).withColumnRenamed("doc_id", "query_id"), vectors(spark, sf), 5)


@query(f'with {DENSE} select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as "rank" from ds qualify "rank" <= 8')
def dense_topk_all(spark, sf):
    return retrieval.dense(vector_queries(spark, sf), vectors(spark, sf), 8, positive_only=False)


RRF = bm25_sql(10) + """, second as (select query_id, doc_id, row_number() over (partition by query_id order by (doc_id * 7919 + query_id * 104729) % 1009, doc_id) as "rank" from bm),
parts as (select query_id, doc_id, 1.0::double / (60 + "rank") part, "rank" r0, null r1 from bm union all select query_id, doc_id, 0.5::double / (60 + "rank"), null, "rank" from second),
f as (select query_id, doc_id, round(sum(part), 9) score, max(r0) rank_0, max(r1) rank_1 from parts group by all)"""


def second_list(first):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy((F.col("doc_id") * 7919 + F.col("query_id") * 104729) % 1009, "doc_id")
    return first.select("query_id", "doc_id", F.row_number().over(w).alias("rank"))


@query(f'with {RRF} select query_id, doc_id, score, cast(rank_0 as int) rank_0, cast(rank_1 as int) rank_1, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as "rank" from f qualify "rank" <= 5')
def rrf_fusion(spark, sf):
    first = settled(retrieval.bm25(asked(spark, sf), corpus(spark, sf), 10))
    return retrieval.fused([(first, 1.0), (second_list(first), 0.5)], 5)


@query(f"""with {RRF}, j as (select query_id, doc_id, (doc_id % 10) / 10.0::double q from bm union all select query_id, doc_id, case when doc_id % 3 <> 0 then (doc_id % 7) / 10.0::double end from second), m as (select query_id, doc_id, max(q) quality_score from j group by all)
select query_id, doc_id, score, quality_score, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as "rank" from f join m using (query_id, doc_id) qualify "rank" <= 5""")
def fusion_with_quality(spark, sf):
    """Two lists with qualities of their own, the second with gaps; a document has the better one."""
    first = settled(retrieval.bm25(asked(spark, sf), corpus(spark, sf), 10))
    second = second_list(first).withColumn("quality_score", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 7 / 10))
    return retrieval.fused([(first.withColumn("quality_score", F.col("doc_id") % 10 / 10), 1.0), (second, 0.5)], 5).select("query_id", "doc_id", "score", "quality_score", "rank")


@query(f"""with {RRF}, top as (select *, row_number() over (partition by query_id order by score desc, doc_id) old_rank from f qualify old_rank <= 10), qt as (select item_id query_id, list_distinct({TOK}) qt from benchmark), dt as (select doc_id, list_distinct(toks) dt from d), s as (select top.*, round(case when len(qt) > 0 then len(list_intersect(qt, dt)) / len(qt) else 0 end, 6) rerank_score from top join qt using (query_id) join dt using (doc_id))
select query_id, doc_id, score, rerank_score, cast(old_rank as int) old_rank, cast(row_number() over (partition by query_id order by rerank_score desc, old_rank, doc_id) as int) as "rank" from s qualify "rank" <= 5""")
def rerank_topk(spark, sf):
    first = settled(retrieval.bm25(asked(spark, sf), corpus(spark, sf), 10))
    fused = settled(retrieval.fused([(first, 1.0), (second_list(first), 0.5)], 10).select("query_id", "doc_id", "score", "rank"))
    words = lambda df, key, name: settled(df.select(key, F.array_distinct(T.retrieval_tokens(F.col("text"))).alias(name)))
    needed = words(corpus(spark, sf).join(fused.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "dt")  # each document once
    both = fused.select("query_id", "doc_id").join(words(asked(spark, sf), "query_id", "qt"), "query_id").join(needed, "doc_id")
    scores = both.select("query_id", "doc_id", F.round(T.coverage(F.col("qt"), F.col("dt")), 6).alias("rerank_score"))
    return retrieval.reranked(fused, scores, 5).select("query_id", "doc_id", "score", "rerank_score", "old_rank", "rank")


PASSAGES = r"""p as (select doc_id, text, case when doc_id % 11 = 0 then 'References' when doc_id % 13 = 0 then '12:3 running' when doc_id % 4 = 0 then '' else source end section, case when doc_id % 7 = 0 then null else 1 end page_number from documents),
x as (select doc_id, section s, page_number pg, trim(regexp_replace(text, '[\s\x{A0}\x{85}\x{2028}\x{2029}\x{3000}\x0B]+', ' ', 'g')) t from p),
y as (select *, length(t) n, regexp_extract_all(lower(t), '[a-z0-9]+|[一-鿿]') tk, len(regexp_extract_all(t, '[一-鿿]')) cjk, regexp_matches(t, '[.!?。！？]["''”’)]?$') ends, length(t) - length(regexp_replace(t, '[\p{L}\p{N}]', '', 'g')) readable from x),
z as (select *, list_filter([case when n < 48 then 'too_short' end, case when pg is null then 'missing_page' end, case when s <> '' and regexp_matches(s, '(?i)\b(?:references|bibliography|works cited)\b|参考文献') then 'reference_section' end,
 case when regexp_matches(substr(t, 1, 240), '(?i)^(?:\[\d{1,4}\]|\d{1,4}\.)\s+.{0,100}\b(?:19|20)\d{2}\b') then 'reference_entry' end, case when len(regexp_extract_all(t, '(?:^|\s)\[\d{1,4}\]\s+[A-Z]')) >= 2 then 'reference_list' end,
 case when n < 120 and len(tk) < 14 and cjk < 14 and not ends then 'heading_only' end, case when n > 0 and readable / n < 0.35 and cjk < 14 then 'low_text_density' end], lambda r: r is not null) hard,
 list_filter([case when s = '' then 'missing_section' end, case when s <> '' and regexp_matches(s, '^\d+:\d+\s+') then 'running_header_section' end, case when n < 160 then 'short_passage' end, case when not ends then 'no_terminal_sentence' end, case when len(list_distinct(tk)) < 8 and cjk < 14 then 'low_token_diversity' end], lambda r: r is not null) soft,
 round(greatest(0, least(1, 1.0::double - case when s = '' then 0.05 else 0 end - case when s <> '' and regexp_matches(s, '^\d+:\d+\s+') then 0.15 else 0 end - case when n < 160 then 0.15 else 0 end - case when not ends then 0.10 else 0 end - case when len(list_distinct(tk)) < 8 and cjk < 14 then 0.15 else 0 end)), 6) score from y),
qa as (select doc_id, len(hard) = 0 and score >= 0.45 accepted, cast(score as double) quality_score, array_to_string(list_concat(hard, soft), ',') reasons from z)"""


@query(f"with {PASSAGES} select * from qa")
def quality_assessment(spark, sf):
    return quality.assessed(passages(spark, sf)).select("doc_id", "accepted", "quality_score", F.array_join("reasons", ",").alias("reasons"))


@query(f"""with {PASSAGES}, {bm25_sql(15)} select query_id, doc_id, score, quality_score, cast("rank" as int) old_rank, cast(row_number() over (partition by query_id order by "rank") as int) new_rank from bm join qa using (doc_id) where accepted qualify new_rank <= 5""")
def quality_filtered_topk(spark, sf):
    first = retrieval.bm25(asked(spark, sf), corpus(spark, sf), 15)
    return retrieval.gated(first, passages(spark, sf), 5).withColumnRenamed("rank", "new_rank").select("query_id", "doc_id", "score", "quality_score", "old_rank", "new_rank")


@query(f"""with {DENSE}, r as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as "rank" from ds where query_id <> doc_id qualify "rank" <= 10),
f as (select query_id, min(case when e.label = q.label then "rank" end) fr from r join embeddings e on e.vec_id = doc_id join embeddings q on q.vec_id = query_id group by 1), qq as (select vec_id query_id from embeddings where vec_id % 20 = 0)
select count(*) n_queries, round(avg(case when fr <= 10 then 1.0::double else 0 end), 6) recall, round(avg(case when fr <= 10 then 1.0::double / fr else 0 end), 6) mrr from qq left join f using (query_id)""")
def recall_mrr(spark, sf):
    e = read(spark, sf, "embeddings")
    q = vector_queries(spark, sf)
    hits = retrieval.dense(q, vectors(spark, sf), 11, positive_only=False).where("query_id <> doc_id")
    hits = retrieval.ranked(hits.drop("rank"), 10)
    labelled = hits.join(e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("a")), "doc_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("b")), "query_id")
    return evaluate.recall_mrr(q, evaluate.first_relevant(labelled, F.col("a") == F.col("b")), 10)


@query()
def hybrid_search(spark, sf):
    """Gate, BM25, hashed vectors, fusion, reranking; the hashed vectors have no SQL form."""
    return flows.search(asked(spark, sf), passages(spark, sf), 5).select("query_id", "doc_id", "rank", "rerank_score")


@query()
def nearest_parts(spark, sf):
    """The five nearest parts of the ten documents that BM25 finds for each benchmark item; the hashed vectors have no SQL form."""
    q, docs = asked(spark, sf), corpus(spark, sf)
    vectors = q.select("query_id", V.hashing_embedding(T.retrieval_tokens(F.col("text"))).alias("vector"))
    return retrieval.best_parts(retrieval.bm25(q, docs, 10), docs, vectors).select("query_id", "doc_id", "start", F.sha2("part", 256).alias("part_sha256"), "score", "rank")


@query()
def research_answers(spark, sf):
    """From benchmark items to cited reports over documents."""
    return flows.answer(asked(spark, sf), passages(spark, sf), 5, "hybrid")


@query("select 'corpus' as \"check\", count(*) > 0 ok from documents union all select 'vectors', bool_and(len(embedding) = 64) from embeddings")
def health_checks(spark, sf):
    return flows.health(passages(spark, sf), vectors(spark, sf), 64)


@query("""with u as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings) select a.vec_id, round(case when n.a * n.b > 0 then list_dot_product(a.v, b.v) / (n.a * n.b) else 0 end, 6) cosine
 from u a join u b on b.vec_id = a.vec_id + 1, lateral (select sqrt(list_dot_product(a.v, a.v)) a, sqrt(list_dot_product(b.v, b.v)) b) n""")
def neighbour_cosine(spark, sf):
    v = vectors(spark, sf)
    nxt = v.select((F.col("doc_id") - 1).alias("doc_id"), F.col("vector").alias("b"))
    return v.join(nxt, "doc_id").select(F.col("doc_id").alias("vec_id"), F.round(V.cosine(F.col("vector"), F.col("b")), 6).alias("cosine"))
