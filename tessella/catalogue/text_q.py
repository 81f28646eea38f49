"""Text functions and identifiers over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.catalogue.base import Registry, read, read_spread
from tessella.functions import ids
from tessella.functions import text as T
from tessella.functions import vectors as V

query = Registry()
FLAT = r"trim(regexp_replace(text, '[\s\x{A0}\x{85}\x{2028}\x{2029}\x{3000}\x0B\x1C-\x1F]+', ' ', 'g'))"


@query(f"with d as (select doc_id, {FLAT} t from documents) select doc_id, sha256(t) normalized_sha256, cast(length(t) as bigint) n from d")
def normalized_text(spark, sf):
    t = T.normalized(F.col("text"))
    return read_spread(spark, sf, "documents", "doc_id").select("doc_id", F.sha2(t, 256).alias("normalized_sha256"), F.length(t).cast("bigint").alias("n"))


@query("""with s as (select doc_id, 'source-' || substr(sha256('["' || 'doc:' || doc_id || '"]'), 1, 20) source_id, sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13))) h from documents)
select doc_id, source_id, 'evidence-' || substr(sha256('["' || source_id || '","' || h || '"]'), 1, 20) evidence_id, h content_sha256 from s""")
def evidence_ids(spark, sf):
    d = read_spread(spark, sf, "documents", "doc_id").withColumn("source_id", ids.content_id("source", F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))))
    return d.select("doc_id", "source_id", ids.evidence_id(F.col("source_id"), F.col("text")).alias("evidence_id"), ids.text_sha256(F.col("text")).alias("content_sha256"))


@query("""with h as (select doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('tessella:file:' || source || '/' || doc_id)) x from documents) select doc_id, 'file-' || substr(x, 1, 12) || '5' || substr(x, 14, 3) file_id from h""")
def name_ids(spark, sf):
    return read_spread(spark, sf, "documents", "doc_id").select("doc_id", ids.name_id("file", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))).alias("file_id"))


@query("select doc_id, 'gold-' || substr(sha256(encode('v1') || unhex('00') || encode(cast(doc_id as varchar))), 1, 16) gold_id, sha256(encode(source) || unhex('00') || encode('search') || unhex('00') || encode(cast(doc_id as varchar)) || unhex('00') || encode(sha256(text))) tool_id from documents")
def release_and_tool_ids(spark, sf):
    d = F.col("doc_id").cast("string")
    return read_spread(spark, sf, "documents", "doc_id").select("doc_id", ids.release_id("gold", F.lit("v1"), d).alias("gold_id"), ids.tool_evidence_id(F.col("source"), F.lit("search"), d, F.sha2("text", 256)).alias("tool_id"))


TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query(f"with t as (select unnest(list_distinct({TOK})) term from documents) select term, count(*) df from t group by 1")
def tokens_df(spark, sf):
    terms = read_spread(spark, sf, "documents", "doc_id").select(F.explode_outer(F.array_distinct(T.retrieval_tokens(F.col("text")))).alias("term"))
    return terms.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))


@query(f"select doc_id, cast(len({TOK}) as bigint) doc_length, cast(len(list_distinct({TOK})) as bigint) n_terms from documents")
def doc_lengths(spark, sf):
    t = read_spread(spark, sf, "documents", "doc_id").select("doc_id", T.retrieval_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("doc_length"), F.size(F.array_distinct("t")).cast("bigint").alias("n_terms"))


@query("""with d as (select doc_id, translate(text, 'aeiou', '异常检测图') t from documents), x as (select doc_id, regexp_extract_all(lower(t), '[a-z0-9]+|[一-鿿]') r from d),
y as (select doc_id, r, list_filter(list_transform(range(1, len(r)), lambda i: case when regexp_full_match(r[i], '[一-鿿]') and regexp_full_match(r[i + 1], '[一-鿿]') then r[i] || r[i + 1] end), lambda p: p is not null) b from x)
select doc_id, cast(len(r) + len(b) as bigint) n, sha256(array_to_string(list_concat(r, b), ' ')) digest from y""")
def cjk_bigrams(spark, sf):
    t = T.retrieval_tokens(F.translate("text", "aeiou", "异常检测图"))
    return read_spread(spark, sf, "documents", "doc_id").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


@query(r"""with s as (select doc_id, unnest(string_split(regexp_replace(text, '([.!?。！？])[\s\x{A0}\x{85}\x{2028}\x{2029}\x{3000}\x0B]+', '\1' || chr(31), 'g'), chr(31))) s from documents) select doc_id, count(*) n_sentences, cast(max(length(s)) as bigint) longest from s where trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> '' group by 1""")
def sentence_counts(spark, sf):
    s = read_spread(spark, sf, "documents", "doc_id").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("s")).cast("bigint").alias("longest"))


STOP = "['" + "','".join(T.VERIFIER_STOPWORDS) + "']"
VT = rf"list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]+(?:[-''][a-z]+)*|\p{{Nd}}+(?:\.\p{{Nd}}+)?%?|[一-鿿]')), lambda w: not list_contains({STOP}, w))"


@query(f"select doc_id, cast(len({VT}) as bigint) n, sha256(array_to_string(list_sort({VT}), ' ')) digest from documents")
def verifier_tokens(spark, sf):
    t = T.verifier_tokens(F.col("text"))
    return read_spread(spark, sf, "documents", "doc_id").select("doc_id", F.size(t).cast("bigint").alias("n"), F.sha2(F.array_join(F.array_sort(t), " "), 256).alias("digest"))


NEG = r"(?i)\b(?:no|not|never|neither|without|failed?|cannot|can''t|didn''t|doesn''t|isn''t|wasn''t|weren''t)\b|(?:不|未|无|没有|并非|不能|失败)"


@query(rf"select item_id, cast(len(regexp_extract_all(text, '\d+%')) as bigint) percents, regexp_matches(text || case when item_id % 3 = 0 then ' It did not work.' else '' end, '{NEG}') negated from benchmark")
def percent_and_polarity(spark, sf):
    b = read(spark, sf, "benchmark")
    t = F.concat("text", F.when(F.col("item_id") % 3 == 0, " It did not work.").otherwise(""))
    return b.select(F.col("item_id"), F.size(F.filter(F.regexp_extract_all("text", F.lit(T.NUMBER), F.lit(0)), lambda x: F.endswith(x, F.lit("%")))).cast("bigint").alias("percents"), T.negated(t).alias("negated"))


@query(r"with p as (select page_id, list_distinct(list_transform(regexp_extract_all(url || ' see (' || url || '), and https://a.example/x. ' || url || '!', 'https?://[^\s<>()\[\]{}""'']+'), lambda u: regexp_replace(u, '[.,;:!?，。；：！？]+$', ''))) u from pages) select page_id, cast(len(u) as bigint) n, array_to_string(list_sort(u), ' ') urls from p".replace('""', '"'))
def url_extract(spark, sf):
    p = read_spread(spark, sf, "pages", "page_id")
    t = F.concat("url", F.lit(" see ("), "url", F.lit("), and https://a.example/x. "), "url", F.lit("!"))
    return p.select("page_id", F.size(T.urls(t)).cast("bigint").alias("n"), F.array_join(F.array_sort(T.urls(t)), " ").alias("urls"))


@query(r"""with p as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), chr(0), '', 'g') t from pages)
select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g')) page_text from p""")
def page_text(spark, sf):
    return read_spread(spark, sf, "pages", "page_id").select("page_id", T.page_text(F.col("html")).alias("page_text"))


@query(r"""with s as (select doc_id, regexp_replace(substr(case when doc_id % 9 = 0 then translate(text, 'e', '异') when doc_id % 50 = 1 then '  ' else text end, 1, 20000), '[\s\x{A0}\x{85}\x{2028}\x{2029}\x{3000}\x0B]+', '', 'g') s from documents)
select doc_id, case when s = '' then 'unknown' when len(regexp_extract_all(s, '[一-鿿]')) / length(s) >= 0.05 then 'zh' else 'en' end as "language" from s""")
def language_detect(spark, sf):
    t = F.when(F.col("doc_id") % 9 == 0, F.translate("text", "e", "异")).when(F.col("doc_id") % 50 == 1, "  ").otherwise(F.col("text"))
    return read_spread(spark, sf, "documents", "doc_id").select("doc_id", T.language(t).alias("language"))


@query("select doc_id, cast(greatest(1, round_even(length(text) / 4.0, 0)) as int) tokens, case when length(text) > 400 then substr(text, 1, 400) || '... [truncated]' else text end capped, regexp_replace(source || '/a b?' || lang, '[^a-zA-Z0-9._-]+', '-', 'g') file_name from documents")
def token_estimate_and_caps(spark, sf):
    from tessella.operators import web

    return read_spread(spark, sf, "documents", "doc_id").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), web.capped(F.col("text"), 100).alias("capped"), T.safe_file_name(F.concat("source", F.lit("/a b?"), "lang")).alias("file_name"))


@query("""with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings), n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) s from v)
select vec_id, round(s, 6) norm, round(case when s > 0 then v[1] / s else v[1] end, 6) first_component, len(v) > 0 valid from n""")
def l2_normalize(spark, sf):
    e = read(spark, sf, "embeddings")
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.l2_normalized(F.col("embedding"))[0], 6).alias("first_component"), V.valid_vector(F.col("embedding")).alias("valid"))


@query()
def hashing_embedder(spark, sf):
    """BLAKE2b has no SQL form."""
    d = read_spread(spark, sf, "documents", "doc_id").select("doc_id", V.hashing_embedding(T.retrieval_tokens(F.col("text")), 16).alias("v"))
    return d.select("doc_id", F.round(F.col("v")[0], 6).alias("v0"), F.round(V.norm(F.col("v")), 6).alias("norm"))


@query()
def informative_sentences(spark, sf):
    """The rule needs look-behind and Unicode classes that DuckDB's expressions lack."""
    return read_spread(spark, sf, "documents", "doc_id").select("doc_id", T.best_sentence(F.col("text"), F.lit("which method detects the thing")).alias("best"))


@query("""with m as (select conv_id, turn, text || case when turn % 2 = 0 then chr(0) else '' end t from conversations) select conv_id, turn, cast(length(t) - length(replace(t, chr(0), '')) as bigint) removed, replace(t, chr(0), '') cleaned from m""")
def control_cleanup(spark, sf):
    t = F.concat("text", F.when(F.col("turn") % 2 == 0, F.char(F.lit(0))).otherwise(""))
    return read(spark, sf, "conversations").select("conv_id", "turn", (F.length(t) - F.length(T.without_nul(t))).cast("bigint").alias("removed"), T.without_nul(t).alias("cleaned"))
