"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import aligned, clusters, mixing, mpeg, pieces, secrets, shards, simhash, tokens, topk, toxicity, urls, warc
from tessella.operators.layout import spread


KEYS = {"documents": "doc_id", "pages": "page_id", "embeddings": "vec_id"}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one of fewer partitions than cores is dealt to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(rows, KEYS[table]) if table in KEYS else rows


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.digests(_read(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sampling_plan(_read(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ids=False)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), path="source")
    return found.select("doc_id", "finding_no", F.length("cand").alias("length"), F.sha2("cand", 256).alias("cand_sha256"), "probability", "is_secret")


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(_read(spark, sf_dir, "embeddings"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned.alignment(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_warc, op4_mpeg, op5_topk, op6_mixing, op7_pieces, op8_urls, op9_tokens, op10_secrets, op11_clusters, op12_shards, op13_aligned)}


#: Base32 of a SHA-1: 32 groups of five bits.
OP3_SQL = """with p as (select page_id, coalesce(html, '') h from pages), g as (select h, max(page_id) m, count(*) n from p group by 1),
b as (select page_id, octet_length(encode(p.h)) payload_bytes, cast(unhex(sha1(p.h)) as bit)::varchar bits, n > 1 and m is not null and page_id is distinct from m revisit, m from p join g on p.h = g.h)
select page_id, cast(payload_bytes as bigint) payload_bytes, array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * cast(substr(bits, i + 1, 1) as int) + 8 * cast(substr(bits, i + 2, 1) as int)
 + 4 * cast(substr(bits, i + 3, 1) as int) + 2 * cast(substr(bits, i + 4, 1) as int) + cast(substr(bits, i + 5, 1) as int), 1)), '') payload_digest, case when revisit then 'revisit' else 'response' end record_type, case when revisit then m end refers_to from b"""

OP5_SQL = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) v from embeddings where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
select q.vec_id query_id, cast(row_number() over (partition by q.vec_id order by list_dot_product(q.v, c.v) desc, c.vec_id) as int) as "rank", c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) score from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id qualify "rank" <= 5"""


def _op11_sql(k: int = 16, rounds: int = 3) -> str:
    far = "list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))"
    parts = [
        "v as materialized (select row_number() over () r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as materialized (select cast(row_number() over (order by sha256('1:' || vec_id), v) - 1 as int) c, v from v where vec_id is not null qualify c < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} as materialized (select v.r, v.vec_id, v.v, c.c, {far} d from v cross join c{i} c qualify row_number() over (partition by v.r order by {far}, c.c) = 1)")
        if i < rounds:
            mean = "list(cast((s - ((s % n) + n) % n) // n as bigint) order by i)"  # floor of the mean
            parts.append(f"c{i + 1} as materialized (select o.c, coalesce(m.v, o.v) v from c{i} o left join (select c, {mean} v from (select c, i, sum(v[i]) s, count(*) n from a{i} cross join range(1, 65) t(i) group by c, i) group by c) m on o.c = m.c)")
    last = f"select vec_id, a.c as \"cluster\", cast(d as bigint) distance, cast(sum(d) over (partition by a.c) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia, sha256(array_to_string(z.v, ',')) centroid_sha256 from a{rounds} a join c{rounds} z on a.c = z.c"
    return f"with {', '.join(parts)} {last}"


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op5_topk": OP5_SQL, "op11_clusters": _op11_sql()}
