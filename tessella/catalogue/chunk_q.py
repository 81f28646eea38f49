"""Blocks and chunks: lines of documents as blocks of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.catalogue.base import Registry, read, read_spread
from tessella.functions import ids
from tessella.functions import vectors as V
from tessella.operators import chunking

query = Registry()

BLOCKS = """bl as (select doc_id paper_id, n // 6 + 1 page_number, n reading_order, line text, length(line) < 40 is_heading, [(n % 5) * 10.5::double, (n % 7) * 3.0::double, (n % 5) * 10.5::double + 40 + length(line) % 400, (n % 7) * 3.0::double + 12] bbox, 8 + (length(line) % 5) median_font_size
 from (select doc_id, unnest(ls) line, generate_subscripts(ls, 1) - 1 n from (select doc_id, string_split(text, chr(10)) ls from documents)) where line <> '')"""


def blocks(spark, sf):
    d = read_spread(spark, sf, "documents", "doc_id").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("n", "text")).where("text <> ''")
    n, size = F.col("n"), F.length("text")
    x, y = (n % 5) * F.lit(10.5), (n % 7) * F.lit(3.0)
    return d.select("paper_id", (F.floor(n / 6) + 1).alias("page_number"), n.cast("bigint").alias("reading_order"), "text", (size < 40).alias("is_heading"), F.array(x, y, x + 40 + size % 400, y + 12).alias("bbox"), (8 + size % 5).alias("median_font_size"))


@query(f"with {BLOCKS} select paper_id, page_number, reading_order, coalesce(last_value(case when is_heading then trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) end ignore nulls) over (partition by paper_id, page_number order by reading_order rows between unbounded preceding and current row), 'document') section from bl")
def sections_ffill(spark, sf):
    return chunking.with_section(blocks(spark, sf)).select("paper_id", "page_number", "reading_order", "section")


@query(f"with {BLOCKS} select paper_id, page_number, min(bbox[1]) x0, min(bbox[2]) y0, max(bbox[3]) x1, max(bbox[4]) y1 from bl group by all")
def bbox_union(spark, sf):
    return chunking.union_boxes(blocks(spark, sf), "paper_id", "page_number")


@query(f"with {BLOCKS} select paper_id, cast(median(median_font_size) as double) body_size from bl group by 1")
def body_font(spark, sf):
    return chunking.body_size(blocks(spark, sf))


@query(f"""with {BLOCKS}, pg as (select paper_id, count(distinct page_number) pages from bl group by 1), k as (select distinct paper_id, page_number, regexp_replace(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))), '\\d+', '#', 'g') text_key from bl where is_heading), c as (select paper_id, text_key, count(*) n from k group by all)
select paper_id, text_key, n from c join pg using (paper_id) where n >= greatest(3, round_even(pages * 0.3, 0))""")
def repeated_margins(spark, sf):
    return chunking.repeated_margins(blocks(spark, sf).withColumn("in_margin", F.col("is_heading")))


@query(f"""with {BLOCKS}, c as (select paper_id, page_number, reading_order ordinal, 'chunk-' || paper_id || '-' || reading_order chunk_id from bl) select chunk_id, lag(chunk_id) over w previous_chunk_id, lead(chunk_id) over w next_chunk_id from c window w as (partition by paper_id order by page_number, ordinal)""")
def chunk_links(spark, sf):
    c = blocks(spark, sf).select("paper_id", "page_number", F.col("reading_order").alias("ordinal"), F.concat(F.lit("chunk-"), F.col("paper_id").cast("string"), F.lit("-"), F.col("reading_order").cast("string")).alias("chunk_id"))
    return chunking.linked(c).select("chunk_id", "previous_chunk_id", "next_chunk_id")


@query()
def chunk_pack(spark, sf):
    """A fold over the blocks of a page; tested against a loop."""
    p = chunking.packed(blocks(spark, sf), 1200)
    value = F.concat_ws(":", F.col("paper_id").cast("string"), F.col("page_number").cast("string"), F.col("ordinal").cast("string"), F.sha2("text", 256))
    return p.select("paper_id", "page_number", "ordinal", ids.name_id("chunk", value).alias("chunk_id"), F.length("text").alias("char_count"))


@query()
def text_split(spark, sf):
    """A cut depends on the one before; tested by properties."""
    d = read(spark, sf, "documents").select("doc_id", F.posexplode(chunking.split_column(F.col("text"), 800)).alias("part_no", "part"))
    return d.select("doc_id", "part_no", F.length("part").alias("n_chars"))


@query("""with s as (select doc_id, text, unnest(range(1, greatest(1, length(text) - 200) + 1, 1300)) s from documents) select doc_id, cast(s as int) start, sha256(substr(text, s, 1500)) part_sha256 from s""")
def overlap_split(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.posexplode(chunking.overlapping(F.col("text"), 1500, 200)).alias("n", "part"))
    return d.select("doc_id", (1 + F.col("n") * 1300).cast("int").alias("start"), F.sha2("part", 256).alias("part_sha256"))


@query(f"""with {BLOCKS}, l as (select paper_id page_id, bbox[1] x0, bbox[2] y0, bbox[4] y1, 8.0::double font_size, reading_order from bl), s as (select *, case when lag(y1) over w is null or y0 - lag(y1) over w > 8.0 * 0.2::double then 1 else 0 end st from l window w as (partition by page_id order by y0, x0, reading_order)) select page_id, max(c) clusters from (select page_id, cast(sum(st) over (partition by page_id order by y0, x0, reading_order rows unbounded preceding) as bigint) c from s) group by 1""")
def title_clusters(spark, sf):
    b = blocks(spark, sf)
    lines = b.select(F.col("paper_id").alias("page_id"), F.struct(F.col("bbox")[0], "reading_order").alias("x0"), F.col("bbox")[1].alias("y0"), F.col("bbox")[3].alias("y1"), F.lit(8.0).alias("font_size"))
    return chunking.clustered(lines, 0.2).groupBy("page_id").agg(F.max("cluster").alias("clusters"))


@query(f"""with {BLOCKS}, o as (select paper_id doc_id, reading_order block_no, coalesce(sum(length(text) + 1) over (partition by paper_id order by reading_order rows between unbounded preceding and 1 preceding), 0) a, length(text) n from bl) select doc_id, block_no from o where a + n > 50 and a < 400""")
def span_overlap(spark, sf):
    b = blocks(spark, sf).select(F.col("paper_id").alias("doc_id"), F.col("reading_order").alias("block_no"), "text")
    m = read(spark, sf, "documents").select("doc_id", F.lit(50).alias("start"), F.lit(400).alias("stop"))
    return chunking.spans_overlapping(b, m)


@query(f"""with {BLOCKS} select paper_id, reading_order, case when bbox[3] - bbox[1] >= 300 * 0.68::double or (bbox[1] < 150 - 24 and bbox[3] > 150 + 24) then 'full' when bbox[3] <= 174 then 'left' when bbox[1] >= 126 then 'right' else 'full' end column_of, round(greatest(0, least(1, bbox[3] / 300)), 6) x1_share from bl""")
def block_geometry(spark, sf):
    b, w = blocks(spark, sf), F.lit(300.0)
    return b.select("paper_id", "reading_order", V.column_of(F.col("bbox"), w).alias("column_of"), V.normalized_box(F.col("bbox"), w, F.lit(400.0))[2].alias("x1_share"))


@query(f"with {BLOCKS} select paper_id, reading_order, abs(bbox[1] - 10) <= 5 and abs(bbox[2] - 4) <= 5 close from bl")
def bbox_close(spark, sf):
    b = blocks(spark, sf)
    return b.select("paper_id", "reading_order", V.boxes_close(F.slice("bbox", 1, 2), F.array(F.lit(10.0), F.lit(4.0)), 5.0).alias("close"))
