"""The rules between the tables of a dataset, over documents in their roles with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.catalogue.base import Registry, read
from tessella.functions import ids
from tessella.operators import dataset_rules as R
from tessella.operators import gold, pages, schema

query = Registry()
def docs(spark, sf):
    return read(spark, sf, "documents")


def named(prefix, number):
    return F.concat(F.lit(prefix), number.cast("string"))


def told(cases: dict[str, str], table: str, key: str) -> str:
    """SQL for (rule, key) of each rule's condition over one table."""
    return " union all ".join(f"""select '{rule}' as "rule", {key} as "key" from {table} where {bad}""" for rule, bad in cases.items())


@query("with d as (select doc_id i, doc_id % 5 = 1 dup, (doc_id % 5 <> 1 and doc_id % 11 <> 0) or doc_id % 25 = 1 there from documents) " + told({"canonical_is_duplicate": "there and dup", "canonical_missing": "not dup and not there", "canonical_extra": "there and dup", "canonical_differs": "there and i % 13 = 0"}, "d", "'f' || i"))
def canonical_rules(spark, sf):
    i = F.col("doc_id")
    manifest = docs(spark, sf).select(named("f", i).alias("file_id"), (i % 5 == 1).alias("is_exact_duplicate"), "n_chars", "source", "doc_id")
    there = manifest.where(((i % 5 != 1) & (i % 11 != 0)) | (i % 25 == 1)).withColumn("n_chars", F.when(i % 13 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return R.canonical_rules(manifest, there)


GROUPS = """d as (select doc_id i, sha256(text) h, 'x/' || doc_id p, row_number() over (partition by text order by doc_id) n, first_value(doc_id) over (partition by text order by doc_id) f, count(*) over (partition by text) c from documents),
e as (select *, n > 1 and i % 9 <> 0 dup from d), g as (select h, count(*) c, count(*) filter (not dup) firsts, min(i) f from e group by 1), many as (select *, f % 4 <> 0 listed from g where c > 1),
m as (select e.*, g.firsts from e join g using (h) where firsts = 1)"""


@query(f"""with {GROUPS}, """ + "r as (select i, n, f, 'f' || (f + case when i % 8 = 3 then 1 else 0 end) duplicate_of, i % 7 = 2 lost from m) "
       + """select 'canonical_points_nowhere' as "rule", 'f' || i as "key" from r where n = 1 and i % 6 = 1 union all select 'canonical_path', 'f' || i from r where lost union all select 'duplicate_follows', 'f' || i from r where n > 1 and i % 8 = 3
 union all select 'duplicate_work_id', 'f' || i from r where n > 1 and i % 10 <> f % 10 union all select 'one_canonical', h from g where firsts <> 1 union all select 'group_missing', h from many where not listed union all select 'group_paper', h from many where listed and firsts = 1 and f % 6 = 5
 union all select 'alias_missing', e.h || ' ' || e.p from e join many using (h) where not listed or i % 12 = 1 union all select 'alias_extra', h || ' y' from many where listed and f % 10 = 3""")  # fmt: skip
def duplicate_group_rules(spark, sf):
    """Files of equal texts; every ninth later copy claims to be canonical, groups of some first files are missing or wrong."""
    i = F.col("doc_id")
    from pyspark.sql import Window

    d = docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("sha256"))
    w = Window.partitionBy("sha256").orderBy("doc_id")
    d = d.withColumn("n", F.row_number().over(w)).withColumn("first", F.first("doc_id").over(w))
    path = lambda c: named("x/", c)
    dup = (F.col("n") > 1) & (i % 9 != 0)
    manifest = d.select(
        named("f", i).alias("file_id"), "sha256", path(i).alias("relative_path"), F.when(i % 7 == 2, "lost").otherwise(path(F.col("first"))).alias("canonical_relative_path"), named("p", F.col("first")).alias("paper_id"), dup.alias("is_exact_duplicate"),
        F.when(dup, named("f", F.col("first") + F.when(i % 8 == 3, 1).otherwise(0))).when(i % 6 == 1, "f0").alias("duplicate_of_file_id"), F.when(dup, "skip_exact_duplicate").otherwise("primary").alias("index_policy"), (~dup).alias("indexable"),
        (i % 10).alias("work_id"), F.lit("development").alias("dataset_split"), F.lit(True).alias("tuning_allowed"),
    )
    groups = d.groupBy("sha256").agg(F.count("*").alias("c"), F.min("doc_id").alias("f"), F.collect_list(F.when(i % 12 != 1, path(i))).alias("aliases")).where("c > 1 and f % 4 <> 0")
    aliases = F.array_sort(F.concat("aliases", F.when(F.col("f") % 10 == 3, F.array(F.lit("y"))).otherwise(F.array().cast("array<string>"))))
    return R.duplicate_group_rules(manifest, groups.select("sha256", F.when(F.col("f") % 6 == 5, "p").otherwise(named("p", F.col("f"))).alias("paper_id"), path(F.col("f")).alias("canonical_relative_path"), aliases.alias("aliases")))


@query("with d as (select doc_id i, doc_id % 5 <> 1 canon, (doc_id % 5 <> 1 and doc_id % 17 <> 0) or doc_id % 35 = 1 doc from documents) " + told({
    "document_missing": "canon and not doc", "document_extra": "doc and not canon", "document_name": "doc and i % 19 = 0", "chunk_without_document": "canon and not doc", "chunk_count": "doc and (not canon or i % 23 = 0)",
    "document_max_chunk_chars": "doc and i % 29 = 0", "document_work_id": "doc and canon and i % 31 = 0", "document_indexable": "doc and canon and i % 37 = 0"}, "d", "'p' || i"))
def document_rules(spark, sf):
    i = F.col("doc_id")
    own = lambda df: df.select(named("p", i).alias("paper_id"), (i % 10).alias("work_id"), F.when(i % 3 == 0, "test").otherwise("development").alias("dataset_split"), (i % 3 != 0).alias("tuning_allowed"), (i % 4 != 0).alias("indexable"), F.lit("primary").alias("index_policy"), "doc_id")
    d = docs(spark, sf).select("doc_id")
    rows = own(d.where(((i % 5 != 1) & (i % 17 != 0)) | (i % 35 == 1)))
    documents = rows.select(
        "paper_id", (F.col("work_id") + F.when(i % 31 == 0, 1).otherwise(0)).alias("work_id"), "dataset_split", "tuning_allowed", F.when(i % 37 == 0, ~F.col("indexable")).otherwise(F.col("indexable")).alias("indexable"), "index_policy",
        F.when(i % 19 == 0, "x.json").otherwise(F.concat("paper_id", F.lit(".json"))).alias("filename"), (i % 4 + 1 + F.when(i % 23 == 0, 1).otherwise(0)).alias("chunk_count"), F.when(i % 29 == 0, 1000).otherwise(1200).alias("max_chunk_chars"),
    )
    chunks = d.where("doc_id % 5 <> 1").select(named("p", i).alias("paper_id"), F.explode(F.sequence(F.lit(0), i % 4)).alias("n"))
    return R.document_rules(documents, own(d.where("doc_id % 5 <> 1")), chunks, 1200)


WORKS = """m as (select doc_id % 97 w, case when doc_id % 50 = 7 then 'other' when doc_id % 97 % 4 = 0 then 'test' else 'development' end s, (doc_id % 97 % 4 > 0) = (doc_id % 60 <> 11) t from documents), o as (select w, min(s) lo, max(s) hi, bool_and(t) t0, bool_or(t) t1, min(s) = 'test' and max(s) = 'test' held from m group by 1),
wk as (select w, w % 4 = 0 test, w % 8 = 0 or w % 4 > 0 tuned from o where w % 13 <> 5 union all select w + 1000, false, false from o where w % 20 = 3), pp as (select w from o where (w % 4 = 0 and w % 12 > 0) or w % 16 = 5)"""


@query(f"""with {WORKS} select 'work_missing' as "rule", cast(w as varchar) as "key" from o where w not in (select w from wk) union all select 'work_extra', cast(w as varchar) from wk where w not in (select w from o) union all select 'one_split', cast(w as varchar) from o where lo <> hi
 union all select 'one_tuning_flag', cast(w as varchar) from o where t0 <> t1 union all select 'test_work_tuned', cast(w as varchar) from wk where test and tuned union all select 'held_out_without_paper', cast(w as varchar) from o where held and w not in (select w from pp) union all select 'paper_of_other_work', cast(w as varchar) from pp join o using (w) where not held""")
def work_rules(spark, sf):
    i = F.col("doc_id")
    w = F.col("work_id")
    d = docs(spark, sf).select("doc_id", (i % 97).alias("work_id"))
    manifest = d.select("work_id", F.when(i % 50 == 7, "other").when(w % 4 == 0, "test").otherwise("development").alias("dataset_split"), ((w % 4 > 0) == (i % 60 != 11)).alias("tuning_allowed"))
    ids = d.select("work_id").distinct()
    works = ids.where("work_id % 13 <> 5").select("work_id", F.when(w % 4 == 0, "test").otherwise("development").alias("dataset_split"), ((w % 8 == 0) | (w % 4 > 0)).alias("tuning_allowed"))
    works = works.unionByName(ids.where("work_id % 20 = 3").select((w + 1000).alias("work_id"), F.lit("development").alias("dataset_split"), F.lit(False).alias("tuning_allowed")))
    return R.work_rules(works, manifest, ids.where(((w % 4 == 0) & (w % 12 > 0)) | (w % 16 == 5)))


@query("with d as (select doc_id i from documents where doc_id % 3 = 0) " + told({"paper_unique": "i % 27 = 0", "paper_is_test_record": "i % 6 = 0 or i % 9 = 0 or i % 7 = 0", "paper_labelled_test": "i % 15 = 0", "paper_not_tuned": "i % 21 = 0"}, "d", "'p' || i"))
def paper_rules(spark, sf):
    i = F.col("doc_id")
    d = docs(spark, sf).select("doc_id")
    own = d.where("doc_id % 3 = 0").select(named("p", i).alias("paper_id"), (i % 10 + F.when(i % 9 == 0, 1).otherwise(0)).alias("work_id"), F.when(i % 15 == 0, "dev").otherwise("test").alias("split"), (i % 21 == 0).alias("tuning_allowed"), "doc_id")
    canonical = d.where("doc_id % 6 <> 0").select(named("p", i).alias("paper_id"), (i % 10).alias("work_id"), F.when(i % 7 == 0, "development").otherwise("test").alias("dataset_split"))
    return R.paper_rules(own.unionByName(own.where("doc_id % 27 = 0")).drop("doc_id"), canonical)


@query("""with d as (select doc_id i, doc_id % 3 = 0 test, doc_id % 4 <> 0 idx from documents), e as (select *, (not test and idx and i % 11 <> 0) or (not idx and i % 7 = 0) dev, (test and idx) or i % 26 = 1 ev from d) """ + told({
    "development_missing": "not test and idx and not dev", "development_extra": "dev and (test or not idx)", "development_differs": "dev and i % 13 = 0", "development_isolated": "dev and (test or not idx)", "partitions_overlap": "dev and ev",
    "evaluation_extra": "ev and (not test or not idx)", "evaluation_differs": "ev and i % 9 = 0", "evaluation_isolated": "ev and (not test or not idx or i % 9 = 0)"}, "e", "cast(i as varchar)"))
def partition_rules(spark, sf):
    i = F.col("doc_id")
    test, idx = i % 3 == 0, i % 4 != 0
    chunks = docs(spark, sf).select(i.alias("chunk_id"), "text", F.when(test, "test").otherwise("development").alias("dataset_split"), (~test).alias("tuning_allowed"), idx.alias("indexable"))
    c = F.col("chunk_id")
    own = chunks.withColumn("doc_id", c)
    dev = own.where((~test & idx & (i % 11 != 0)) | (~idx & (i % 7 == 0))).withColumn("text", F.when(i % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    ev = own.where((test & idx) | (i % 26 == 1)).withColumn("tuning_allowed", F.col("tuning_allowed") | (i % 9 == 0))
    return R.partition_rules(chunks, dev, ev)


@query("""with d as (select bool_and(n_chars > 0) ok, max(n_chars) n from documents) select 'source_integrity_verified' as "rule", 'summary' as "key" from d union all select 'source_integrity_verified', 'config' from d where not ok union all select 'max_chunk_chars', 'config' from d where n < 400""")
def flag_rules(spark, sf):
    facts = docs(spark, sf).agg(F.bool_and(F.col("n_chars") > 0).alias("source_integrity_verified"), F.max("n_chars").alias("max_chunk_chars"))
    return R.flag_rules(facts, facts.where("max_chunk_chars < 0"))


#: What a conversation must be; the turns are checked one by one.
CONVERSATION = {
    "type": "object", "required": ["conv", "turns"], "additionalProperties": False, "$defs": {"turn": {"type": "object", "required": ["role", "text"], "properties": {"role": {"enum": ["user", "assistant"]}, "text": {"type": "string", "minLength": 40, "pattern": "[.!?]"}, "n": {"type": "integer", "maximum": 4}}}},
    "properties": {"conv": {"oneOf": [{"type": "integer", "multipleOf": 2}, {"type": "integer", "minimum": 50}]}, "turns": {"type": "array", "minItems": 2, "maxItems": 6, "items": {"$ref": "#/$defs/turn"}}},
}


@query("""with t as (select conv_id, role, text, turn, row_number() over (partition by conv_id order by turn, role, text) - 1 i from conversations), c as (select conv_id, count(*) n from t group by 1), p as (select *, '$.turns[' || i || ']' path from t)
select cast(conv_id as varchar) as "key", path || '.role' path, 'enum' keyword from p where role not in ('user', 'assistant') union all select cast(conv_id as varchar), path || '.text', 'minLength' from p where length(text) < 40 union all select cast(conv_id as varchar), path || '.text', 'pattern' from p where not regexp_matches(text, '[.!?]')
 union all select cast(conv_id as varchar), path || '.n', 'maximum' from p where turn > 4 union all select cast(conv_id as varchar), '$.turns', 'minItems' from c where n < 2 union all select cast(conv_id as varchar), '$.turns', 'maxItems' from c where n > 6 union all select cast(conv_id as varchar), '$.conv', 'oneOf' from c where (conv_id % 2 = 0) = (conv_id >= 50)""")
def schema_violations(spark, sf):
    """Conversations as JSON documents, held against a schema with references, choices and arrays."""
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    turns = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["turn"].alias("n")))
    return schema.checked(c.select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("conv"), turns.alias("turns"))).alias("j")), "conv_id", "j", CONVERSATION)


@query("""with d as (select doc_id i, doc_id % 6 deep, '$' || repeat('.a', cast(doc_id % 6 as int)) place, case when doc_id % 4 = 0 then '/data/' else 'data/' end || source p from documents)
select cast(i as varchar) as "key", place || '.file_path' path, p as "text" from d where p like '/%' union all select cast(i as varchar), place || '.aliases[1].root', 'C:/' || i from d where i % 9 = 0""")
def absolute_paths_nested(spark, sf):
    """Paths in JSON documents whose depth differs from row to row."""
    i = F.col("doc_id")
    deep = (i % 6).cast("int")
    inner = F.to_json(F.struct(F.concat(F.when(i % 4 == 0, "/data/").otherwise("data/"), "source").alias("file_path"), F.lit("/not a path field").alias("text"), F.array(F.struct(F.lit("x").alias("root")), F.struct(F.when(i % 9 == 0, named("C:/", i)).otherwise("y").alias("root"))).alias("aliases")))
    rows = docs(spark, sf).select("doc_id", F.concat(F.repeat(F.lit('{"a":'), deep), inner, F.repeat(F.lit("}"), deep)).alias("j"))
    return schema.absolute_paths(rows, "doc_id", "j")


@query(r"""with b as (select item_id i, cast(item_id as varchar) q, trim(regexp_replace(text, '\s+', ' ', 'g')) t, 'part two of ' || item_id p2, case item_id % 4 when 2 then 'edit' when 3 then 'reject' else 'keep' end d from benchmark),
e as (select *, d = 'keep' and i % 11 = 5 lost, array_to_string(list_filter([case when i % 17 = 4 then 'annotation_id' end, case when i % 13 <> 6 and i % 7 = 3 then 'recheck_gap' end, case when i % 13 = 6 then 'other_reviewer' end, case when d = 'keep' and i % 11 = 5 then 'unknown_blocks' end,
 case when d = 'keep' and i % 11 <> 5 and i % 5 = 2 then 'answer_extractive' end], lambda x: x is not null), ',') errors from b)
select q question_id, d decision, errors, case when errors = '' and d <> 'reject' then 'gold-' || substr(sha256(encode('v1') || unhex('00') || encode(q)), 1, 16) end gold_question_id, case when errors = '' and d = 'keep' then t || ' ' || p2 when errors = '' and d = 'edit' then p2 end answer,
 case when errors = '' and d = 'keep' then 'b1,b2' when errors = '' and d = 'edit' then 'b2' end block_ids, case when errors = '' and d <> 'reject' then case when d = 'keep' then 0.1::double else 0.2::double end end "left" from e""")
def gold_built(spark, sf):
    """Benchmark items as reviewed questions, some with tampered answers, blocks, times and ids; what is sound becomes gold, with evidence from its blocks."""
    i, q = F.col("item_id"), F.col("item_id").cast("string")
    b = read(spark, sf, "benchmark").select("item_id", "text")
    second = named("part two of ", i)
    page = lambda n, o, t, x: F.struct(F.lit(f"b{n}").alias("block_id"), F.lit(o).alias("reading_order"), t.alias("text"), F.array(F.lit(x), F.lit(10.0), F.lit(90.0), F.lit(20.0)).alias("bbox"))
    blocks = b.select(named("p", i).alias("paper_id"), (i % 50).cast("string").alias("work_id"), F.lit(1).alias("page_number"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"), F.explode(F.array(page(2, 2, second, 20.0), page(1, 1, F.col("text"), 10.0))).alias("x")).select("*", "x.*").drop("x")
    evidence = lambda text, of: F.struct(F.lit(None).cast("int").alias("page_number"), text.alias("text"), of.alias("block_ids"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(None).cast("array<double>").alias("bbox_normalized_top_left"))
    both = F.concat_ws(" ", "text", second)
    questions = b.select(q.alias("question_id"), named("p", i).alias("paper_id"), (i % 50).cast("string").alias("work_id"), F.lit("abstract").alias("question_type"), F.lit("Q").alias("question"), F.when(i % 5 == 2, "no such answer").otherwise(both).alias("answer"), evidence(both, F.array(F.lit("b1"), F.when(i % 11 == 5, "b9").otherwise("b2"))).alias("evidence"))
    d = F.when(i % 4 == 2, "edit").when(i % 4 == 3, "reject").otherwise("keep")
    none, nothing = F.lit(None).cast("string"), F.array().cast("array<string>")
    empty = F.struct(none.alias("question_type"), none.alias("question"), none.alias("answer"), nothing.alias("acceptable_answers"), evidence(none, nothing).alias("evidence"))
    edit = F.struct(F.lit("abstract").alias("question_type"), F.lit("Q2").alias("question"), second.alias("answer"), nothing.alias("acceptable_answers"), evidence(second, F.array(F.lit("b2"))).alias("evidence"))
    revision = F.when(d == "edit", edit).otherwise(empty)

    def one(at):
        return F.struct(F.lit("ann").alias("reviewer_alias"), at.alias("reviewed_at_utc"), d.alias("decision"), F.lit("high").alias("confidence"), F.array(d == "keep").alias("checks"), F.when(d == "keep", nothing).otherwise(F.array(F.lit("OTHER"))).alias("issue_codes"), F.when(d != "keep", "noted").alias("notes"), revision.alias("proposed_revision"))

    source = F.struct(F.lit("r1").alias("dataset_release"), q.alias("question_id"), named("p", i).alias("paper_id"), (i % 50).cast("string").alias("work_id"), F.lit("s").alias("questions_silver_file_sha256"), F.lit("c").alias("source_checksums_file_sha256"))
    end = F.struct(F.lit("not_required").alias("status"), d.alias("final_decision"), F.when(d == "keep", "silver").when(d == "edit", "final_revision").otherwise("none").alias("final_payload_source"), F.lit("2026-02-01T00:00:00Z").alias("resolved_at_utc"), revision.alias("final_revision"), none.alias("resolver_alias"), none.alias("rationale"))
    export = F.struct(F.lit(False).alias("eligible"), *(none.alias(c) for c in ("gold_question_id", "label_quality", "review_status", "derivation")))
    reviews = b.select(
        q.alias("question_id"), ids.release_id("annotation", F.when(i % 17 == 4, "r0").otherwise("r1"), q).alias("annotation_record_id"), source.alias("source"), F.when(i % 13 == 6, gold.INDEPENDENT).otherwise(gold.SINGLE).alias("review_protocol"), F.lit("resolved").alias("record_status"),
        one(F.lit("2026-01-01T00:00:00Z")).alias("round_1"), one(F.when(i % 7 == 3, "2026-01-01T23:59:59Z").otherwise("2026-01-02T00:00:00Z")).alias("round_2"), end.alias("resolution"), export.alias("gold_export"),
    )
    out = gold.built(reviews, questions, blocks, "r1", "v1", "s", "c")
    return out.select("question_id", "decision", F.array_join("errors", ",").alias("errors"), "gold.gold_question_id", "gold.answer", F.array_join("gold.evidence.block_ids", ",").alias("block_ids"), F.col("gold.evidence.bbox_normalized_top_left")[0].alias("left"))


@query()
def page_markdown(spark, sf):
    """Every page as Markdown; SQL has no stack of tags."""
    return pages.markdown(read(spark, sf, "pages"), "page_id", "html")


@query("""select page_id, case when page_id % 11 = 3 then 'Error fetching URL: timed out' when page_id % 7 = 2 then 'Error: Received status code 404' else 'Content type: ' || case when page_id % 5 = 1 then 'application/pdf' else '' end || ' (not converted to markdown)' end as "content"
 from pages where page_id % 11 = 3 or page_id % 7 = 2 or page_id % 5 in (1, 4)""")
def page_placeholders(spark, sf):
    """What stands in place of pages that failed or are no HTML."""
    i = F.col("page_id")
    rows = read(spark, sf, "pages").select("page_id", F.when(i % 7 == 2, 404).otherwise(200).alias("status"), F.when(i % 5 == 1, "application/pdf").when(i % 5 != 4, "text/html; charset=utf-8").alias("content_type"), F.when(i % 11 == 3, "timed out").alias("error"), F.col("html").alias("body"))
    return pages.fetched(rows, "page_id").where((i % 11 == 3) | (i % 7 == 2) | (i % 5).isin(1, 4)).select("page_id", "content")
