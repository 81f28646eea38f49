"""Corpus preparation over documents in the role of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.catalogue.base import CANON, FILES, POLICY, Registry, files, read
from tessella.operators import corpus as C

query = Registry()


def records(spark, sf):
    return C.index_policies(C.canonical(files(spark, sf)).where("not is_exact_duplicate"))


@query(f"""with {CANON}, g as (select sha256, count(*) n, min(canonical_path) canonical_path, list_sort(list(relative_path)) paths from marked group by 1 having count(*) > 1)
select sha256, n, canonical_path, array_to_string(list_filter(paths, lambda p: p <> canonical_path), '|') aliases from g""")
def exact_dup_groups(spark, sf):
    return C.duplicate_groups(files(spark, sf)).withColumn("aliases", F.array_join("aliases", "|"))


@query(f"with {CANON} select sha256, canonical_path, relative_path alias from marked where is_exact_duplicate")
def exact_dup_members(spark, sf):
    return C.duplicate_members(files(spark, sf))


@query(f"with {CANON} select doc_id, canonical_path, is_exact_duplicate, case when is_exact_duplicate then canonical_id end duplicate_of from marked")
def canonical_docs(spark, sf):
    return C.canonical(files(spark, sf)).select("doc_id", "canonical_path", "is_exact_duplicate", "duplicate_of")


@query(f"with {POLICY} select paper_id, index_policy, indexable, translation_of, variant_of from records")
def index_policy(spark, sf):
    return records(spark, sf).select("paper_id", "index_policy", "indexable", "translation_of", "variant_of")


@query(f"""with {POLICY} select work_id, count(*) n_files, count(distinct sha256) n_contents, array_to_string(list_sort(list(distinct paper_id)), ',') papers, array_to_string(list_sort(list(distinct "language")), ',') languages,
 coalesce(array_to_string(list_sort(list(distinct paper_id) filter (indexable)), ','), '') indexable_papers from records group by 1""")
def works_rollup(spark, sf):
    w = C.works(records(spark, sf))
    return w.select("work_id", "n_files", "n_contents", *(F.array_join(c, ",").alias(c) for c in ("papers", "languages", "indexable_papers")))


@query(f"""with {POLICY}, f as (select m.*, coalesce(r.indexable, false) indexable from marked m left join records r using (file_id))
select count(*) n_files, count(*) filter (is_exact_duplicate) n_duplicates, count(distinct sha256) n_contents, count(distinct work_id) n_works, count(*) filter (indexable) n_indexable, count(*) filter (document_type = 'translation') n_translations,
 cast(sum(pages) as bigint) n_pages, count(distinct "language") n_languages from f""")
def corpus_summary(spark, sf):
    f = C.canonical(files(spark, sf)).join(records(spark, sf).select("file_id", "indexable"), "file_id", "left")
    return C.summary(f)


MANIFEST = POLICY + """,
man as (select m.*, r.index_policy, r.indexable, r.translation_of, printf('doc %08d', m.doc_id) title, 2000 + m.doc_id % 25 as "year", case when m.doc_id % 97 % 5 = 0 then 'test' else 'development' end dataset_split, m.doc_id % 97 % 5 <> 0 tuning_allowed from marked m left join records r using (file_id)),
best as (select * from man where not is_exact_duplicate qualify row_number() over (partition by work_id order by case when index_policy in ('primary', 'primary_translation_only') then 0 else 1 end, p1, p2, relative_path, file_id) = 1)"""
OWN = "not is_exact_duplicate"


def manifest(spark, sf):
    """All files with their policies, titles and splits; a fifth of the works is for tests."""
    f = C.canonical(files(spark, sf))
    policies = C.index_policies(f.where("not is_exact_duplicate")).select("file_id", "index_policy", "indexable", "translation_of")
    test = F.col("doc_id") % 97 % 5 == 0
    split = F.when(test, "test").otherwise("development")
    return f.join(policies, "file_id", "left").withColumns({"title": C.clean_title(F.col("relative_path")), "year": 2000 + F.col("doc_id") % 25, "dataset_split": split, "tuning_allowed": ~test})


def listed(column: str, where: str = "true") -> str:
    """SQL for the sorted set of a column as one text."""
    return f"coalesce(array_to_string(list_sort(list(distinct {column}) filter ({where})), ','), '')"


@query(f"""with {MANIFEST}, w as (select work_id, count(*) source_file_count, count(distinct paper_id) filter ({OWN}) unique_content_count, {listed('"language"')} languages, {listed('paper_id', OWN + " and document_type = 'original'")} original_paper_ids,
 {listed('paper_id', OWN + " and document_type = 'translation'")} translation_paper_ids, {listed('paper_id', OWN + ' and indexable')} indexable_paper_ids, {listed('file_id')} source_file_ids from man group by 1)
select w.*, title, category, "year", paper_id primary_paper_id, dataset_split, tuning_allowed from w left join best using (work_id)""")
def work_records(spark, sf):
    w = C.work_records(manifest(spark, sf))
    return w.withColumns({c: F.array_join(c, ",") for c in ("languages", "original_paper_ids", "translation_paper_ids", "indexable_paper_ids", "source_file_ids")})


@query(f"""with {MANIFEST} select distinct work_id, 'languages' kind, "language" as "member" from man union all select distinct work_id, document_type || '_paper_ids', paper_id from man where {OWN}
 union all select distinct work_id, 'indexable_paper_ids', paper_id from man where {OWN} and indexable union all select distinct work_id, 'source_file_ids', file_id from man""")
def work_members(spark, sf):
    return C.work_members(manifest(spark, sf))


def told(name: str, rows: str, value: str) -> str:
    """SQL for the one row of a histogram as text."""
    return f"(select string_agg({value} || '=' || n, ',' order by {value}) from (select {value}, count(*) n from {rows} group by 1)) {name}"


@query(f"""with {MANIFEST}, ch as (select case when doc_id % 97 % 5 = 0 then 'test' else 'development' end dataset_split, doc_id % 3 <> 0 indexable from documents)
select count(*) source_pdf_count, cast(sum(pages) as bigint) source_total_pages, count(*) filter ({OWN}) canonical_pdf_count, cast(sum(pages) filter ({OWN}) as bigint) canonical_total_pages, count(distinct work_id) logical_work_count, count(*) filter ({OWN} and indexable) indexable_content_count,
 count(*) filter ({OWN} and index_policy = 'skip_semantic_variant') semantic_variant_content_count, count(distinct work_id) filter ({OWN} and index_policy = 'skip_semantic_variant') semantic_variant_work_count, count(*) filter (is_exact_duplicate) exact_duplicate_file_count,
 (select count(*) from (select sha256 from man group by 1 having count(*) > 1)) exact_duplicate_group_count, count(*) filter (document_type = 'translation') translation_file_count, count(*) filter ({OWN} and document_type = 'translation') canonical_translation_content_count,
 count(*) filter ({OWN} and translation_of is not null) linked_translation_content_count, count(distinct work_id) filter ({OWN} and translation_of is not null) linked_translation_work_count,
 (select count(*) from ch) chunk_count, (select count(*) from ch where dataset_split = 'development') development_chunk_count, (select count(*) from ch where dataset_split = 'test') evaluation_corpus_chunk_count, (select count(*) from ch where indexable) indexable_chunk_count,
 count(*) filter ({OWN} and dataset_split = 'test') evaluation_paper_count, (select count(*) from benchmark) evaluation_question_count, {told('category_counts', 'best', 'category')}, {told('language_counts', f'(select * from man where {OWN})', '"language"')} from man""")
def corpus_counts(spark, sf):
    m = manifest(spark, sf)
    d = read(spark, sf, "documents")
    chunks = d.select(F.when(F.col("doc_id") % 97 % 5 == 0, "test").otherwise("development").alias("dataset_split"), (F.col("doc_id") % 3 != 0).alias("indexable"))
    out = C.corpus_counts(m, chunks, m.where("not is_exact_duplicate and dataset_split = 'test'"), read(spark, sf, "benchmark"))
    text = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["value"], F.lit("="), e["n"])), ",")
    return out.withColumns({c: text(c) for c in ("category_counts", "language_counts")})


@query("""with d as (select case when contains(lower(text), 'survey') or contains(lower(text), 'review') then 'survey' when contains(lower(text), 'language model') or contains(lower(text), 'logllm') or contains(lower(source), 'llm') then 'llm_for_aiops'
 when contains(lower(source), 'mamba') then 'sequence_modeling' when contains(lower(source), 'svdd') or contains(lower(text), 'one-class') then 'one_class_anomaly_detection' when contains(lower(text), 'wavelet') then 'wavelet_time_series'
 when contains(lower(text), 'dynamic graph') then 'dynamic_graph' when regexp_matches(lower(text), 'root cause|failure localization|fault localization|troubleshooting|causal|causality') then 'microservice_root_cause_analysis'
 when contains(lower(text), 'anomaly') then 'anomaly_detection' else 'microservice_observability' end category, lang from documents) select category, lang, count(*) n from d group by all""")
def category_language_hist(spark, sf):
    d = read(spark, sf, "documents").select(C.category(F.col("source"), F.col("text")).alias("category"), "lang")
    return C.histogram(d, "category", "lang")


@query(f"""with {POLICY}, e as (select *, row_number() over (partition by category order by sha256, relative_path) round_no from records where document_type = 'original' and index_policy = 'primary')
select paper_id, category, round_no from e order by round_no, category limit 24""")
def holdout_round_robin(spark, sf):
    e = records(spark, sf).where("document_type = 'original' and index_policy = 'primary'")
    return C.holdout(e, 24).select("paper_id", "category", F.col("round_no").cast("bigint").alias("round_no"))


SPLIT = POLICY + """, e as (select *, row_number() over (partition by category order by sha256, relative_path) round_no from records where document_type = 'original' and index_policy = 'primary'),
held as (select distinct work_id from (select work_id from e order by round_no, category limit 24)), sp as (select r.*, case when h.work_id is null then 'development' else 'test' end dataset_split, h.work_id is null tuning_allowed from records r left join held h using (work_id))"""


def split(spark, sf):
    r = records(spark, sf)
    return C.split_of(r, C.holdout(r.where("document_type = 'original' and index_policy = 'primary'"), 24))


@query(f"with {SPLIT} select dataset_split, tuning_allowed, count(*) n, count(distinct work_id) n_works from sp where indexable group by all")
def split_partitions(spark, sf):
    return split(spark, sf).where("indexable").groupBy("dataset_split", "tuning_allowed").agg(F.count("*").alias("n"), F.countDistinct("work_id").alias("n_works"))


@query(f"with {SPLIT}, bad as (select work_id, case when doc_id % 10 = 3 then 'test' else dataset_split end s from sp) select work_id, count(distinct s) n_splits from bad group by 1 having count(distinct s) > 1")
def split_purity(spark, sf):
    """Every tenth document is put into another split than its work."""
    return C.split_violations(split(spark, sf).withColumn("dataset_split", F.when(F.col("doc_id") % 10 == 3, "test").otherwise(F.col("dataset_split"))))


@query(f"""with {FILES}, a as (select relative_path, sha256, byte_size from files where doc_id % 10 <> 0), b as (select relative_path, case when doc_id % 7 = 0 then sha256(sha256) else sha256 end sha256, byte_size from files where doc_id % 11 <> 0)
select relative_path, case when a.relative_path is null then 'added' when b.relative_path is null then 'removed' else 'changed' end as change from a full outer join b using (relative_path) where (a.sha256, a.byte_size) is distinct from (b.sha256, b.byte_size)""")
def changed_files(spark, sf):
    f = files(spark, sf)
    after = f.where("doc_id % 11 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 7 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return C.changed_files(f.where("doc_id % 10 <> 0"), after)


@query("""with n as (select doc_id, case doc_id % 4 when 0 then '(CCF A) Deep_Model ' || source || '.pdf' when 1 then '有代码Graph Model-' || source || '翻译结果.pdf' when 2 then source || '_' || lang || '.PDF' else '翻译 ' || source || '.x.pdf' end filename from documents),
s as (select *, regexp_replace(filename, '\\.[^.]*$', '') stem from n), t as (select *, replace(replace(replace(stem, '翻译结果', ''), '中文翻译', ''), '翻译', '') base from s)
select doc_id, regexp_replace(regexp_replace(regexp_replace(lower(base), '^\\s*[（(]?ccf\\s*[abc][）)]?\\s*', ''), '^有代码', ''), '[^a-z0-9一-鿿]+', '', 'g') title_key,
 regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(base, '^\\s*[（(]?[cC][cC][fF]\\s*[aAbBcC][）)]?\\s*', ''), '^有代码', ''), '_', ' '), '\\s+', ' ', 'g'), '^[ \\-_.]+|[ \\-_.]+$', '', 'g') clean_title, case when contains(filename, '翻译') then 'translation' else 'original' end document_type from t""")
def title_keys(spark, sf):
    d, m = read(spark, sf, "documents"), F.col("doc_id") % 4
    name = F.when(m == 0, F.concat(F.lit("(CCF A) Deep_Model "), "source", F.lit(".pdf"))).when(m == 1, F.concat(F.lit("有代码Graph Model-"), "source", F.lit("翻译结果.pdf"))).when(m == 2, F.concat("source", F.lit("_"), "lang", F.lit(".PDF"))).otherwise(F.concat(F.lit("翻译 "), "source", F.lit(".x.pdf")))
    n = d.select("doc_id", name.alias("filename"))
    return n.select("doc_id", C.title_key(F.col("filename")).alias("title_key"), C.clean_title(F.col("filename")).alias("clean_title"), C.document_type(F.col("filename")).alias("document_type"))


@query("""with d as (select doc_id, 'arXiv:2101.1 v1 (' || (1985 + doc_id % 60) || ') accepted on ' || (2000 + doc_id % 40) || ' x' front, case when doc_id % 3 = 0 then 'Document ' || doc_id when doc_id % 3 = 1 then 'short' else 'A plausible title ' || doc_id end title from documents),
y as (select *, try_cast(nullif(regexp_extract(lower(front), '(?:accepted|published|publication)[^0-9]{0,24}(20[0-9]{2})', 1), '') as int) a, try_cast(nullif(regexp_extract(lower(front), 'arxiv:[^ ]+.*?(20[0-9]{2})', 1), '') as int) b from d)
select doc_id, coalesce(case when a between 1990 and 2026 then a end, case when b between 1990 and 2026 then b end) as "year", length(title) between 8 and 400 and not starts_with(lower(title), 'document ') plausible from y""")
def year_and_title(spark, sf):
    d = read(spark, sf, "documents")
    front = F.concat(F.lit("arXiv:2101.1 v1 ("), (1985 + F.col("doc_id") % 60).cast("string"), F.lit(") accepted on "), (2000 + F.col("doc_id") % 40).cast("string"), F.lit(" x"))
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Document "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, "short").otherwise(F.concat(F.lit("A plausible title "), F.col("doc_id").cast("string")))
    return d.select("doc_id", C.publication_year(front).alias("year"), C.plausible_title(title).alias("plausible"))
