"""Corpus preparation: exact duplicates, canonical files, works, policies, splits, summaries.

A file table has file_id, relative_path, sha256 and, for works, title, document_type and language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.layout import settled

# Marks of translated files, title aliases, generic titles, and the category rules in their order.
TRANSLATION_MARKS = ["翻译结果", "【翻译】", "（翻译）", "(翻译结果)", "中文翻译", "翻译"]
GENERIC_TITLES = ["untitled", "microsoft word", "document", "main", "paper"]
ROOT_CAUSE_MARKS = ["root cause", "failure localization", "fault localization", "troubleshooting", "causal", "causality", "根因", "故障定位"]
CATEGORY_RULES = [
    ("survey", ["综述"], ["survey", "review"]),
    ("llm_for_aiops", ["llm"], ["language model", "logllm"]),
    ("sequence_modeling", ["mamba"], []),
    ("one_class_anomaly_detection", ["svdd"], ["one-class"]),
    ("wavelet_time_series", ["小波"], ["wavelet"]),
    ("dynamic_graph", ["动态图"], ["dynamic graph"]),
    ("microservice_root_cause_analysis", ROOT_CAUSE_MARKS, ROOT_CAUSE_MARKS),
    ("anomaly_detection", [], ["anomaly", "异常"]),
]
BASELINE_FOLDERS = ["baseline", "baseline2"]


def _any(text: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(text, F.lit(m))
    return out


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"(?<=.)\.[^.]*$", "")


def title_key(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """A file name's key for grouping versions and translations: marks, rank prefix and anything but letters and digits go."""
    stem = F.lower(_stem(name))
    for mark in TRANSLATION_MARKS:
        stem = F.replace(stem, F.lit(mark), F.lit(""))
    stem = F.regexp_replace(F.regexp_replace(stem, r"^\s*[（(]?ccf\s*[abc][）)]?\s*", ""), "^有代码", "")
    key = F.regexp_replace(stem, "[^a-z0-9一-鿿]+", "")
    out = key
    for old, new in (aliases or {}).items():
        out = F.when(key == old, new).otherwise(out)
    return out


def clean_title(name: Column) -> Column:
    """A readable title from a file name."""
    title = _stem(name)
    for mark in TRANSLATION_MARKS:
        title = F.replace(title, F.lit(mark), F.lit(""))
    title = F.regexp_replace(F.regexp_replace(title, r"(?i)^\s*[（(]?CCF\s*[ABC][）)]?\s*", ""), "^有代码", "")
    return F.regexp_replace(F.regexp_replace(F.replace(title, F.lit("_"), F.lit(" ")), r"\s+", " "), "^[ \\-_.]+|[ \\-_.]+$", "")


def document_type(name: Column) -> Column:
    return F.when(_any(name, TRANSLATION_MARKS), "translation").otherwise("original")


def category(path: Column, title: Column) -> Column:
    """The first category whose marks stand in the path or the title."""
    path, title, out = F.lower(path), F.lower(title), F.lit("microservice_observability")
    for name, in_path, in_title in reversed(CATEGORY_RULES):
        out = F.when(_any(path, in_path) | _any(title, in_title), name).otherwise(out)
    return out


def publication_year(front: Column) -> Column:
    """The year of the first cue whose match lies in 1990 to 2026."""
    low = F.lower(front)
    cues = [r"(?s)(?:©|copyright)[ ]*(20[0-9]{2})", r"(?s)(?:accepted|published|publication)[^0-9]{0,24}(20[0-9]{2})", r"(?s)arxiv:[^ ]+.*?(20[0-9]{2})"]
    years = [F.nullif(F.regexp_extract(low, cue, 1), F.lit("")).cast("int") for cue in cues]
    return F.coalesce(*(F.when(y.between(1990, 2026), y) for y in years))


def plausible_title(title: Column) -> Column:
    """8 to 400 characters, and not a generic name or one that begins with it."""
    flat = F.trim(F.regexp_replace(title, r"\s+", " "))
    generic = F.lit(False)
    for g in GENERIC_TITLES:
        generic = generic | (F.lower(flat) == g) | F.startswith(F.lower(flat), F.lit(g + " "))
    return F.coalesce(F.length(flat).between(8, 400) & ~generic, F.lit(False))


def _preference(path: Column) -> list[Column]:
    """Files outside baseline folders first, then the shallower, then by path."""
    folders = F.split(F.lower(path), "/")
    return [F.arrays_overlap(folders, F.array(*map(F.lit, BASELINE_FOLDERS))).cast("int"), F.size(folders), path]


def canonical(files: DataFrame) -> DataFrame:
    """files with canonical_path, is_exact_duplicate and duplicate_of: of equal digests the preferred file stands for all.

    The preferred file of a digest is an aggregate (min of a struct), so a digest that a third of the files share is
    reduced before the shuffle, and the join back can be split by adaptive execution.
    """
    order = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(_preference(F.col("relative_path")))), F.col("file_id").alias("id"))
    best = files.groupBy("sha256").agg(F.min(order).alias("best")).select(F.col("sha256").alias("k"), F.col("best.o2").alias("canonical_path"), F.col("best.id").alias("canonical_id"))
    joined = files.join(best, files.sha256 == best.k).drop("k")
    double = F.col("file_id") != F.col("canonical_id")
    return joined.withColumn("is_exact_duplicate", double).withColumn("duplicate_of", F.when(double, F.col("canonical_id"))).drop("canonical_id")


def duplicate_groups(files: DataFrame) -> DataFrame:
    """(sha256, n, canonical_path, aliases) of every digest that repeats; aliases are the other paths, sorted.

    For reports: a row holds a whole group. Where groups may be very large, `duplicate_members` gives a row for each alias.
    """
    order = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(_preference(F.col("relative_path")))))
    g = files.groupBy("sha256").agg(F.count("*").alias("n"), F.min(order)["o2"].alias("canonical_path"), F.sort_array(F.collect_list("relative_path")).alias("paths"))
    return g.where("n > 1").select("sha256", "n", "canonical_path", F.filter("paths", lambda p: p != F.col("canonical_path")).alias("aliases"))


def duplicate_members(files: DataFrame) -> DataFrame:
    """(sha256, canonical_path, alias): one row for every file that another one stands for; no group is gathered anywhere."""
    return canonical(files).where("is_exact_duplicate").select("sha256", "canonical_path", F.col("relative_path").alias("alias"))


def index_policies(records: DataFrame) -> DataFrame:
    """Canonical records (work_id, paper_id, document_type, relative_path) with index_policy, indexable and the links to the primary."""
    by_type = Window.partitionBy("work_id", "document_type").orderBy(*_preference(F.col("relative_path")))
    work = Window.partitionBy("work_id")
    r = records.withColumn("_n", F.row_number().over(by_type)).withColumn("_originals", F.max(F.when(F.col("document_type") == "original", 1).otherwise(0)).over(work))
    r = r.withColumn("_primary", F.max(F.when((F.col("_n") == 1) & ((F.col("document_type") == "original") | (F.col("_originals") == 0)), F.col("paper_id"))).over(work))
    original, first, alone = F.col("document_type") == "original", F.col("_n") == 1, F.col("_originals") == 0
    policy = F.when(original & first, "primary").when(first & alone, "primary_translation_only").when(~original & first, "auxiliary_translation").otherwise("skip_semantic_variant")
    r = r.withColumn("index_policy", policy).withColumn("indexable", F.col("index_policy") != "skip_semantic_variant")
    r = r.withColumn("translation_of", F.when(~original & ~alone, F.col("_primary")))
    return r.withColumn("variant_of", F.when(F.col("index_policy") == "skip_semantic_variant", F.col("_primary"))).drop("_n", "_originals", "_primary")


def works(records: DataFrame) -> DataFrame:
    """One row for a work: files, distinct contents, papers, sorted sets of languages and of indexable papers."""
    return records.groupBy("work_id").agg(
        F.count("*").alias("n_files"), F.countDistinct("sha256").alias("n_contents"), F.array_sort(F.collect_set("paper_id")).alias("papers"),
        F.array_sort(F.collect_set("language")).alias("languages"), F.array_sort(F.collect_set(F.when(F.col("indexable"), F.col("paper_id")))).alias("indexable_papers"),
    )


def _first_of_work() -> Column:
    """The place of a canonical record in its work: records of a primary policy first, then by preference of their path."""
    chosen = ~F.col("index_policy").isin("primary", "primary_translation_only")
    fields = ("paper_id", "title", "category", "year", "dataset_split", "tuning_allowed")
    place = F.struct(F.coalesce(chosen, F.lit(True)).alias("a"), *(c.alias(f"o{i}") for i, c in enumerate(_preference(F.col("relative_path")))), F.col("file_id").alias("id"), *fields)
    return F.min(F.when(~F.col("is_exact_duplicate"), place))


def work_records(manifest: DataFrame) -> DataFrame:
    """One row for a work of manifest(file_id, relative_path, paper_id, work_id, is_exact_duplicate, document_type, language, index_policy, indexable, title, category, year, dataset_split, tuning_allowed).

    Title, category, year and split are the primary record's. Sets are sorted; all but languages and files hold canonical
    records only. For reports: a row holds the ids of a whole work; where works may be very large, `work_members` has a row
    for each id. A work of duplicates only has no primary.
    """
    own = ~F.col("is_exact_duplicate")
    ids = lambda c, of: F.array_sort(F.collect_set(F.when(c, F.col(of))))
    rows = manifest.groupBy("work_id").agg(
        _first_of_work().alias("p"), F.count("*").alias("source_file_count"), F.array_sort(F.collect_set("language")).alias("languages"), ids(own, "paper_id").alias("papers"),
        ids(own & (F.col("document_type") == "original"), "paper_id").alias("original_paper_ids"), ids(own & (F.col("document_type") == "translation"), "paper_id").alias("translation_paper_ids"),
        ids(own & F.col("indexable"), "paper_id").alias("indexable_paper_ids"), F.array_sort(F.collect_list("file_id")).alias("source_file_ids"),
    )
    lists = ("languages", "original_paper_ids", "translation_paper_ids", "indexable_paper_ids", "source_file_ids")
    return rows.select("work_id", "p.title", "p.category", "p.year", F.col("p.paper_id").alias("primary_paper_id"), "source_file_count", F.size("papers").alias("unique_content_count"), *lists, "p.dataset_split", "p.tuning_allowed")


def work_members(manifest: DataFrame) -> DataFrame:
    """(work_id, kind, member): the sets of `work_records` as rows, so that no work is gathered anywhere."""
    own = ~F.col("is_exact_duplicate")
    kinds = {"languages": (F.lit(True), "language"), "original_paper_ids": (own & (F.col("document_type") == "original"), "paper_id"), "translation_paper_ids": (own & (F.col("document_type") == "translation"), "paper_id"),
             "indexable_paper_ids": (own & F.col("indexable"), "paper_id"), "source_file_ids": (F.lit(True), "file_id")}
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), F.when(c, F.col(of)).alias("member")) for kind, (c, of) in kinds.items()))
    return manifest.select("work_id", F.explode(each).alias("m")).select("work_id", "m.*").where("member is not null").distinct()


def _listed(counts: DataFrame, key: str, name: str) -> DataFrame:
    """One row: the few values of a column with their counts, in order."""
    each = counts.groupBy(key).agg(F.sum("n").alias("n")).select(F.struct(F.col(key).alias("value"), "n").alias("e"))
    return each.agg(F.array_sort(F.collect_list("e")).alias(name))


def corpus_counts(manifest: DataFrame, chunks: DataFrame, papers: DataFrame, questions: DataFrame) -> DataFrame:
    """One row with the counts of a whole dataset: files, contents, works, variants, translations, chunks, evaluation; categories of works and languages of contents.

    Distinct works are counted by grouping by work first, which is one shuffle of a row for each work and task, and not one
    copy of the manifest for each distinct count.
    """
    own = ~F.col("is_exact_duplicate")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    translated, variant = F.col("document_type") == "translation", F.col("index_policy") == "skip_semantic_variant"
    linked = F.col("translation_of").isNotNull()
    works = manifest.groupBy("work_id").agg(
        F.count("*").alias("source_pdf_count"), F.sum("pages").alias("source_total_pages"), n(own).alias("canonical_pdf_count"), F.coalesce(F.sum(F.when(own, F.col("pages"))), F.lit(0)).alias("canonical_total_pages"), n(own & F.col("indexable")).alias("indexable_content_count"),
        n(own & variant).alias("semantic_variant_content_count"), n(F.col("is_exact_duplicate")).alias("exact_duplicate_file_count"), n(translated).alias("translation_file_count"), n(own & translated).alias("canonical_translation_content_count"),
        n(own & linked).alias("linked_translation_content_count"), _first_of_work()["category"].alias("category"),
    )
    works = settled(works)
    sums = [F.sum(c).alias(c) for c in works.columns if c not in ("work_id", "category")]
    at_least_one = {"semantic_variant_work_count": "semantic_variant_content_count", "linked_translation_work_count": "linked_translation_content_count"}
    files = works.agg(F.count("*").alias("logical_work_count"), *sums, *(F.count_if(F.col(c) > 0).alias(name) for name, c in at_least_one.items()))
    repeated = manifest.groupBy("sha256").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("exact_duplicate_group_count"))
    split = F.col("dataset_split")
    parts = chunks.agg(F.count("*").alias("chunk_count"), n(split == "development").alias("development_chunk_count"), n(split == "test").alias("evaluation_corpus_chunk_count"), n(F.col("indexable")).alias("indexable_chunk_count"))
    judged = papers.agg(F.count("*").alias("evaluation_paper_count")), questions.agg(F.count("*").alias("evaluation_question_count"))
    kinds = _listed(works.groupBy("category").agg(F.count("*").alias("n")), "category", "category_counts"), _listed(manifest.where(own).groupBy("language").agg(F.count("*").alias("n")), "language", "language_counts")
    out = files
    for one in (repeated, parts, *judged, *kinds):  # each of one row
        out = out.crossJoin(one)
    return out


def holdout(records: DataFrame, size: int) -> DataFrame:
    """`size` eligible records, taken in turn from the categories in their order; each category gives its records by digest.

    The k-th of each category comes in round k, so one rank per category and one sort with a limit are enough.
    """
    rank = F.row_number().over(Window.partitionBy("category").orderBy("sha256", "relative_path"))
    return records.withColumn("round_no", rank).orderBy("round_no", "category").limit(size)


def split_of(records: DataFrame, held: DataFrame) -> DataFrame:
    """records with dataset_split and tuning_allowed: works of held-out records are test as a whole."""
    marked = records.join(held.select("work_id").distinct().withColumn("_test", F.lit(True)), "work_id", "left")
    return marked.withColumn("dataset_split", F.when(F.col("_test"), "test").otherwise("development")).withColumn("tuning_allowed", F.col("_test").isNull()).drop("_test")


def split_violations(chunks: DataFrame) -> DataFrame:
    """(work_id, n_splits) of works that stand in more than one split."""
    return chunks.groupBy("work_id").agg(F.countDistinct("dataset_split").alias("n_splits")).where("n_splits > 1")


def summary(files: DataFrame) -> DataFrame:
    """One row of counts over a file table with is_exact_duplicate, indexable, document_type, language, pages."""
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return files.agg(
        F.count("*").alias("n_files"), yes(F.col("is_exact_duplicate")).alias("n_duplicates"), F.countDistinct("sha256").alias("n_contents"), F.countDistinct("work_id").alias("n_works"),
        yes(F.col("indexable")).alias("n_indexable"), yes(F.col("document_type") == "translation").alias("n_translations"), F.sum("pages").alias("n_pages"), F.countDistinct("language").alias("n_languages"),
    )


def histogram(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(relative_path, change) of files whose digest or size differ between two scans."""
    a = before.select("relative_path", F.struct("sha256", "byte_size").alias("a"))
    b = after.select("relative_path", F.struct("sha256", "byte_size").alias("b"))
    both = a.join(b, "relative_path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("relative_path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))
