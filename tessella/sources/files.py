"""File sources: JSON lines (strict and lenient), JSON documents, label CSV, checksum lists, binary scans, metrics, PDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files of any size; lines end with a newline, a carriage return before it goes.

    Files are read in splits as always. A row's place in its split comes from the increasing ids that Spark gives the rows
    of a task in their order; the number of the lines before a split is a running sum over one row for each split.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\r$", "").alias("line"))
    splits = rows.groupBy("_path", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_path", "_at", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return rows.join(starts, ["_path", "_at"]).select("file", (F.col("_id") + F.col("_shift")).alias("line_no"), "line")


def jsonl_strict(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): rows with line_no; errors (file, line_no, reason) for blank lines and lines that are no JSON object."""
    lines = numbered_lines(spark, path)
    blank, broken = F.trim("line") == "", ~F.coalesce(F.trim("line").rlike(r"(?s)^\{.*\}$") & F.try_parse_json("line").isNotNull(), F.lit(False))
    judged = lines.withColumn("reason", F.when(blank, "blank line").when(broken, "not a JSON object"))
    rows = judged.where("reason is null").select("file", "line_no", F.from_json("line", schema if isinstance(schema, str) else schema.simpleString()).alias("r")).select("file", "line_no", "r.*")
    return rows, judged.where("reason is not null").select("file", "line_no", "reason")


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One document in each file, with its file name."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.col("_metadata.file_name").alias("file"))


def csv_labels(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; all columns are strings."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def file_scan(spark: SparkSession, path: str, pattern: str = "*.pdf", root: str | None = None) -> DataFrame:
    """(relative_path, byte_size, sha256) of files below a path whose names match, whatever the case; contents stay on the executors."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = (root or path).removeprefix("file://").rstrip("/")
    named = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + base.replace(".", r"\.") + "/", "")
    like = "(?i)" + pattern.replace(".", r"\.").replace("*", "[^/]*") + "$"
    return raw.where(F.col("path").rlike("(^|/)" + like if not pattern.startswith("*") else like)).select(named.alias("relative_path"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, relative_path, problem) of a list of `digest  path` lines: bad lines, unsafe paths and repeated paths have a problem."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    r = lines.select("value", F.regexp_extract("value", "^([0-9a-f]{64})  (.+)$", 1).alias("sha256"), F.regexp_extract("value", "^([0-9a-f]{64})  (.+)$", 2).alias("relative_path"))
    unsafe = F.col("relative_path").rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)|\\")
    n = r.groupBy("relative_path").agg(F.count("*").alias("n"))
    return r.join(n, "relative_path").select("sha256", "relative_path", F.when(F.col("sha256") == "", "malformed").when(unsafe, "unsafe_path").when(F.col("n") > 1, "repeated").alias("problem"))


def verified(listed: DataFrame, scanned: DataFrame) -> DataFrame:
    """(relative_path, state): ok, missing, changed for listed files, extra for others."""
    j = listed.select("relative_path", F.col("sha256").alias("a")).join(scanned.select("relative_path", F.col("sha256").alias("b")), "relative_path", "full_outer")
    return j.select("relative_path", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed").otherwise("ok").alias("state"))


def counters(lines: DataFrame, names: list[str]) -> DataFrame:
    """(name, total): the sums of counters in the text form of a metrics page."""
    name, value = F.regexp_extract("value", r"^([A-Za-z_:][A-Za-z0-9_:]*)", 1), F.regexp_extract("value", r"\s([-+0-9.eE]+)\s*$", 1)
    return lines.select(name.alias("name"), value.cast("double").alias("v")).where(F.col("name").isin(*names)).groupBy("name").agg(F.sum("v").alias("total"))


def pdf_inspection(files: DataFrame) -> DataFrame:
    """binaryFile rows with pages, encrypted and problem; needs pymupdf on the executors, gives a problem without it."""

    def run(batches):
        import pyarrow as pa

        try:
            import pymupdf
        except ImportError:
            pymupdf = None
        for b in batches:
            out = []
            for raw in b.column(1).to_pylist():
                if not raw.startswith(b"%PDF-"):
                    out.append((None, None, "not a PDF"))
                elif pymupdf is None:
                    out.append((None, None, "no PDF library"))
                else:
                    with pymupdf.open(stream=raw, filetype="pdf") as doc:
                        out.append((doc.page_count, bool(doc.needs_pass), "encrypted" if doc.needs_pass else "empty" if not doc.page_count else None))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.bool_(), pa.string())))], ["path", "pages", "encrypted", "problem"])

    return files.select("path", "content").mapInArrow(run, "path string, pages int, encrypted boolean, problem string")


def layout_blocks(files: DataFrame) -> DataFrame:
    """Text blocks of PDFs: (path, page_number, source_index, bbox, text, max_font_size, bold); needs pymupdf on the executors."""

    def run(batches):
        import pyarrow as pa
        import pymupdf

        kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string(), pa.float64(), pa.bool_()]
        names = ["path", "page_number", "source_index", "bbox", "text", "max_font_size", "bold"]
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                with pymupdf.open(stream=raw, filetype="pdf") as doc:
                    for no, page in enumerate(doc, 1):
                        for i, block in enumerate(page.get_text("dict", sort=True)["blocks"]):
                            spans = [s for line in block.get("lines", []) for s in line["spans"]]
                            text = "\n".join("".join(s["text"] for s in line["spans"]) for line in block.get("lines", []))
                            if text.strip():
                                rows.append((path, no, i, [round(float(x), 2) for x in block["bbox"]], text, max(s["size"] for s in spans), any("bold" in s["font"].lower() for s in spans)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return files.select("path", "content").mapInArrow(run, "path string, page_number int, source_index int, bbox array<double>, text string, max_font_size double, bold boolean")
