"""Blocks to chunks: margins, body size, sections, packing, links."""

from __future__ import annotations

import bisect
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import vectors as V

MAX_CHARS = 1800
# Fixed value: where a text may be cut.
BOUNDARY = re.compile(r"\n|[.!?。！？；;]\s*|\s+")
FILLED = re.compile(r"\S+")


def in_margin(y0: Column, y1: Column, height: Column) -> Column:
    return (y1 <= height * F.lit(0.09)) | (y0 >= height * F.lit(0.91))


def margin_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), r"\d+", "#")


def repeated_margins(blocks: DataFrame) -> DataFrame:
    """(paper_id, text_key, n) of margin texts on at least max(3, 30 % of the pages) pages of a paper.

    in_margin says that a block ends in the upper or begins in the lower 9 % of its page; up to 180 characters count, digits
    are alike.
    """
    pages = blocks.groupBy("paper_id").agg(F.countDistinct("page_number").alias("pages"))
    on = blocks.where("in_margin").select("paper_id", "page_number", margin_key(F.col("text")).alias("text_key")).where(F.length("text_key") <= 180).distinct().groupBy("paper_id", "text_key").agg(F.count("*").alias("n"))
    return on.join(pages, "paper_id").where(F.col("n") >= F.greatest(F.lit(3), F.bround(F.col("pages") * F.lit(0.3)))).select("paper_id", "text_key", "n")


def body_size(blocks: DataFrame) -> DataFrame:
    """(paper_id, body_size): the median of the blocks' median font sizes."""
    return blocks.groupBy("paper_id").agg(F.median("median_font_size").alias("body_size"))


def with_section(blocks: DataFrame) -> DataFrame:
    """blocks with section: the last heading on the page so far with its white space normalized, else `document`."""
    w = Window.partitionBy("paper_id", "page_number").orderBy("reading_order").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.coalesce(F.last(F.when(F.col("is_heading"), F.trim(F.regexp_replace("text", r"\s+", " "))), ignorenulls=True).over(w), F.lit("document")))


def part_offsets(text: str, most: int = MAX_CHARS) -> list[tuple[int, int]]:
    """(start, stop) of the parts of a text: at most `most` characters, up to the last place to cut that is past 55 % of it, else up to the limit itself.

    White space around a part belongs to none. The places to cut are found once, in one pass over the text, and each part
    looks its own up by bisection, so the time is linear in the text.
    """
    if type(most) is not int or most < 1:
        raise ValueError("most must be a positive integer")
    places = [m.end() for m in BOUNDARY.finditer(text)]
    filled = [m.span() for m in FILLED.finditer(text)]  # runs without white space
    if not filled:
        return []
    run_starts, run_stops = zip(*filled, strict=True)
    out, begin, end = [], run_starts[0], run_stops[-1]
    while begin < end:
        stop = end
        if end - begin > most:
            last = bisect.bisect_right(places, begin + most) - 1
            stop = places[last] if last >= 0 and places[last] >= begin + max(1, most * 55 // 100) else begin + most
        run = bisect.bisect_left(run_starts, stop) - 1  # the last run that begins before the cut
        out.append((begin, min(stop, run_stops[run])))
        begin = stop if stop < run_stops[run] else run_starts[run + 1] if run + 1 < len(run_starts) else end
    return out


def split_column(text: Column, most: int = MAX_CHARS) -> Column:
    """An array of the parts of each text; Arrow, because a cut depends on the one before."""

    @F.pandas_udf("array<string>")
    def split(batch):
        return batch.map(lambda t: [t[a:b] for a, b in part_offsets(t or "", most)])

    return split(text)


# Fixed value: separators in the order in which they are tried.
SEPARATORS = ("\n\n", "\n", " ")


def _cut(text: str, begin: int, end: int, separator: str) -> list[tuple[int, int]]:
    """The pieces of text[begin:end]; each but the first begins with the separator."""
    places, at = [begin], text.find(separator, begin, end)
    while at >= 0:
        if at > begin:
            places.append(at)
        at = text.find(separator, at + len(separator), end)
    return list(zip(places, [*places[1:], end], strict=True))


def _joined(pieces: list[tuple[int, int]], size: int, overlap: int):
    """Spans of adjacent pieces, each as long as fits; the last pieces of one, up to the overlap, begin the next."""
    first = 0
    for i, (a, b) in enumerate(pieces):
        if b - pieces[first][0] > size and first < i:
            yield pieces[first][0], a
            while first < i and (a - pieces[first][0] > overlap or b - pieces[first][0] > size):
                first += 1
    if pieces:
        yield pieces[first][0], pieces[-1][1]


def recursive_offsets(text: str, size: int = 1500, overlap: int = 200) -> list[tuple[int, int]]:
    """(start, stop) of parts of at most `size` characters that overlap by up to `overlap`.

    A text is cut at the first of SEPARATORS that it holds, what is still too long at the next, and what holds none into
    windows. Adjacent pieces are joined as long as they fit. White space around a part belongs to none. The time is linear
    in the text for each separator.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    found: list[tuple[int, int]] = []

    def walk(begin: int, end: int, level: int) -> None:
        while level < len(SEPARATORS) and text.find(SEPARATORS[level], begin, end) < 0:
            level += 1
        if level == len(SEPARATORS):
            for at in range(begin, max(begin + 1, end - overlap), size - overlap):
                found.append((at, min(at + size, end)))
            return
        small: list[tuple[int, int]] = []
        for a, b in _cut(text, begin, end, SEPARATORS[level]):
            if b - a < size:
                small.append((a, b))
            else:
                found.extend(_joined(small, size, overlap))
                small = []
                walk(a, b, level + 1)
        found.extend(_joined(small, size, overlap))

    if text:
        walk(0, len(text), 0)
    bare = ((a, b, text[a:b]) for a, b in found)
    return [(a + len(t) - len(t.lstrip()), b - len(t) + len(t.rstrip())) for a, b, t in bare if t.strip()]


def recursive_split(text: Column, size: int = 1500, overlap: int = 200) -> Column:
    """An array of (start, part) of each text, starts from 0; Arrow, because a cut depends on the ones before. A null text has no parts."""
    recursive_offsets("", size, overlap)  # wrong sizes are an error of the caller's, not of a task

    @F.pandas_udf("array<struct<start:int,part:string>>")
    def split(batch):
        return batch.map(lambda t: [{"start": a, "part": t[a:b]} for a, b in recursive_offsets(t or "", size, overlap)])

    return split(text)


def overlapping(text: Column, size: int = 1500, overlap: int = 200) -> Column:
    """Windows of `size` characters that overlap."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - overlap), F.lit(size - overlap))
    return F.filter(F.transform(starts, lambda s: F.substr(text, s, F.lit(size))), lambda p: F.length(p) > 0)


def packed(blocks: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """(paper_id, page_number, ordinal, section, text, block_orders): blocks of a page packed in order up to `most` characters.

    Blocks that are longer are split first. A heading starts a new chunk, and so does each part of a long one; two
    characters stand between the blocks of a chunk. The fold runs over the blocks of one page, which are few, so a page is
    one row and no more than a page is ever in one place. Ordinals count the chunks of a paper.
    """
    parts = with_section(blocks).select("paper_id", "page_number", "reading_order", "section", "is_heading", F.posexplode(split_column(F.col("text"), most)).alias("part", "text"))
    rows = parts.select("paper_id", "page_number", F.struct("reading_order", "part", "section", "is_heading", "text").alias("b"))
    pages = rows.groupBy("paper_id", "page_number").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    kind = "array<struct<section:string,text:string,orders:array<int>>>"

    def step(acc: Column, b: Column) -> Column:
        last = F.element_at(acc, -1)
        part = F.struct(b["section"].alias("section"), b["text"].alias("text"), F.array(b["reading_order"].cast("int")).alias("orders"))
        joined = F.struct(last["section"].alias("section"), F.concat(last["text"], F.lit("\n\n"), b["text"]).alias("text"), F.concat(last["orders"], F.array(b["reading_order"].cast("int"))).alias("orders"))
        fresh = (F.size(acc) == 0) | b["is_heading"] | (F.length(last["text"]) + 2 + F.length(b["text"]) > most)
        return F.when(fresh, F.concat(acc, F.array(part))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined)))

    folded = pages.select("paper_id", "page_number", F.aggregate("blocks", F.array().cast(kind), step).alias("chunks"))
    chunks = folded.select("paper_id", "page_number", F.posexplode("chunks").alias("n", "c")).where(F.trim("c.text") != "")
    ordinal = F.row_number().over(Window.partitionBy("paper_id").orderBy("page_number", "n")) - 1
    return chunks.select("paper_id", "page_number", ordinal.alias("ordinal"), "c.section", "c.text", F.array_distinct("c.orders").alias("block_orders"))


def linked(chunks: DataFrame) -> DataFrame:
    """chunks(paper_id, page_number, ordinal, chunk_id) with previous_chunk_id and next_chunk_id."""
    w = Window.partitionBy("paper_id").orderBy("page_number", "ordinal")
    return chunks.withColumn("previous_chunk_id", F.lag("chunk_id").over(w)).withColumn("next_chunk_id", F.lead("chunk_id").over(w))


def union_boxes(blocks: DataFrame, *keys: str) -> DataFrame:
    return blocks.groupBy(*keys).agg(*V.union_box(F.col("bbox")))


def clustered(lines: DataFrame, gap: float = 1.8) -> DataFrame:
    """lines(page_id, y0, y1, font_size) with cluster: a new one where the gap is larger than 1.8 times the largest font."""
    w = Window.partitionBy("page_id").orderBy("y0", "x0")
    largest = F.max("font_size").over(Window.partitionBy("page_id"))
    start = F.coalesce((F.col("y0") - F.lag("y1").over(w)) > largest * gap, F.lit(True)).cast("int")
    return lines.withColumn("_s", start).withColumn("cluster", F.sum("_s").over(w)).drop("_s")


def spans_overlapping(blocks: DataFrame, matches: DataFrame) -> DataFrame:
    """(doc_id, block_no) of blocks whose characters overlap a match [start, stop); offsets count one separator between blocks."""
    w = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("_a", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))).withColumn("_b", F.col("_a") + F.length("text"))
    return placed.join(matches, "doc_id").where((F.col("_b") > F.col("start")) & (F.col("_a") < F.col("stop"))).select("doc_id", "block_no").distinct()
