"""Fetched pages as Markdown, with a line in place of what can't be shown, and gathered to one text of sources.

A page is read tag by tag. Open tags stand on a stack with the Markdown of what they hold so far; a closing tag takes the
top off, turns it into Markdown and gives it to the one below. Tags that HTML lets stay open (paragraphs, list items,
cells) are closed by what follows. Time grows with a page's length and the depth of its tags.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNSEEN = {"script", "style", "head", "template", "noscript", "svg"}
LEVELS = {f"h{n}": n for n in range(1, 7)}
BLOCKS = {"p", "div", "article", "section", "header", "footer", "nav", "main", "aside", "figure", "form", "ul", "ol", "table", "blockquote", "pre", "hr", "dl", *LEVELS}
#: Which open tag a new one closes, up to the tag that bounds the search.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})} | {b: ({"p"}, {"li", "td", "th", "blockquote"}) for b in BLOCKS}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict, list[str]]] = [("", {}, [])]
        self.unseen = 0

    def add(self, text: str) -> None:
        self.stack[-1][2].append(text)

    def opened(self, *tags: str) -> bool:
        return any(t in tags for t, _, _ in self.stack)

    def handle_starttag(self, tag, attrs):
        if self.unseen:
            self.unseen += tag in UNSEEN
            return
        if tag in UNSEEN:
            self.unseen = 1
            return
        if tag in CLOSES:
            shut, bound = CLOSES[tag]
            for at in range(len(self.stack) - 1, 0, -1):
                if self.stack[at][0] in bound:
                    break
                if self.stack[at][0] in shut:
                    self.down_to(at)
                    break
        if tag not in VOID:
            self.stack.append((tag, dict(attrs), []))
        elif tag == "br":
            self.add("\n" if self.opened("pre") else "  \n")
        elif tag == "hr":
            self.add("\n\n---\n\n")
        elif tag == "img":
            a = dict(attrs)
            self.add(f"![{a.get('alt') or ''}]({a.get('src') or ''})")

    def handle_endtag(self, tag):
        if self.unseen:
            self.unseen -= tag in UNSEEN
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] == tag:
                return self.down_to(at)

    def handle_data(self, data):
        if not self.unseen:
            self.add(data if self.opened("pre") else re.sub(r"\s+", " ", data))

    def down_to(self, at: int) -> None:
        """Close all tags from the top of the stack down to a place."""
        while len(self.stack) > at:
            tag, attrs, parts = self.stack.pop()
            self.add(self.shown(tag, attrs, "".join(parts)))

    def shown(self, tag: str, attrs: dict, text: str) -> str:
        flat = text.strip()
        if tag in LEVELS:
            return f"\n\n{'#' * LEVELS[tag]} {' '.join(flat.split())}\n\n" if flat else ""
        if tag in ("b", "strong", "i", "em", "code", "del", "s") and not self.opened("pre"):
            mark = {"b": "**", "strong": "**", "code": "`", "del": "~~", "s": "~~"}.get(tag, "*")
            return f"{text[: len(text) - len(text.lstrip())]}{mark}{flat}{mark}{text[len(text.rstrip()) :]}" if flat else text
        if tag == "a" and attrs.get("href"):
            return f"[{' '.join(flat.split())}]({attrs['href']})" if flat else ""
        if tag == "pre":
            return "\n\n```\n" + text.strip("\n") + "\n```\n\n"
        if tag == "li":
            return "\0" + re.sub(r"\n{2,}", "\n", flat)  # the list puts its bullet there
        if tag in ("ul", "ol"):
            items = [x.strip() for x in text.split("\0")[1:]]
            lines = [(f"{n}. " if tag == "ol" else "* ") + x.replace("\n", "\n    ") for n, x in enumerate(items, 1)]
            return "\n\n" + "\n".join(lines) + "\n\n" if lines else text
        if tag in ("td", "th"):
            return "\1" + " ".join(flat.split()).replace("|", "\\|")
        if tag == "tr":
            return "\2" + text.strip()
        if tag == "table":
            rows = [[c.strip() for c in r.split("\1")[1:]] for r in text.split("\2")[1:]]
            rows = [r for r in rows if r]
            if not rows:
                return text
            wide = max(map(len, rows))
            lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
            return "\n\n" + "\n".join([lines[0], "| " + " | ".join(["---"] * wide) + " |", *lines[1:]]) + "\n\n"
        if tag == "blockquote":
            return "\n\n" + "\n".join("> " + x if x else ">" for x in _tidy(text).split("\n")) + "\n\n"
        return f"\n\n{text}\n\n" if tag in BLOCKS else text


def _tidy(text: str) -> str:
    """No blanks at the ends of lines but for hard breaks, one blank line between blocks at most."""
    text = re.sub("[\0\1\2]", " ", text)
    text = re.sub(r"(?<! ) (?=\n)", "", re.sub(r" {3,}(?=\n)", "  ", text))
    text = re.sub(r"(?m)^ +$", "", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def to_markdown(html: str | None) -> str | None:
    """The Markdown of one page."""
    if html is None:
        return None
    r = _Reader()
    r.feed(re.sub("[\0\1\2]", " ", html))
    r.close()
    r.down_to(1)
    return _tidy("".join(r.stack[0][2]))


#: Pages that a task holds as text and Markdown at once.
PAGES = 64


def markdown(rows: DataFrame, key: str, html: str) -> DataFrame:
    """(key, markdown) of rows(key, html); null for null."""

    def run(batches):
        import pyarrow as pa

        for b in (whole.slice(at, PAGES) for whole in batches for at in range(0, whole.num_rows, PAGES)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_markdown(x) for x in b.column(1).to_pylist()], pa.string())], [key, "markdown"])

    return rows.select(key, F.col(html).cast("string").alias("html")).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, markdown string")


def placeholder(status: Column, content_type: Column, error: Column) -> Column:
    """The line that stands for a page without Markdown: an error, a status other than 200, a type other than HTML; null for a page."""
    # The texts that readers of the sources look for.
    failed, odd, other = F.concat(F.lit("Error fetching URL: "), error), F.concat(F.lit("Error: Received status code "), status.cast("string")), F.concat(F.lit("Content type: "), F.coalesce(content_type, F.lit("")), F.lit(" (not converted to markdown)"))
    return F.when(error.isNotNull(), failed).when(status != 200, odd).when(~F.coalesce(F.contains(content_type, F.lit("text/html")), F.lit(False)), other)


def fetched(responses: DataFrame, key: str) -> DataFrame:
    """responses(key, status, content_type, error, body) with content: a page's Markdown or its placeholder."""
    told = responses.withColumn("_line", placeholder(F.col("status"), F.col("content_type"), F.col("error")))
    pages = markdown(told.where("_line is null"), key, "body")
    return told.join(pages, key, "left").withColumn("content", F.coalesce("_line", "markdown", F.lit(""))).drop("_line", "markdown")


def source_text(pages: DataFrame, group: str) -> DataFrame:
    """(group, text): the pages(group, position, title, url, content) of each group as one text with a heading for each source."""
    # Headings and rules of the text.
    one = lambda x, i: F.concat(F.lit("\n\n--- SOURCE "), (i + 1).cast("string"), F.lit(": "), x["title"], F.lit(" ---\nURL: "), x["url"], F.lit("\n\nFULL CONTENT:\n "), x["content"], F.lit("\n\n" + "-" * 80 + "\n"))
    listed = pages.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("position", "title", "url", "content"))).alias("x"))  # the pages of one answer
    return listed.select(group, F.concat(F.lit("Search results: \n\n"), F.array_join(F.transform("x", one), "")).alias("text"))
