"""Pages as Markdown: hand-written pages, and the words, headings and links of whole tables."""

from __future__ import annotations

import html
import re

import pytest
from pyspark.sql import functions as F

from tessella.operators import pages

CASES = [
    ("<h1> A  title </h1><p>One <b> two</b> <i>three</i>.</p>", "# A title\n\nOne **two** *three*.".replace("One **two**", "One  **two**")),
    ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\n\nd"), ("<ul><li>x<li>y<ol><li>1<li>2</ol></ul>", "* x\n* y\n    1. 1\n    2. 2"), ('<a href="/u?a=1&amp;b=2">go  on</a><a href="/e"></a>', "[go on](/u?a=1&b=2)"),
    ("<pre>  keep\n   this &lt;b&gt;</pre>", "```\n  keep\n   this <b>\n```"), ("<table><tr><th>a<th>b|c<tr><td>1</table>", "| a | b\\|c |\n| --- | --- |\n| 1 |  |"), ("<blockquote><p>q</p><p>r</p></blockquote>", "> q\n>\n> r"),
    ("x<br>y<hr>z", "x  \ny\n\n---\n\nz"), ("<script>var a='<p>';</script><style>p{}</style><!-- c -->t<img alt='i' src='s.png'>", "t![i](s.png)"), ("<code>a_b</code> <s>old</s>", "`a_b` ~~old~~"),
    ("", ""), ("plain &amp; simple", "plain & simple"), ("</p></div>stray<b>open", "stray**open**"), (None, None), ("<head><title>t</title></head><body>b</body>", "b"), ("<h2></h2>x", "x"),
]


@pytest.mark.parametrize("page, want", CASES)
def test_hand_written_pages(page, want):
    assert pages.to_markdown(page) == want


def plain(page):
    for pattern in (r"(?is)<(head|script|style)\b[^>]*>.*?</\1>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        page = re.sub(pattern, " ", page)
    return html.unescape(page)


def words(t):
    return re.findall(r"\w+", t)


def test_whole_table_keeps_words_headings_and_links(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = table.join(pages.markdown(table, "page_id", "html"), "page_id").collect()
    assert len(rows) == table.count()
    for r in rows:
        shown = re.sub(r"(?m)^(\s*)\d+\. ", r"\1", re.sub(r"(!?\[[^\]]*\])\([^)\s]*\)", r"\1", r["markdown"]))
        assert words(shown.replace("_", "")) == words(plain(r["html"]).replace("_", ""))
        assert len(re.findall(r"(?m)^#{1,6} ", r["markdown"])) >= len(re.findall(r"(?i)<h[1-6][^>]*>[^<]*\w", r["html"]))
        assert len(re.findall(r"\]\(", r["markdown"])) >= len(re.findall(r'(?i)<a [^>]*href="[^"]+"[^>]*>[^<]*\w', r["html"]))


def test_placeholders_and_source_text(spark):
    rows = [(1, 200, "text/html; charset=utf-8", None, "<p>hi</p>"), (2, 200, "application/pdf", None, "x"), (3, 404, "text/html", None, "<p>no</p>"), (4, None, None, "timed out", None), (5, 200, None, None, "x")]
    got = pages.fetched(spark.createDataFrame(rows, "position int, status int, content_type string, error string, body string"), "position")
    assert {r["position"]: r["content"] for r in got.collect()} == {1: "hi", 2: "Content type: application/pdf (not converted to markdown)", 3: "Error: Received status code 404", 4: "Error fetching URL: timed out", 5: "Content type:  (not converted to markdown)"}
    text = pages.source_text(got.where("position < 3").select(F.lit("q").alias("g"), "position", F.lit("T").alias("title"), F.lit("u").alias("url"), "content"), "g").first()["text"]
    line = "-" * 80
    assert text == f"Search results: \n\n\n\n--- SOURCE 1: T ---\nURL: u\n\nFULL CONTENT:\n hi\n\n{line}\n\n\n--- SOURCE 2: T ---\nURL: u\n\nFULL CONTENT:\n Content type: application/pdf (not converted to markdown)\n\n{line}\n"


def test_batches_are_cut_to_few_pages(spark, monkeypatch):
    monkeypatch.setattr(pages, "PAGES", 2)
    rows = spark.createDataFrame([(i, None if i == 3 else f"<p>{i}</p>") for i in range(5)], "page_id long, html string").coalesce(1)
    assert sorted(map(tuple, pages.markdown(rows, "page_id", "html").collect())) == [(i, None if i == 3 else str(i)) for i in range(5)]
