"""Main text of pages: the provided pages against a plain reading of their markup, and pages of other shapes."""

import re
from html import unescape

import pytest
from lodestar.llm import extraction
from pyspark.sql import functions as F

PAGES = "/root/testdata/sf0.01/pages.parquet"
LONG = "It was the best of the times and it was the worst of them all, for they had not been there at all in that year."
DE = "Der Mann ist mit der Frau in die Stadt und sie haben sich dort bei einer von den alten Brücken noch am Abend gesehen."


def plain(html):
    """The generator's one shape: all that stands in the article, cut at its paragraphs."""
    inner = re.search("<article>(.*)</article>", html, re.S)[1].replace("<br>", " ")
    parts = (" ".join(unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
    return "\n".join(p for p in parts if p)


def test_provided_pages(spark):
    pages = spark.read.parquet(PAGES)
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = extraction.report(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("just words", ""),
        (f"<body><div id=menu><a href=a>Home</a></div><div class=text><p>{LONG}</p><p>Short one.</p><p>{DE}</p></div><div class='site-footer'>All rights</div>", f"{LONG}\nShort one.\n{DE}"),
        (f"<ul><li><a href=x>One</a><li><a href=y>Two</a></ul><h2>Title</h2><p>{LONG}<p>End.", f"Title\n{LONG}\nEnd."),
        ("<article><p>Be.</p></article>", "Be."),
        ("<main><p>qzx ### &amp;&lt;p&gt; wq</p><aside>Read on</aside><p>x</p></main>", "qzx ### &<p> wq\nx"),
        (f"<header><p>{LONG}</p></header><article><header><h1>A title</h1></header><p>{DE}</p><footer>By them</footer></article>", f"A title\n{DE}"),
        (f"<form action=x><input name=q><article><p>{LONG}</p></article><label>{DE}</label></form>", LONG),
        (f"<article><p>{LONG}</p><section class='comments'><article><p>{DE}</p></article></section></article>", LONG),
        (f"<article class='post has-comments'><p>{LONG}</p></article><article class=comment><p>{DE}</p></article>", LONG),
        (f"<div class=cookie-notice><p>{LONG}</p></div><div class='has-sidebar'><p>{DE}</p></div>", DE),
        (f"<script>if (a < b) document.write('<p>{LONG}</p>')</script><style>p > a {{}}</style><!-- <p>{LONG}</p> --><p>{DE}</p>", DE),
        (f"<p title='a > b' data-x=\"<p>\">{LONG}</p>", LONG),
        (f"<article><p>a  b\n\tc<br>d&nbsp;e&#x41;&copy;</p><p>{LONG}<b>x</b>y</p></article>", f"a b c d eA©\n{LONG}xy"),
        (f"<article><p>{LONG}</p><p>tail</article><a hre", f"{LONG}\ntail"),
        (f"<nav><a href=/>Home</a><article><p>{LONG}</p></article>", LONG),
        (f"<article><p>{LONG}</p><ul><li><a href=a>Read this one</a></li><li><a href=b>And that one</a></li></ul><p>Yes.</p></article>", f"{LONG}\nYes."),
        (f"<div hidden><p>{LONG}</p></div><div style='display: none'>{LONG}</div><p>{DE}</p>", DE),
        (f"<article><table><tr><td>one<td>two</tr></table><p>1 < 2 & 3 <> 4</p><p>{LONG}</p></article>", f"one\ntwo\n1 < 2 & 3 <> 4\n{LONG}"),
    ],
)
def test_shapes(html, want):
    assert extraction.main_text(html) == want


def test_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, 5), (None, None, "", 6), (1, "u", "<article>x</article>", 7), (1, "u", "<article>x</article>", 7)], "page_id long, url string, html string, text int")
    got = sorted(map(tuple, extraction.report(pages).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (None, None, "", 0), (1, "u", "x", 1), (1, "u", "x", 1)], key=str)
    assert extraction.report(pages.where("false")).count() == 0
    assert extraction.report(pages.select(F.col("page_id").cast("string"), "url", "html")).schema["page_id"].dataType.simpleString() == "string"


def test_hostile_pages_take_linear_time():
    for html in ("<" * 400_000, "<div>" * 60_000 + LONG, "<a b='" * 60_000, "<p " + "x=\"" * 100_000, "<!--" * 100_000, "&" * 400_000, "</div>" * 60_000, "<noscript>" * 20_000):
        extraction.main_text(html)
