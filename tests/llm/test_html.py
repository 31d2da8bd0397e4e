"""Main text of pages: hand-made pages with all that does not belong, awkward markup, and the whole given table."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from auditlake.llm import html_extract
from auditlake.llm.html_extract import main_text
from conftest import SF01

LONG = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."
AROUND = [
    '<nav><ul><li><a href="/a">Menu words</a></li></ul></nav>', f'<header><h1>Site name</h1><p>{LONG}</p></header>', f'<footer>&copy; {LONG}</footer>',
    f'<aside class="x">Aside {LONG}</aside>', f'<div class="ad">Advert {LONG}</div>', f'<div id="cookieNotice">Cookies {LONG}</div>',
    f'<form><label>Name</label><input><textarea>{LONG}</textarea><button>Send</button></form>', f'<script>var a = "</p>{LONG}";</script>',
    f'<style>p {{ content: "{LONG}" }}</style>', f'<!-- <p>{LONG}</p> -->', f'<div class="post-comments"><p>First! {LONG}</p></div>',
    f'<section id="comments"><article class="comment"><p>{LONG}</p></article></section>', f'<div role="alert">Alert {LONG}</div>',
    f'<div style="display: none">Hidden {LONG}</div>', f'<ul class="breadcrumb"><li>{LONG}</ul>', f'<noscript>{LONG}</noscript>',
    f'<div class="sidebar"><p>{LONG}</p></div>', f'<select><option>{LONG}</option></select>', f'<p hidden>{LONG}</p>',
]
BODY = f"<h1>Title &amp; more</h1><p>{LONG}</p><p>x.</p><p>Two<br>lines&nbsp;and <b>bo</b>ld\n\t text</p><ul><li>one<li>two</ul><blockquote><p>{LONG}</p></blockquote><p>end</p>"
TEXT = f"Title & more {LONG} x. Two lines and bold text one two {LONG} end"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div role="main">{}</div>', '<div class="content">{}</div>',
                                  '<div id="page"><div class="post no-ads">{}</div></div>', "<ARTICLE class='a b'>{}</ARTICLE>", "<section>{}</section>"])
@pytest.mark.parametrize("seed", range(6))
def test_everything_around_and_inside_the_article_goes(wrap, seed):
    rng = random.Random(seed)
    before, after, inside = (rng.sample(AROUND, 8) for _ in range(3))
    if "ain" not in wrap.lower() and "article" not in wrap.lower():
        before = [x for x in before if "<h1>" not in x]
    parts = BODY.split("<p>x.")
    body = parts[0] + "".join(x for x in inside if "<h1>" not in x) + "<p>x." + parts[1]
    page = f"<!DOCTYPE html><html><head><title>T {LONG}</title></head><body>{''.join(before)}{wrap.format(body)}{''.join(after)}</body></html>"
    assert main_text(page) == TEXT


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), (" \n", ""), ("<html></html>", ""), ("plain text", "plain text"), ("a < b &lt; c &#100; &#x65; &unknown; &amp", "a < b < c d e &unknown; &"),
    ("<article>short</article>", "short"), ("<p>one<p>two", "one two"), ("<nav>never closed <article><p>one</p></article>", "one"),
    ("<article><p>cut off in the mid", "cut off in the mid"), ("<article><p>cut off in <a hre", "cut off in"), ("<article>a<!-- open <p>b</p>", "a"),
    ("<article>a<script>b", "a"), ("<form><h1>A</h1><p>whole page in a form</p></form>", "A whole page in a form"),
    ("<article><header><h1>Head</h1><p>by me</p></header><p>text</p></article>", "Head text"), ("<article><p title='a>b'>c</p></article>", "c"),
    ("<article><p>a</b></i></div>b</p></article>", "a b"), ("<article>1<br/>2<hr>3</article>", "1 2 3"), ("<article>in<b>li</b>ne</article>", "inline"),
    ("<article><p>a</p><div class='adBox'>no</div><p>b</p></article>", "a b"), ("<article><p class='address'>stays</p></article>", "stays"),
    ("<aside><article>teaser</article></aside><article>main</article>", "main"), ("<div class='ad'>only an advert</div>", "only an advert"),
    ("<article>see <a href=x>this link</a> and <span>that</span></article>", "see this link and that"),
])
def test_awkward_markup(page, text):
    assert main_text(page) == text


def test_surge_and_dive_without_any_marked_element():
    far = "</div></div></div></div><div><div><div><div>"
    page = f"<body><div><div><div><div>Top line{far}<p>{LONG}</p><p>x.</p><p>{LONG}</p>{far}<a href=x>{LONG}</a>{far}Bottom line</div></div></div></div>"
    assert main_text(page) == f"{LONG} x. {LONG}"
    brute = [html_extract.Line(None, g, text="a" * n, linked=k) for n, k, g in [(9, 0, 0), (90, 0, 0), (2, 0, 2), (99, 0, 3), (5, 0, 0), (200, 200, 1), (81, 0, 9)]]
    assert html_extract.spans(brute) == [(0, 3), (3, 5), (6, 7)]


@pytest.mark.parametrize("unit", ["<div>", "<p>", "<a ", '<a "', "<select>", "<", "<!--", "<span hidden>", "</div>", "<div><p>a", "&amp;", "<p class='"])
def test_very_long_pages(unit):
    main_text(unit * 40_000 + "x")


def test_columns_repeats_and_empty_table(spark):
    rows = [(1, "u", "<article>a</article>"), (1, "u", "<article>a</article>"), (None, None, None), (2, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("theirs")).withColumn("n_chars", F.lit("theirs"))
    got = html_extract.extract(df, "page_id", "url")
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "", "", 0)], key=str)
    assert html_extract.extract(df.where("false"), "page_id").count() == 0


def test_query_on_its_whole_table(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    got = html_extract.op11_html_extraction(spark, SF01).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search("<article>(.*)</article>", pages[r["page_id"]]["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("</?b>", "", re.sub("</?(p|h1|br)>", " ", article))).split())
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), pages[r["page_id"]]["url"])
