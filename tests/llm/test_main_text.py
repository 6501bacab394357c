"""Main text of pages: planted pages of many layouts, and the given pages cut by their own tags."""

import html
import re

import pytest

from tamarack.llm import main_text
from tamarack.llm.main_text import main_text as extract

P = ["A first paragraph of some length that says a thing or two about the matter.", "Short.", "Another paragraph, with numbers 1 & 2 < 3, which goes on for quite a while so that it counts as text."]
BODY = "".join(f"<p>{html.escape(p)}</p>" for p in P)
WANT = "\n".join(P)
NAV = "<nav><ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(8)) + "</ul></nav>"
NOISE = {
    "nav": NAV,
    "menu": '<div class="main-menu">' + NAV[5:-6] + "</div>",
    "header": "<header><h2>The site of all sites</h2><p>Since 1999 the place for texts of every kind and for all readers.</p></header>",
    "footer": "<footer><p>&copy; The site of all sites, all rights reserved, in words that go on and on like a paragraph.</p></footer>",
    "aside": "<aside><h3>See also</h3><p>Five things you did not know about the matter at hand, and a sixth one.</p></aside>",
    "sidebar": '<div id="sidebar-right"><p>Popular: a long line of popular things that people read when they are bored.</p></div>',
    "ad": '<div class="ad">Buy one of these things now, they are as cheap as they will ever be, we promise.</div>',
    "cookie": '<div class="cookie-notice"><p>We and our 812 partners value your privacy and store things on your device.</p><button>OK</button></div>',
    "role": '<div role="complementary">Words beside the matter, a lot of them, to be passed over by all.</div>',
    "form": '<form action="/s"><label>Search our whole archive of texts</label><input name="q"><textarea>words</textarea></form>',
    "script": '<script>var t="</p><p>not a paragraph of this page";</script><style>p{color:red}</style><noscript>Please turn scripts on.</noscript>',
    "comment": "<!-- <p>A paragraph that nobody sees</p> -->",
    "hidden": '<p hidden>Not shown to anybody at all.</p><div style="display: none">Nor this.</div>',
    "remarks": '<section id="comments"><h2>3 comments</h2>' + '<article class="comment"><p>I am a reader, and I have a long opinion about this very matter, here it is.</p></article>' * 3 + "</section>",
}


@pytest.mark.parametrize("name", sorted(NOISE))
@pytest.mark.parametrize("wrap", ["article", "main", "div"])
def test_noise_is_left_out(name, wrap):
    open_, close = {"article": ("<article>", "</article>"), "main": ("<main>", "</main>"), "div": ('<div id="page"><div class="post-body">', "</div></div>")}[wrap]
    for before, after in ((NOISE[name], ""), ("", NOISE[name])):
        page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{NAV}{before}{open_}<h1>Title</h1>{BODY}{close}{after}</body></html>"
        assert extract(page) == "Title\n" + WANT
    if name not in ("header", "comment") or wrap != "article":
        page = f"<html><body>{NAV}{open_}<h1>Title</h1>{BODY}{NOISE[name]}{close}</body></html>"
        assert extract(page) == "Title\n" + WANT


def test_blocks_references_and_white_space():
    page = "<article><h1> A&nbsp;title </h1>lead<p>one <b>two</b>\n three<br>four</p><ul><li>a<li>b</ul><p>&lt;p&gt; &amp;amp; &#233; &#x1F600; &copy</p><pre>x\n  y</pre><table><tr><td>1</td><td>2</td></tr><tr><td>3</table></article>"
    assert extract(page) == "A title\nlead\none two three four\na\nb\n<p> &amp; é 😀 ©\nx y\n1 2\n3"


def test_broken_pages():
    assert extract("<article><p><b>One.<br><p>Two.</article><footer>gone") == "One.\nTwo."
    assert extract("<article><p>One.</p><p>Two <a hre") == "One.\nTwo"
    assert extract("<article><p>One.</p><!-- <p>Two") == "One."
    assert extract("<article><p>One.</p><script>var x = '<p>Two</p>'") == "One."
    assert extract("<article><p>One &am") == "One &am"
    assert extract("<article><p>1 < 2 <![if x]>and 3 > 2<? php ?></article>") == "1 < 2 and 3 > 2"
    assert extract("<p>only a line of text without anything around it</p>") == "only a line of text without anything around it"
    for empty in (None, "", "   ", "<html></html>", NAV, "<article></article>"):
        assert extract(empty) == ""


def test_wrappers_with_telling_names_and_headers_of_articles():
    page = f'<body><div class="content has-sidebar">{NAV}<article><header><h1>Title</h1></header>{BODY}</article></div></body>'
    assert extract(page) == "Title\n" + WANT
    page = f'<body><div class="menu"><p>x</p></div><article>{BODY}</article></body>'
    assert extract(page) == WANT


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in main_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1|b|br)>", inner)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_rows(spark):
    long = "<article>" + "<p>A paragraph among very many others.</p>" * 50000 + "</article>"
    rows = [(1, None, None, "x"), (2, "u", "", "y"), (2, "u", "<article><p>a</p></article>", "z"), (3, None, long, None), (None, "u", "<p>b b b b b</p>", "w")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    got = sorted(((r.page_id or 0, r.url, r.n_chars) for r in main_text.extract(df).collect()), key=repr)
    assert got == sorted([(1, None, 0), (2, "u", 0), (2, "u", 1), (3, None, 50000 * 36 - 1), (0, "u", 9)], key=repr)
    assert main_text.extract(df.limit(0)).count() == 0
