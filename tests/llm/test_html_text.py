"""Main text of pages: the supplied ones against their articles, and odd markup."""

import html
import re

import pytest

from lotbook.llm import html_text

SF = "/root/testdata/sf0.01"


def test_supplied_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = html_text.extract_pages(pages)
    assert got.columns == [*pages.columns, "_main"]
    for row in got.collect():
        article = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks)
        want = "\n".join(t for t in texts if t)
        assert row._main.text == want and row._main.n_chars == len(want)


PAGE = """<!doctype html><html><head><title>T</title></head><body class="has-sidebar">
<div id="site-header">Head</div><nav><ul><li><a href="/">Home</a><li><a href=x>News</a></ul></nav>
<div class="content"><h1>Title &amp; more</h1><p>Some  text, with <a href="x>y">a
link</a>.<p>Two &lt;b&gt;<br>lines<ul><li>one<li>two</ul><table><tr><td>a<td>b</table></div>
<aside><p>Side text that is long enough to be read, really.</p></aside>
<div class="cookie-notice">We use cookies, many of them, for you.</div>
<section id="comments"><p>A reader says: a long comment, with points.</p></section>
<form><label>Name</label></form><script>var a = "<p>no</p>";</script><!-- <p>no</p> -->
<footer>&copy; us</footer></body></html>"""


def test_boilerplate_is_left_out_without_an_article_element():
    text, _, _ = html_text.main_text(PAGE)
    assert text == "Title & more\nSome text, with a link.\nTwo <b> lines\none\ntwo\na\nb"


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""), ("", ""), ("<p>", ""), ("just text", "just text"), ("<p>a<![foo[x]]>b", "ab"),
        ("<article><p>one</article>", "one"), ("<script>x", ""), ("a < b", "a < b"),
        ("<article><header><h1>H</h1></header><p>b</p></article><header>no</header>", "H\nb"),
        ("<main><div class='ad'>x</div><pre>1\n 2</pre></main>", "1 2"),
    ],
)
def test_odd_markup(source, text):
    assert html_text.main_text(source)[0] == text


def test_very_long_and_repeated_pages(spark):
    long = "<article>" + "<p>word, word.</p>" * 50_000 + "</article>"
    rows = [(1, "u", long), (2, "u", None), (2, "u", None)]
    frame = spark.createDataFrame(rows, "page_id long, text string, html string")
    got = {r.page_id: r._main for r in html_text.extract_pages(frame).collect()}
    assert got[1].text.count("\n") == 49_999 and got[2].n_chars == 0
    assert html_text.extract_pages(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    "raw",
    [
        "<script>for(i=0;i<n;i++){f(i)}</script>", "<script>if (a<b) x = 'it</script>",
        "<STYLE>a<b{}</style >", "<script>s = '<script><!--'</script>", "<title>a <b 'c</title>",
        "<textarea><b 'c</textarea>", "<iframe src=x><i 'c</iframe>",
        "<noscript><style>a<b{}</style></noscript>", "<svg><style>a<b '</style></svg>",
    ],
)
def test_raw_text_ends_at_its_own_closing_tag(raw):
    for page in (f"<body>{raw}<article><p>one</p></article>", f"<article>{raw}<p>one</article>"):
        assert html_text.main_text(page)[0] == "one"
    assert html_text.main_text(f"<p>one{raw[: raw.rindex('<')]}")[0] == "one"


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>x</title><body><article><p>one</article>",
        "<html><head><meta charset=utf-8><style>a{}</style><article><p>one</article>",
        "<head><title>x</title><link rel=a><div><p>one</div>",
        "<body><div><button>Menu</div><article><p>one</article>",
        "<body><button>Menu<article><p>one</article>",
        "<body><button>Menu<div>x</div><button>Next</button><p>one",
        "<body><div><select><option>a<option>b</div><p>one",
        "<body><select><option>a<p>one", "<table><tr><td><select><option>a<td>one</table>",
        "<body><select><option>a<input><p>one", "<div><datalist><option>a</div><p>one",
        "<body><select><optgroup label=x><option>a</optgroup></select><p>one",
        "<div><button><div>Menu</div><span>x</span></button><p>one</div>",
    ],
)
def test_left_out_end_tags_lose_no_text(page):
    assert html_text.main_text(page)[0] == "one"


PROSE = "<p>" + "Some words of a text, with marks. " * 15
LINKS = "<h2>References</h2><ul><li><a href=x>First source</a><li><a href=y>Second source</a></ul>"


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>"])
def test_a_chosen_article_keeps_all_but_boilerplate(frame):
    article = f"<h1>Title</h1>{PROSE}{LINKS}<div class=share><a href=z>Share</a></div>"
    footer = "<footer><a href=a>About us</a> <a href=b>Terms</a></footer>"
    page = f"<nav><a href=/>Home</a></nav>{frame.format(article)}{footer}"
    lines = html_text.main_text(page)[0].split("\n")
    assert lines[0] == "Title" and lines[2:] == ["References", "First source", "Second source"]
