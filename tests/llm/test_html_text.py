"""Main-text extraction on the given pages and on hand-made ones."""

import html
import re
import time

import pytest
from cases import SF_SMALL

from cartlens.llm import html_text, queries

LONG = ("This is the first of the long parts of an article, and it has all the words that are in "
        "the text of a page which you would want to read.")
LONG2 = LONG.replace("first", "second")


def article(page):
    """The given pages' article, by their own markup."""
    body = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", page, re.S).group(1)
    cut = re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))
    return "\n\n".join(t for t in (" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split())
                                   for b in cut) if t)


def test_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    got = queries.op9_html_extraction(spark, SF_SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url,
                                              article(pages[r.page_id].html), len(r.text))


CASES = [
    (None, ""), ("", ""), ("   ", ""), ("<html></html>", ""), ("<p>", ""),
    # menus, headers, footers, sidebars, notices, adverts, forms, comments
    (f"<body><header><h1>Site</h1></header><nav><a href=x>{LONG}</a></nav><article><h1>Title</h1>"
     f"<p>{LONG}</p><div class='ad-box'>{LONG2}</div><p>Short.</p><form><p>{LONG}</p></form>"
     f"<section id=comments><article class=comment><p>{LONG}</p></article></section></article>"
     f"<aside><p>{LONG2}</p></aside><div class='cookieNotice'>{LONG}</div>"
     f"<footer><p>{LONG}</p></footer>", f"Title\n\n{LONG}\n\nShort."),
    # no article tag: stop words, lengths, links and neighbours decide
    (f"<div>Home</div><div><a href=1>One</a> <a href=2>Two</a></div><h2>Head</h2><p>{LONG}</p>"
     f"<p>Yes.</p><p>{LONG2}</p><p><a href=3>{LONG}</a></p><p>Right</p>",
     f"Head\n\n{LONG}\n\nYes.\n\n{LONG2}"),
    # scripts, styles, comments, references, inline tags, white space
    (f"<article><script>var a='</p><p>{LONG}';</script><style>p{{}}</style><!-- <p>{LONG}</p> -->"
     f"<p>A&amp;B &lt;i&gt; caf&eacute; &#8364;\n\t x&nbsp;y <b>bo</b>ld<br>{LONG}</p></article>",
     f"A&B <i> café € x y bold {LONG}"),
    # unclosed elements and cut-off pages
    (f"<nav><ul><li>a<article><p>{LONG}<p>{LONG2}", f"{LONG}\n\n{LONG2}"),
    (f"<article><p>{LONG}</p></article><footer>&copy; x &am", LONG),
    (f"<article><p>{LONG} <b class='x", LONG),
    (f"<article><p>{LONG} 1 < 2</p></article>", f"{LONG} 1 < 2"),
    # an article's own header keeps its heading, hidden parts go
    (f"<article><header><h1>Title</h1></header><p>{LONG}</p><p hidden>{LONG2}</p>"
     f"<div style='display: none'>{LONG2}</div></article>", f"Title\n\n{LONG}"),
    # only short blocks
    ("<article><h1>Title</h1><p>Short.</p></article>", "Title\n\nShort."),
    ("<div>Short.</div>", ""),
]


@pytest.mark.parametrize("page,want", CASES)
def test_hand_made(page, want):
    assert html_text.main_text(page) == want


def test_long_pages_and_odd_rows(spark):
    many = "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>"
    deep = "<div>" * 3000 + f"<p>{LONG}</p>"
    rows = [(1, "u", many, "x", 1), (1, "u", many, "x", 1), (2, None, deep, None, 2),
            (None, "u", None, "x", 3), (3, "u", "<" * 20_000, "x", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, "
                                        "n_chars int")
    got = [tuple(r) for r in html_text.extract(pages).collect()]
    body = "\n\n".join([LONG] * 5000)
    assert sorted(got, key=str) == sorted(
        [(1, "u", body, len(body))] * 2 + [(2, None, LONG, len(LONG)), (None, "u", "", 0),
                                           (3, "u", "", 0)], key=str)
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", [
    f"<html class='no-sidebar'><body class='has-sidebar'><article><p>{LONG}</p></article>",
    f"<div id=content class='with-sidebar'><article><p>{LONG}</p></article>"
    f"<div class=comments><article class=comment><p>{LONG2}</p></article></div></div>",
    f"<main class=search><p>{LONG}</p><div class=ad><p>{LONG2}</p></div></main>",
    f"<article class='post-with-comments'><p>{LONG}</p></article>",
    f"<body class=has-sidebar><p>{LONG}</p></body>",
    f"<article><p>{LONG}</p></article><div class=related><article><p>{LONG2}</p></article></div>",
])
def test_marked_wrappers_keep_their_article(page):
    assert html_text.main_text(page) == LONG


@pytest.mark.parametrize("long", ["Это длинный абзац на языке, слов которого в списке нет. " * 3,
                                  "这是一个很长的段落，其中没有列表中的任何单词。" * 5])
def test_languages_without_stop_words(long):
    long = long.strip()
    page = (f"<nav><a href=1>{long}</a></nav><p><a href=2>{long}</a></p><p>{long}</p>"
            f"<footer>{long}</footer>")
    assert html_text.main_text(page) == long


@pytest.mark.parametrize("n", [12, 12_000])
def test_heads_of_any_length_are_no_text(n):
    page = ("<html><head>" + "<meta name='description' content='x'>" * n + f"<p>{LONG2}</p></head>"
            f"<body><p>{LONG}</p></body>")
    assert html_text.main_text(page) == LONG


def test_time_on_unclosed_raw_tags_is_linear():
    page = "<article><p>" + LONG + "</p>" + "<svg x>" * 200_000
    start = time.perf_counter()
    assert html_text.main_text(page) == LONG
    assert time.perf_counter() - start < 20  # minutes if each looked for its end


@pytest.mark.parametrize("page,want", [
    # names that tell what is there, not what an element is
    (f"<article><div class='article-body no-sidebar'><p>{LONG}</p></div></article>", LONG),
    (f"<div class='content has-sidebar'><p>{LONG}</p></div><div class=sidebar>{LONG2}</div>", LONG),
    (f"<div id='login-page'><p>{LONG}</p><div class='page-footer'>{LONG2}</div></div>", LONG),
    (f"<article data-id='footer'><p>{LONG}</p></article>", LONG),
    (f"<article><p>{LONG}</p><div class='post no-ads comment-list'>{LONG2}</div></article>", LONG),
    # the article wins over the main element, which keeps its title
    (f"<main><h1>Title</h1><article><p>{LONG}</p></article><section><h2>Replies</h2><p>{LONG2}</p>"
     f"</section></main>", f"Title\n\n{LONG}"),
    # but not where the articles are what follows the main text
    (f"<main><p>{LONG}</p><article><p>{LONG2}</p></article></main>", f"{LONG}\n\n{LONG2}"),
    # links inside an article
    (f"<article><p>{LONG}</p><p>See <a href=1>{LONG2}</a> for more of this.</p></article>",
     f"{LONG}\n\nSee {LONG2} for more of this."),
    (f"<article><p>{LONG}</p><ul><li><a href=1>Link</a></li><li>Plain</li><li><a href=2>Link</a>"
     f"</li></ul></article>", f"{LONG}\n\nPlain"),
    # formulas are text, their sources are not
    (f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='tex'>x=2"
     f"</annotation></math></p></article>", f"{LONG} x=2"),
    # quotes count only where a value starts
    (f"<article><p data-x=it's>It's the first. {LONG}</p><p title = 'a>b'>{LONG2}</p></article>",
     f"It's the first. {LONG}\n\n{LONG2}"),
])
def test_marks_links_and_quotes(page, want):
    assert html_text.main_text(page) == want


def test_columns_with_clashing_names(spark):
    pages = spark.createDataFrame([(1, f"<article><p>{LONG}</p>", "old", 7, "p")],
                                  "page_id long, html string, text string, n_chars int, page string")
    got = html_text.extract(pages, keep=("page_id", "text", "n_chars", "page"))
    assert got.columns == ["page_id", "page", "text", "n_chars"]
    assert [tuple(r) for r in got.collect()] == [(1, "p", LONG, len(LONG))]


def test_time_on_tags_that_nothing_ends_is_linear():
    start = time.perf_counter()
    html_text.main_text("<a " + "x=\"1\" y='2' " * 100_000)
    html_text.main_text("<a x='" * 100_000)
    assert time.perf_counter() - start < 20
