from __future__ import annotations

import html
import re

from silvermart.llm.html_text import blocks, extract
from tests.llm.conftest import SMALL, table

PAGE = """<html><body class="nav-open"><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies</div><div class="wrapper">
<div class="sidebar"><p>about us, a long text here and more text</p></div>
<div class="content"><h2>Title here</h2><div class="post-body">
<p>First para&nbsp;of text, which is   long enough.
<p>Second para &lt;b&gt; with <a href=x>link</a> inside.<ul><li>one item<li>two items</ul>
tail text<hr>after rule<table><tr><td>a<td>b</table></div>
<div class="comments"><p>Nice article! A very long comment that goes on and on for ever</p></div>
</div></div><form><p>Subscribe now</p></form><footer>copyright</footer></body></html>"""


def article(page: str) -> str:
    """The article element's blocks, read off the page by pattern."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    found = []
    for block in re.split(r"</?(?:p|h1)>", inner):
        plain = re.sub(r"<[^>]+>", "", block.replace("<br>", " "))
        found.append(" ".join(html.unescape(plain).split()))
    return "\n".join(b for b in found if b)


def test_article_without_an_article_element():
    assert blocks(PAGE) == [
        "Title here", "First para of text, which is long enough.",
        "Second para <b> with link inside.", "one item", "two items", "tail text", "after rule",
        "a b",
    ]


def paragraphs(name: str, n: int) -> list[str]:
    return [f"{name}{i} " + "the words of it " * 23 + "end" for i in range(n)]


def section(name: str, n: int) -> str:
    return "<div>" + "".join(f"<p>{t}</p>" for t in paragraphs(name, n)) + "</div>"


def test_neighbours_are_judged_one_by_one():
    byline = '<p>By <a href="x">Jane Doe</a></p>'
    more = '<div><p><a href="y">One more</a></p><p><a href="z">Another one</a></p></div>'
    inner = f"<h1>The title</h1>{byline}{section('a', 10)}{section('b', 3)}"
    wanted = ["The title", *paragraphs("a", 10), *paragraphs("b", 3)]
    assert blocks(f"<html><body><div>{inner}</div></body></html>") == wanted
    # Sparse neighbours do not end the way up, on whatever level they stand.
    page = f"<html><body>{more}<div>{inner}</div>{more}{section('c', 2)}</body></html>"
    assert blocks(page) == wanted + paragraphs("c", 2)
    # An article element is the article, whatever its parts' and its neighbours' densities.
    page = f"<body><article>{byline}{section('a', 10)}</article>{section('b', 3)}</body>"
    assert blocks(page) == ["By Jane Doe", *paragraphs("a", 10)]


def test_loose_text_is_judged_with_the_elements_in_it():
    long = "loose words " * 150
    links = '<a href="x">One</a> | <a href="y">Two</a>'
    page = f"<body>{links}{section('a', 10)}{long}and <b>bold</b> ones{section('b', 3)}{links}</body>"
    loose = " ".join(f"{long}and bold ones".split())
    assert blocks(page) == [*paragraphs("a", 10), loose, *paragraphs("b", 3)]


def test_odd_pages():
    assert blocks(None) == [] and blocks("") == [] and blocks("<nav>x</nav>") == []
    assert blocks("plain text <b>only") == ["plain text only"]
    assert blocks("<p>a &amp; b &#233;</p>") == ["a & b é"]
    assert blocks("<script>var a='<p>no</p>'</script><p>yes") == ["yes"]


def test_names_that_say_what_a_part_is():
    page = (
        '<div class="site-header"><p>Our site, your site, all sites</p></div>'
        '<div class="post has-comments" data-id="ad"><div class="post-header"><h1>Head</h1></div>'
        "<p>The text of the article, of some length.</p></div>"
        '<section class="commentList"><p>I say this and that and then some more</p></section>'
        '<div role="complementary"><p>Something beside it</p></div>'
        '<p style="display: none">unseen</p>'
    )
    assert blocks(page) == ["Head", "The text of the article, of some length."]


def test_names_of_layouts_are_not_believed():
    wanted = paragraphs("a", 4)
    text = "".join(f"<p>{t}</p>" for t in wanted)
    beside = '<div class="sidebar"><p>about us, a long text here and more text</p></div>'
    remarks = f'<div class="comments">{section("c", 40)}</div>'
    for name in (
        "elementor-widget-container", "long-form", "page nav-open", "post share-price",
        "layout-right-rail", "search-results", "c-alert-story", "article-body hidden-print",
    ):
        assert blocks(f'<body><div class="{name}">{text}</div></body>') == wanted, name
        page = f'<body>{beside}<div class="{name}">{beside}{text}{remarks}</div>{remarks}</body>'
        assert blocks(page) == wanted, name
        page = f'<body><article><div class="{name}">{text}</div></article></body>'
        assert blocks(page) == wanted, name
    # Several parts of one name, and parts in parts.
    widgets = "".join(f'<div class="widget"><div class="widget-text"><p>{t}</p></div></div>' for t in wanted)
    assert blocks(f"<body><article>{widgets}</article></body>") == wanted
    # A part with the heading is the article even if much else is on the page.
    page = f'<body>{section("b", 3)}<div class="right-sidebar"><h1>Head</h1>{text}</div></body>'
    assert "Head" in blocks(page) and set(wanted) <= set(blocks(page))
    # What is small beside the article, or nothing but links, goes by its name.
    links = "".join(f'<a href="{k}">A link of the menu, number {k}</a>' for k in range(60))
    page = f'<body><div class="menu">{links}</div><div><p>Short one.</p></div><div class="notice">Note</div>'
    assert blocks(page) == ["Short one."]


def test_lists_of_links():
    links = "".join(f'<li><a href="{k}">Source {k}</a></li>' for k in range(3))
    text = "".join(f"<p>{t}</p>" for t in paragraphs("a", 4))
    sources = [f"Source {k}" for k in range(3)]
    page = f"<body><ul>{links}</ul><article>{text}<ul>{links}</ul></article></body>"
    assert blocks(page) == paragraphs("a", 4) + sources
    assert blocks(f"<body><div><ul>{links}</ul>{text}</div></body>") == paragraphs("a", 4)


def test_broken_pages_take_linear_time():
    named = "<div class=ad>x<div class=menu>y" * 15000
    for page in ("<div>" * 30000 + "x", "<a '" * 30000, "<p>x</b>" * 30000, "<p>" * 30000, named):
        blocks(page)


def test_whole_table(spark):
    pages = table("pages")
    got = {r.page_id: r for r in extract(spark.read.parquet(f"{SMALL}/pages.parquet")).collect()}
    assert len(got) == len(pages)
    for page in pages:
        text = article(page["html"])
        assert got[page["page_id"]].text == text
        assert got[page["page_id"]].n_chars == len(text)


def test_nulls_clashes_and_empty_tables(spark):
    rows = spark.createDataFrame(
        [(1, None, None, "old"), (None, "u", "<p>a", "old"), (None, "u", "<p>a", "old")],
        "page_id long, url string, html string, text string",
    )
    got = extract(rows)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [
        (0, "a", 1), (0, "a", 1), (1, "", 0),
    ]
    assert extract(rows.limit(0)).count() == 0
