from __future__ import annotations

import html
import re

import numpy as np
import pytest

from palletwatch.llm.html_blocks import blocks
from palletwatch.llm.html_extract import FEATURES, LABELLED, describe, extracted, main_text, tree
from tests.llm import labelled_pages

PAGE = """<!DOCTYPE html><html><head><title>Site</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body class=home><header class="site-header"><a href=/>Home</a> Our site</header><nav><ul><li><a href="/a">One</a><li><a href='/b'>Two</a></ul></nav>
<div class="cookie-notice">We use <b>cookies</b> on this site to make everything so much better for all of you.</div>
<article><h1>The &amp; title</h1><p>First&nbsp;paragraph <a href="x">with a link</a> &lt;and&gt; more words in it,
so   that it goes on.<p>Short one.</p><!-- <p>gone</p> --><aside>Read this other thing instead, it is long enough to count.</aside>
<p>Last paragraph, with 3 < 5 and <code>x &gt; y</code> inside.</p><form><label>Your mail address please</label><input></form></article>
<div id="comments"><p>A reader comment that is long enough to look like any text of an article, and then some more.</p></div>
<footer>&copy; 2024 somebody</footer></body></html>"""


def test_article_without_what_stands_beside_it():
    assert main_text(PAGE) == (
        "The & title\nFirst paragraph with a link <and> more words in it, so that it goes on.\nShort one.\n"
        "Last paragraph, with 3 < 5 and x > y inside."
    )


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "</p></div>", "<script>never closed <p>x</p>", "<!-- open", "<a href='x", "a < b > c", "<div " + "x" * 1000])
def test_broken_pages(page):
    assert isinstance(main_text(page), str)


def test_blocks_of_a_page_without_names():
    long = " ".join(["word"] * 40)
    assert main_text(f"<div><a href=a>Home</a></div><div>{long}</div><div>{long}</div><div><a href=b>Next</a></div>") == f"{long}\n{long}"


@pytest.mark.parametrize("aside", [
    '<p class="ad">{}</p>', '<div id=sidebar><p>{}</p><p>{}</p></div>', '<ol class="commentlist"><li>{}<li>{}</ol>',
    '<ul><li class="comment"><p>{}</p><li class=comment>{}</ul>', '<section class="user-comments"><h2>Comments</h2><div>{}</div></section>',
    '<div role="alert">{}</div>', '<form action=/x><p>{}</p></form>', '<div style="display:none">{}</div>', '<aside>{}</aside>',
    '<noscript>{}</noscript>', '<div class="related-posts"><a href=x>{}</a></div>', '<textarea>{}</textarea>', '<div hidden>{}</div>',
])
@pytest.mark.parametrize("inside", [True, False])
def test_asides_of_many_kinds(aside, inside):
    text = "Some words that could be part of the article, if they were not where they are, and so on and on."
    first, last = "The first paragraph of the article with its words.", "And a last one."
    aside = aside.replace("{}", text)
    page = f"<article><p>{first}</p>{aside if inside else ''}<p>{last}</p></article>{'' if inside else aside}"
    assert main_text(page) == f"{first}\n{last}"


def test_header_of_the_page_and_of_the_article():
    page = '<div id="header">Our site</div><article><header><h1>Title</h1></header><ul><li>one<li>two</ul></article>'
    assert main_text(page) == "Title\none\ntwo"


def test_long_page_is_not_cut():
    page = "<article>" + "".join(f"<p>paragraph {i} " + "x " * 30 + "</p>" for i in range(20000)) + "</article>"
    assert main_text(page).count("\n") == 19999


def test_tree_learns_its_table():
    table = np.array(LABELLED)
    assert len(table) <= 200
    for row in table:
        node = tree()
        while node.below:
            node = node.below if row[node.feature] <= node.most else node.above
        assert node.answer == row[-1]


def test_the_table_is_cut_from_the_labelled_pages():
    assert list(LABELLED) == labelled_pages.rows()


def test_the_tree_asks_about_neighbours_and_links():
    asked, left = set(), [tree()]
    while left:
        node = left.pop()
        if node.below:
            asked.add(FEATURES[node.feature])
            left += [node.below, node.above]
    assert {"aside", "main", "density", "words", "paragraph"} <= asked and asked & {"density before", "density after"}


LINKED = '<p><a href="/r">Read the full report by the committee on this matter</a></p>'


@pytest.mark.parametrize("page, want", [
    (f"<article><p>one two</p>{LINKED}<p>three</p></article>", "one two\nRead the full report by the committee on this matter\nthree"),
    ('<article><h2>References</h2><ol><li><a href=a>A first work</a><li><a href=b>Another</a>, 2020</ol></article>', "References\nA first work\nAnother, 2020"),
    ('<article><h1>How to</h1><div class="form-description"><p>Fill in all fields.</p></div><p>Then send it.</p></article>', "How to\nFill in all fields.\nThen send it."),
    ('<article><div class="form-description"><p>Fill in all fields.</p></div></article>', "Fill in all fields."),
    ('<article><div class="post-share-2 related-to-text"><p>one two three</p><p>four five</p></div></article>', "one two three\nfour five"),
    ('<article><p>one two three</p><div class="related-posts"><p>another story</p></div><div class="social share"><p>tell it</p></div></article>', "one two three"),
    ('<article><p>one two</p><div class="ad-300x250"><p>buy it</p></div><section class="reader-comments"><p>I agree</p></section></article>', "one two"),
    ("seven words that stand there without tags", "seven words that stand there without tags"),
    ("<html><body>one line</body></html>", "one line"),
    ('<article><p>one two three</p><div><a href=a>Previous</a> <a href=b>Next</a></div></article>', "one two three"),
])
def test_links_and_names_inside_an_article(page, want):
    assert main_text(page) == want


def test_neighbours():
    found = blocks("<p>one two</p><p><a href=x>three</a></p>")
    assert [tuple(f[:6]) for f in describe(found)] == [(2, 0.0, 0, 0.0, 1, 1.0), (1, 1.0, 2, 0.0, 0, 0.0)]


def test_query_against_the_template(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        want[r["page_id"]] = "\n".join(p for p in parts if p)
    got = extracted(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert {r["page_id"]: r["text"] for r in got.collect()} == want


def test_odd_pages(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "", None), (2, "v", PAGE, "mine")]
    got = extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["text"] != "") for r in got) == [False, False, False, True]
    assert extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("tag", [
    '<svg class="i"/>', "<math/>", "<svg/><svg><path d=x><title>no</title></svg>", "<button>ok", "<object data=x>no", "<canvas>no", "<video src=x>no",
    "<audio>no", "<select><option>no", "<datalist><option>no", "<button>ok<button>no</button>", "<object><p>no</p></object>",
    "<svg><g><svg></svg><text>no</text></g></svg>", "<template><button><p>no</p></template>", "<video-player></video-player>",
])
def test_unclosed_elements_leave_what_follows(tag):
    assert main_text(f"<article><p>one two</p>{tag}<p>three four</p></article>") == "one two\nthree four"
    assert main_text(f"<article><p>one two</p><div>{tag}</div>three four</article><button>x</button>") == "one two\nthree four"


def test_raw_elements_take_the_rest():
    assert main_text("<article><p>one two</p><textarea><p>three four</p></article>") == "one two"


@pytest.mark.parametrize("names", [
    "class=content-sidebar-wrap", "class=has-sidebar", "id=no-sidebar", "class='site-with-ads wide'", "class='post has-comments'",
])
def test_layouts_named_after_an_aside(names):
    long = " ".join(["word"] * 60)
    assert main_text(f"<div {names}><p>{long}</p><p>{long}</p></div>") == f"{long}\n{long}"
    assert main_text(f"<div {names}><article><p>one two</p></article></div>") == "one two"


def test_article_inside_what_only_a_class_names():
    page = '<div class="widget"><main><p>one two</p></main><p>Some words beside it, as many as there are in a paragraph.</p></div>'
    assert main_text(page) == "one two"
    assert main_text('<div class=comments><article class="comment-body"><p>one two</p></article></div>') == ""
    assert main_text("<aside class=widget><article><p>one two</p></article></aside>") == ""
    assert main_text("<div class=widget><nav><article><p>one two</p></article></nav></div>") == ""
