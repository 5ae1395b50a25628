"""Main text: the labelled table, page kinds with known text, odd rows."""

import html as entities
import re

import pytest

from grounded.llm import html

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tree(spark):
    return html.train(spark)


def test_tree_fits_its_table(tree):
    rows = [(f, row[-1]) for page in html.LABELLED
            for f, row in zip(html.features([("", *r[:-1]) for r in page]), page)]
    assert sum(html.keeps(tree, f) == bool(y) for f, y in rows) >= 0.98 * len(rows)


def article_of(page):
    """Blocks of the article element, for pages whose article holds nothing but headings and paragraphs."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", inner)
    texts = (" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts)
    return "\n\n".join(t for t in texts if t)


def test_articles_of_the_table(spark, tree):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article_of(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in html.extract(pages, tree).collect()}
    assert got == want


PAGES = {
    "sidebar, form and notice": (
        "<body><header><h2>Site name</h2></header><div class='cookie-notice'>We use cookies to make the site work for you.</div>"
        "<aside>Other things to read today, a long list of words that is no part of the article at all.</aside>"
        "<main><h1>Title &amp; more</h1><p>First  paragraph\n of text.</p><p>Ok.</p>"
        "<form><label>Mail</label><input name=m> Send me your best news every week please</form>"
        "<p>Last <b>bold</b><i>italic</i> words&nbsp;here.</p></main><footer>All rights reserved</footer>",
        "Title & more\n\nFirst paragraph of text.\n\nOk.\n\nLast bolditalic words here."),
    "comments after the article": (
        "<article><h1>A</h1><p>Body text of the article.</p></article><section id=comments><h3>Comments</h3>"
        "<article class=comment><p>I have read this long article and I think that it is good, thanks a lot.</p></article></section>",
        "A\n\nBody text of the article."),
    "no marks at all": (
        "<div><a href=/>Home</a></div><div><a href=/a>News</a></div><div><a href=/b>Sport today</a></div><h2>Some plain page heading</h2>"
        + "<div>" + "many plain words of running text " * 8 + "</div><div>short line between</div><div>"
        + "more plain words of running text " * 10 + "</div><div><a href=/x>Contact</a></div>",
        "Some plain page heading\n\n" + ("many plain words of running text " * 8).strip() + "\n\nshort line between\n\n"
        + ("more plain words of running text " * 10).strip()),
    "scripts, styles and comments": (
        "<title>T</title><style>p > b {x}</style><article><script>if (a < b) document.write('<p>no</p>')</script>"
        "<!-- <p>not this > --><p title='a > b' class=\"x\">Yes 1 &lt; 2 &#233;&eacute</p><noscript>no</noscript></article>",
        "Yes 1 < 2 éé"),
    "only navigation": ("<nav><a href=/>Home</a> <a href=/b>About us</a></nav>", ""),
    "nothing closed": ("<article><p>One<p>Two <b>three", "One\n\nTwo three"),
}


@pytest.mark.parametrize("kind", PAGES)
def test_kinds_of_pages(tree, kind):
    assert html.main_text(PAGES[kind][0], tree) == PAGES[kind][1]


def test_odd_rows(spark, tree):
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", "<article><p>" + "x " * 200000 + "</p></article>", 3),
            (4, "u", "<" * 50000 + "a" * 10, 4), (4, "u", "<p title='" * 3000, 5), (5, "u", "<article> </article>", 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    got = {(r.page_id, i): r for i, r in enumerate(html.extract(df, tree).collect())}
    assert len(got) == 6 and got[1, 0].text == "" and got[2, 1].n_chars == 0 and got[None, 2].n_chars == 399999
    assert html.extract(df.limit(0), tree).count() == 0


BODY = "<article><h1>A</h1><p>Body text of the article.</p></article>"
HEADS = ["<head><meta charset=utf-8><title>T</title><body>", "<head><title>T</title>", "<html><head><title>T</title><style>p {x}</style>\n<body>",
         "<head><noscript><link href=x></noscript><script>x</script></head><body>", "<head><noscript><link href=x><body>"]


@pytest.mark.parametrize("start", HEADS)
def test_a_head_ends_where_the_page_begins(tree, start):
    assert html.main_text(start + BODY, tree) == "A\n\nBody text of the article."


@pytest.mark.parametrize("name", ["select", "iframe", "object", "noscript", "svg", "video", "canvas"])
def test_silent_elements(tree, name):
    for start in (f"<div><{name}>no words</div>", f"<body><{name} a=b>no words", f"<{name} />",
                  f"<div><{name}>no <{name}>words</{name}> at all</{name}></div>",
                  f"<div><{name}>no words</div><div><{name}>no </div> words</{name}></div>"):
        assert html.main_text(start + BODY, tree) == "A\n\nBody text of the article.", start


KEPT = ["<section id=\"discussion\"><h2>Discussion</h2><p>We discuss the results of it here.</p></section>",
        "<h2 id=\"related-work\">Related work</h2><p>Others have done this.</p>", "<h2 id=\"social-security\">Social security</h2><p>It is paid.</p>",
        "<p class=\"side-effects\">It makes you sleepy for a while.</p>", "<table class=\"tags\"><tr><td>One cell</td><td>Two cells</td></tr></table>",
        "<address>12 Long Street, Some Town</address>", "<div class=\"search-and-rescue\"><p>The boat was found at night.</p></div>",
        "<ul id=\"tags\"><li>First point of the list</li><li>Second point</li></ul>", "<section class=\"social-security\"><p>It is paid out.</p></section>"]
GONE = ["<div class=\"ad\">Buy this now, it is very cheap today only.</div>", "<div class=\"share-buttons\"><a href=x>Share</a></div>",
        "<div class=\"related-posts\"><p>Other things that you may like to read.</p></div>", "<p class=\"advert\">Buy two of them and pay for one.</p>",
        "<aside>Beside the text stands this.</aside>", "<form><p>Your mail please, so that we can write to you.</p></form>",
        "<section class=\"comments\"><p>I think that this is a very good article.</p></section>", "<div id=\"comments\"><p>I liked this one a lot.</p></div>",
        "<nav><a href=x>Next</a></nav>", "<p hidden>You do not see this one.</p>"]


@pytest.mark.parametrize("inside", KEPT)
def test_text_of_an_article_stays_whatever_its_names(tree, inside):
    page = f"<nav><a href=/>Home</a></nav><article><h1>A</h1><p>Body text of the article.</p>{inside}<p>Its end.</p></article><footer>Foot</footer>"
    words = re.sub(r"<[^>]*>", " ", inside).split()
    assert html.main_text(page, tree).split() == "A Body text of the article.".split() + words + ["Its", "end."]


@pytest.mark.parametrize("inside", GONE)
def test_boilerplate_inside_an_article_goes(tree, inside):
    page = f"<article><h1>A</h1><p>Body text of the article.</p>{inside}<p>Its end.</p></article>"
    assert html.main_text(page, tree) == "A\n\nBody text of the article.\n\nIts end."
