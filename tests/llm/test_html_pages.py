"""Hand-written pages, with and without article tags: block texts that are kept, and F1 over all blocks."""

import pytest

from tallyforge.llm.html_extract import LABELLED, blocks, extract, grow, main_text

LONG = "This paragraph tells of the river and the town beside it in more words than a menu ever has, so it must stay on the page."
OTHER = "A second paragraph goes on about the mill, the bridge, the market and the people who came to it every week of the year."
#: (page, texts to keep, texts to drop)
PAGES = [
    (f'<nav><a href="/">Home</a> <a href="/a">About</a></nav><article><h1>River town</h1><p>{LONG}</p><div class="search-results"><p>{OTHER}</p></div><section id="share-prices"><p>{LONG}</p></section></article><footer>Imprint of the site</footer>', ["River town", LONG, OTHER, LONG], ["Home About", "Imprint of the site"]),
    (f'<div class="menu"><ul><li><a href="a">News</a></li><li><a href="b">Sport</a></li></ul></div><h1>Mills</h1><p>{LONG}</p><p>{OTHER}</p><p>It was sold again last spring.</p><div id="footer">Copyright by the paper</div>', ["Mills", LONG, OTHER, "It was sold again last spring."], ["News", "Sport", "Copyright by the paper"]),
    (f'<article><div class="post-header"><h1>Bridge</h1></div><p>{LONG}</p><div class="comment-list"><p>I do not agree with any of this, said a reader at some length.</p></div><div class="related-posts"><a href="x">More bridges</a></div><p>{OTHER}</p><aside>Buy a boat</aside></article>', ["Bridge", LONG, OTHER], ["I do not agree with any of this, said a reader at some length.", "More bridges", "Buy a boat"]),
    (f'<div id="cookie-banner">We use cookies to make this site better for you and others.</div><div><p>{LONG}</p><p>{OTHER}</p></div><form><p>Sign up here</p></form>', [LONG, OTHER], ["We use cookies to make this site better for you and others.", "Sign up here"]),
    (f'<main><p>{LONG}</p><div class="ad-slot-1">Half price today</div><p>Yes.</p></main><div class="sidebar"><p>{OTHER}</p></div>', [LONG, "Yes."], ["Half price today", OTHER]),
]


@pytest.mark.parametrize("at", range(len(PAGES)))
def test_page(at):
    page, keep, _ = PAGES[at]
    assert main_text(page, grow(LABELLED)) == "\n".join(keep)


def test_f1_over_blocks():
    tree, hit, kept, wanted = grow(LABELLED), 0, 0, 0
    for page, keep, drop in PAGES:
        got = main_text(page, tree).split("\n")
        assert {b[0] for b in blocks(page)} == {*keep, *drop}
        hit, kept, wanted = hit + sum(t in keep for t in got), kept + len(got), wanted + len(keep)
    assert 2 * hit / (kept + wanted) >= 0.95


def test_words_and_links_decide():
    """A name that only partly marks boilerplate leaves the choice to words and links."""
    tree = grow(LABELLED)
    part = '<article><p>{0}</p><div class="search-results">{1}</div><p>{0}</p></article>'
    assert main_text(part.format(LONG, f"<p>{OTHER}</p>"), tree) == f"{LONG}\n{OTHER}\n{LONG}"
    assert main_text(part.format(LONG, '<p><a href="x">more of it</a></p>'), tree) == f"{LONG}\n{LONG}"


def test_odd_pages(spark):
    long = "<article>" + f"<p>{LONG}</p>" * 2000 + "</article>"
    rows = [(1, "u", None, "clash"), (2, None, "", "x"), (3, "u", PAGES[0][0], "x"), (3, "u", PAGES[0][0], "x"), (4, "u", long, "x"), (5, "u", "<p>", "x")]
    got = extract(spark.createDataFrame(rows, "page_id int, url string, html string, text string")).collect()
    assert len(got) == 6 and sorted(r.page_id for r in got) == [1, 2, 3, 3, 4, 5]
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == texts[2] == texts[5] == "" and texts[4] == "\n".join([LONG] * 2000)
    assert extract(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0
