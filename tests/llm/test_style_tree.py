"""What the site style tree decides: marked pages, copies, a hot host, names of large wrappers."""

import pytest

from daytrail.llm import site_style

PAGES = "page_id long, url string, html string"


def texts(spark, rows):
    pages = spark.createDataFrame([(i, f"http://{host}/{i}", html) for i, host, html in rows], PAGES)
    return {r["page_id"]: r["text"] for r in site_style.main_text(pages).collect()}


def test_the_tree_judges_pages_with_articles_too(spark):
    rows = [
        (i, "a.org", f"<body><div class=text>Story {i} of many words</div><article class=card>Read on</article>"
            f"<main><p class=own>Part {i}</p><p class=legal>All rights are ours</p></main></body>")
        for i in range(8)
    ]
    rows += [(100 + i, "few.org", f"<div>Outside {i}</div><article>Inside {i}</article>") for i in range(2)]
    got = texts(spark, rows)
    assert got == {i: f"Story {i} of many words\nPart {i}" for i in range(8)} | {100 + i: f"Inside {i}" for i in range(2)}


@pytest.mark.parametrize("tag", ["div", "article"])
def test_copies_of_a_page_are_one_page(spark, tag):
    rows = [(i, "four.org", f"<{tag}><p>The same story</p></{tag}>") for i in range(4)]
    page = "<{0}><p>Story {1}</p></{0}><div class=ad>Buy {2}</div>"
    rows += [(100 + i, "b.org", page.format(tag, max(i, 70), i)) for i in range(100)]
    got = texts(spark, rows)
    assert got == {i: "The same story" for i in range(4)} | {100 + i: f"Story {max(i, 70)}" for i in range(100)}


def test_a_hot_host_with_many_presentations(spark):
    rows = [
        (i, "hot.org", f"<div><p>Text {i}{'<i>x</i>' * (i % 40)}</p></div><div class=end><span>Same end</span></div>")
        for i in range(2000)
    ]
    got = texts(spark, rows)
    assert all(got[i] == f"Text {i}{'x' * (i % 40)}" for i in range(2000))


def test_names_of_wrappers_with_most_of_the_text(spark):
    rows = [
        (1, "c.org", "<html class=has-sidebar><body class='no-widget'><p>Body text</p></body></html>"),
        (2, "c.org", "<div class=comment-page><p>A long text of the page itself</p></div><div class=comments>hm</div>"),
        (3, "c.org", "<form id=f><p>All of it is in a form</p><nav>menu</nav></form>"),
    ]
    assert texts(spark, rows) == {1: "Body text", 2: "A long text of the page itself", 3: "All of it is in a form"}


def test_rare_texts_on_a_node_that_mostly_repeats_stay(spark):
    rows = [(i, "d.org", f"<h1>Title {i}</h1><p>{'Nothing here yet' if i % 4 else f'Own text {i}'}</p>") for i in range(40)]
    got = texts(spark, rows)
    assert got == {i: f"Title {i}" + ("" if i % 4 else f"\nOwn text {i}") for i in range(40)}
