"""Extraction from pages with and without marked articles, links in articles, and odd rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright.llm import html_extract


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def model(pages):
    return html_extract.fit(pages)


def unmarked(page):
    return page.replace("<article>", "<div>").replace("</article>", "</div>")


def whole(html):
    """All text of a piece of a page."""
    keep = np.zeros(html_extract.N_FEATURES)
    keep[len(html_extract.TAG_GROUPS) + 9] = 50
    return html_extract.TreeModel(keep, np.zeros((2, 2))).extract(html)


def article(page):
    return re.search(r"<article>(.*?)</article>", page, re.S)[1]


@pytest.mark.parametrize(
    "extra",
    [
        '<ul><li><a href="/x">One item</a></li><li><a href="/y">Two item</a></li></ul>',
        '<p><a href="#">Only a link</a></p>',
        "<table><tr><td>Cell</td><td><a href=x>cell two</a></td></tr></table>",
        '<h2><a href="z">Title link</a></h2>',
        "<ol><li>short</li></ol>",
    ],
)
def test_article_keeps_its_links(pages, model, extra):
    for page in pages[:60]:
        assert model.extract(page.replace("</article>", f"{extra}</article>")) == whole(article(page) + extra)


def test_what_is_not_the_article_goes(pages, model):
    inside = '<div class="related"><ul><li><a href=x>Rel</a></li></ul></div><form><label>Name</label><button>Send</button></form>'
    behind = '<div class="comments"><p>A comment here.</p></div><div class="sidebar"><ul><li><a href=x>Rel</a></li></ul></div>'
    for page in pages[:60]:
        assert model.extract(page.replace("</article>", f"{inside}</article>{behind}")) == whole(article(page))


def test_pages_without_marks(pages, model):
    """By a model from marked pages, and by one from a corpus without any mark."""
    want = [whole(article(p)) for p in pages]
    assert [model.extract(unmarked(p)) for p in pages] == want
    other = html_extract.fit([unmarked(p) for p in pages])
    assert [other.extract(unmarked(p)) for p in pages] == want
    assert html_extract.fit([]).extract("<p>a</p><p>b</p>") == "a b"


def test_unmarked_table(spark, pages):
    rows = spark.createDataFrame([(k, "u", unmarked(p)) for k, p in enumerate(pages)], "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.extract(rows, html_extract.train(rows, sample_pages=60)).collect()}
    assert [got[k] for k in range(len(pages))] == [whole(article(p)) for p in pages]


def test_odd_rows_of_the_table(spark, pages, model):
    """Null and empty pages, null and repeated ids, a very long page, clashing names, an empty table."""
    long = pages[1].replace("</article>", "<p>more words. </p>" * 50_000 + "</article>")
    rows = [(1, "u", None), (2, None, ""), (None, "u", pages[0]), (3, "u", pages[0]), (3, "u", pages[0]), (4, "u", long), (5, "u", "<"), (6, "u", "a &lt; b&nbsp;c")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit("x"), "_id": F.lit(1)})
    found = html_extract.extract(table, html_extract.train(table)).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    by_id = {r.page_id: r.text for r in html_extract.extract(table, model).collect()}
    assert by_id[1] == by_id[2] == "" and by_id[None] == by_id[3] == whole(article(pages[0])) and by_id[4] == whole(article(long))
    nothing = table.filter("false")
    assert html_extract.extract(nothing, html_extract.train(nothing)).count() == 0
