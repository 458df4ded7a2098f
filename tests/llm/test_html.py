"""Operator 10: labelled pages of other layouts and broken markup."""

import re
import time

import duckdb
import pytest

from loomspark.llm import htmltext

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def weights(spark):
    return htmltext.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def article_blocks(source):
    """The pages of these tables are an article of h1 and p after nav and advert, sometimes broken off after the footer."""
    import html

    inside = re.search(r"<article>(.*?)(?:</article>|$)", source, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p|br)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_whole_table(spark, weights):
    rows = duckdb.connect().execute(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in htmltext.op10_maximum_subsequence(spark, SF).collect()}
    assert len(got) == len(rows)
    for page, source in rows:
        assert got[page].text == article_blocks(source)
        assert got[page].n_chars == len(got[page].text)


WORDS = "It was a long day for all of them and nobody knew what was going to come next in the story."


def test_other_layouts(weights):
    page = f"""<html><head><title>T</title><style>p {{}}</style></head><body><header><a href=/>Home</a> <a href=/x>About us</a></header><div class="sidebar"><p>Latest posts and other things</p></div>
    <main><h1>Title here</h1><p>{WORDS}</p><div class="cookie-notice">We use cookies</div><p>Fish &amp; chips &#8211; {WORDS}</p><form><p>Sign up now</p></form><ul><li>First item of this list</li></ul></main>
    <section id="comments"><p>Nice post, thanks a lot for it!</p></section><footer>All rights reserved</footer></body></html>"""
    assert htmltext.extract(page, weights) == f"Title here\n{WORDS}\nFish & chips – {WORDS}\nFirst item of this list"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<body class="has-sidebar"><article><p>{WORDS}</p></article></body>', WORDS),
        (f'<body class="post no-comments"><main><p>{WORDS}</p></main></body>', WORDS),
        (f'<article class="legal-news"><p>{WORDS}</p></article>', WORDS),
        (f'<div class="content-sidebar-wrap"><main><p>{WORDS}</p></main></div>', WORDS),
        (f'<article><p>{WORDS}</p><div class="advert">{WORDS * 5}</div><p>Two words</p></article>', f"{WORDS}\nTwo words"),
        (f"<article><p>First {WORDS}</p></article><aside>{WORDS * 3}</aside><article><p>Second</p></article>", f"First {WORDS}\nSecond"),
        (f'<div class="hd">My site name</div><div class="x1"><h1>Title of it</h1><p>{WORDS}</p></div><div class="ft">Copyright by us all rights</div>', f"Title of it\n{WORDS}"),
        (f'<ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><div id="content">{WORDS}<br>{WORDS}</div><div id="comments"><p>{WORDS}</p></div>', f"{WORDS}\n{WORDS}"),
        (f'<article><header><h1>Head</h1></header><p>{WORDS}</p><footer>share it</footer></article><section id="comments"><article class="comment"><p>{WORDS}</p></article></section>', f"Head\n{WORDS}"),
        (f"<main><p>{WORDS}</p><p>where <math><mi>x</mi></math> is</p><button>Go<p>{WORDS}</p></main>", f"{WORDS}\nwhere x is"),
        (f'<div class="entry"><p>{WORDS}</p><ul><li>one item</li><li>other <a href=q>link here</a> item</li></ul></div>', f"{WORDS}\none item\nother link here item"),
    ],
)
def test_names_adverts_and_several_articles(weights, page, text):
    assert htmltext.extract(page, weights) == text


@pytest.mark.parametrize("junk", ["<font>x ", "<div>x", "<p><b>x", "<a '> ", '<a "x> ', "<div></p>", "</b><b>", "<", "<!--", "<p hidden><ul>"])
def test_time_is_linear_in_junk(weights, junk):
    def seconds(n):
        began = time.process_time()
        htmltext.extract(junk * n, weights)
        htmltext.Page(junk * n).counts(weights.feature)
        return time.process_time() - began

    n = 40_000 // len(junk)
    seconds(n)
    assert seconds(8 * n) < 24 * seconds(n) + 0.5


def test_generated_pages_are_labelled_apart(weights):
    wrong = 0
    for source in htmltext.examples():
        page = htmltext.Page(source)
        page.judge(weights.feature)
        page.counts(weights.feature)
        wrong += any(part and part != " " and (e.content and not e.outs) != (e.content and not e.bad) for e, _, part in page.tokens)
    assert wrong <= len(htmltext.examples()) // 100


def test_defined_results(spark, weights):
    assert htmltext.extract(None, weights) == htmltext.extract("", weights) == ""
    for broken in ("<", "<p", "<p>a<script>x", "<!-- x", "</", "a < b", "<article><p>" + WORDS, "&#0; &#xFFFFFFFF;", "<p class='x>" + WORDS):
        assert isinstance(htmltext.extract(broken, weights), str)
    assert htmltext.extract("<article><p>" + WORDS, weights) == WORDS
    rows = [(1, "u", "<article><p>" + WORDS + "</p></article>", "x"), (1, "u", "<article><p>" + WORDS + "</p></article>", "x"), (None, None, None, "y"), (2, "v", "<nav>a b c</nav>", "z"), (3, "w", "<article>" + f"<p>{WORDS}</p>" * 20_000 + "</article>", "l")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    got = sorted((tuple(r) for r in htmltext.main_text(df, htmltext.fit(df)).collect()), key=str)
    assert [(r[0], r[3]) for r in got] == sorted([(1, len(WORDS)), (1, len(WORDS)), (None, 0), (2, 0), (3, 20_000 * (len(WORDS) + 1) - 1)], key=str)
    assert htmltext.main_text(df.where("false"), htmltext.fit(df.where("false"))).count() == 0
