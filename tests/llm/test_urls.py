"""Operator 9: rules, aliases and defined results."""

import random

from loomspark.llm import urlfilter

ROWS = [
    (1, "http://www.example.com/en/a", None), (2, "http://example.com/en/x?q", ""), (3, "https://A.Example.COM/en/", None), (4, "http://other.com/", None), (5, "http://n.net/es/1", None),
    (6, "http://n.net/de/1", '<link href="http://n.net/fr/9" rel="canonical">'), (7, "http://alias.org/y", "<LINK rel='canonical' href='http://n.net/es/1'>"),
    (8, "http://third.org/", '<meta http-equiv="refresh" content="0; url=http://alias.org/y">'), (9, None, "<p>"), (10, "no scheme/en/", None), (11, "", None),
    (12, "http://mixed.org/", '<link rel=canonical href="http://other.com/">'), (13, "http://mixed2.org/", '<link rel=canonical href="http://mixed.org/">'), (14, "http://n.net/es/2", '<link rel=canonical href="http://mixed.org/">'),
    (15, "http://net", None), (16, "http://com/#/", None), (None, "http://n.net/fr/3#x", None), (5, "http://n.net/es/1", None), (17, "x://y://example.com/en/", None),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(*x, "r", 3) for x in ROWS], "page_id long, url string, html string, rule string, component int").repartition(3)
    got = sorted((tuple(r) for r in urlfilter.judge(df, urlfilter.RULES).collect()), key=str)
    want = [
        (1, "www.example.com", "/en/a", "www.example.com/en/", "allow"), (2, "example.com", "/en/x", "example.com/en/", "block"), (3, "a.example.com", "/en/", "example.com/en/", "block"),
        (4, "other.com", "/", "com/", "allow"), (5, "n.net", "/es/1", "net/es/", "block"), (5, "n.net", "/es/1", "net/es/", "block"), (6, "n.net", "/de/1", None, "block"), (7, "alias.org", "/y", None, "block"),
        (8, "third.org", "/", None, "block"), (9, "", "", None, "allow"), (10, "", "", None, "allow"), (11, "", "", None, "allow"),
        (12, "mixed.org", "/", None, "allow"), (13, "mixed2.org", "/", None, "allow"), (14, "n.net", "/es/2", "net/es/", "block"),
        (15, "net", "", None, "allow"), (16, "com", "/", "com/", "allow"), (None, "n.net", "/fr/3", "net/fr/", "block"), (17, "y:", "//example.com/en/", None, "allow"),
    ]
    assert got == sorted(want, key=str)
    assert urlfilter.judge(df.where("false"), urlfilter.RULES).count() == 0


FORMS = [
    ("http://p.org/a/b?q#f", '<link rel="canonical" href="/es/1">', ["http://p.org/es/1"]), ("https://p.org/a/b", "<link href='//a.net/es/1' rel='canonical'>", ["https://a.net/es/1"]),
    ("http://p.org/a/b", "<link rel=canonical href=c/./d/../e>", ["http://p.org/a/c/e"]), ("http://p.org", "<link rel=canonical href=x>", ["http://p.org/x"]), ("http://p.org/a/b/", "<link rel=canonical href='../..'>", ["http://p.org/"]),
    ("http://p.org/a/b?q", "<link rel=canonical href='?r=1'>", ["http://p.org/a/b?r=1"]), ("http://p.org/a", '<link rel="canonical" href="/go?u=http://b.net/../x">', ["http://p.org/go?u=http://b.net/../x"]),
    ("http://p.org/a", '<link rel="alternate Canonical" title="a > b" href="http://b.net/?a=1&amp;b=2&copy=3&#47;&#x2F;&#38;amp;">', ["http://b.net/?a=1&b=2&copy=3//&amp;"]),
    ("http://p.org/a", '<meta http-equiv="refresh" content="0; url=/es/1">', ["http://p.org/es/1"]), ("http://p.org/a", """<META content="0;URL='http://b.net/es/1'" http-equiv=Refresh>""", ["http://b.net/es/1"]),
    ("http://p.org/a", '<meta http-equiv=refresh content=0;url=http://b.net/es/1>', ["http://b.net/es/1"]), ("http://p.org/a", "<meta http-equiv='refresh' content='5, http://b.net/es/1'>", ["http://b.net/es/1"]),
    ("http://p.org/a", '<meta http-equiv="refresh" content="0; url=&quot;/es/1&quot;">', ["http://p.org/es/1"]), ("http://p.org/a", '<meta http-equiv="refresh" content="30"><link rel="stylesheet" href="/canonical">', []),
    ("http://p.org/a", '<base href="//c.net/d/"><link rel="canonical" href="e"><link rel="canonical" data-href="/n" href="/f"/><meta http-equiv="refresh" content="1;url=g"><meta http-equiv="refresh" content="2;url=h">', ["http://c.net/d/e", "http://c.net/d/g", "http://c.net/d/h", "http://c.net/f"]),
    ("no scheme", "<link rel=canonical href=/x>", []), ("http://p.org/a", "<link rel=canonical href=''><link rel=canonical href='mailto:a@b.c'><link rel=canonical href='&#0;&#xD800;&#99999999999;://'>", ["http://p.org/\ufffd\ufffd\ufffd://"]),
]


def test_every_form_of_link_gives_its_edge(spark):
    got = urlfilter.page_edges(spark.createDataFrame([(u, h) for u, h, _ in FORMS], "url string, html string")).collect()
    assert sorted(map(tuple, got)) == sorted((u, x) for u, _, want in FORMS for x in want)


def test_relative_aliases_inherit_a_block(spark):
    rows = [(1, "http://n.net/de/1", '<link rel="canonical" href="/es/1">'), (2, "http://b.org/x", "<meta http-equiv='refresh' content='0; url=//n.net/fr/2?a=1&amp;b=2'>"), (3, "http://c.org/", "<link rel=canonical href=/d>"), (4, "http://c.org/d", '<meta http-equiv="refresh" content="1"><meta http-equiv="refresh" content="0;http://n.net/es/4">')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(df, urlfilter.RULES).collect()} == dict.fromkeys((1, 2, 3, 4), "block")


def test_a_redirect_log_adds_edges(spark):
    df = spark.createDataFrame([(1, "http://a.org/", None), (2, "http://b.net/es/", None)], "page_id long, url string, html string")
    log = spark.createDataFrame([("http://a.org/", "http://b.net/es/"), (None, "http://a.org/")], "a string, b string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(df, urlfilter.RULES, log).collect()} == {1: "block", 2: "block"}


def test_the_plan_has_no_python(spark, capsys):
    urlfilter.op9_redirect_equivalence(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan
    assert "Arrow" not in plan


def test_many_linked_pages_against_breadth_first_search(spark):
    """Chains, stars and conflicts, with links in comments and scripts that state nothing, and several links on a page."""
    r = random.Random(7)
    hosts = ["a.net/es", "b.org/x", "c.com/y", "d.net/de", "e.org/z"]
    urls = [f"http://{r.choice(hosts)}/{i}" for i in range(400)]
    links: dict[str, set[str]] = {u: set() for u in urls}
    pages = []
    for i, u in enumerate(urls):
        html = ""
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            to = urls[i - 1] if i % 7 and r.random() < 0.5 else urls[i // 50 * 50] if r.random() < 0.5 else r.choice(urls)
            form = r.randrange(5)
            tag = f'<link rel="canonical" href="{to}">' if form % 2 else f'<meta http-equiv="refresh" content="0; url={to}">'
            if form < 3:
                html += tag
                links[u].add(to)
                links[to].add(u)
            else:
                html += f"<!-- {tag} -->" if form == 3 else f"<script>var x = '{tag}';</script>"
        pages.append((i, u, f"<html><head>{html}</head></html>"))
    own = lambda u: "block" if ".net/es/" in u else "allow" if ".com/" in u else None
    want, seen = {}, set()
    for u in urls:
        if u in seen:
            continue
        part, queue = {u}, [u]
        while queue:
            for v in links[queue.pop()] - part:
                part.add(v)
                queue.append(v)
        seen |= part
        found = {own(v) for v in part}
        for v in part:
            want[v] = own(v) or ("block" if "block" in found and "allow" not in found else "allow")
    assert len({want[u] for u in urls}) == 2 and any(own(u) is None and want[u] == "block" for u in urls)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.verdict for r in urlfilter.judge(df, urlfilter.RULES).collect()}
    assert got == {i: want[u] for i, u, _ in pages}
