"""Operator 10: main text of web pages by a maximum-scoring subsequence.

A page is read in one linear scan as a sequence of words and tags. Words weigh by the block they stand in and whether a link holds
them, tags weigh negative by name; the contiguous region of the largest sum is the content. An element whose name, class, id or
role speaks against it (a menu, notice, advert, form, comments) is left out with all it holds; so that it does not cut an article
in two, it costs no more than `PASSED`, half a word, however long it is. Where a page marks its content itself (article, main), that content
counts for a region and what stands beside it against one; several articles are all content.

All weights are log odds from labelled pages: pages of the table whose author marks the content with article or main, and a set of
generated pages of common layouts (`examples`), which name the parts that the table's pages may lack. Words outside the content are
held against the outermost element without content, words inside speak for every element around them. No weight of an element
speaks against html, body, main, or anything that holds an article or main; an article is judged by names learned of articles.

The table's pages are a bounded sample (`sample`, those of the lowest hash of page_id); what comes back are sums of counts by
feature, of which the `MOST` commonest are kept. Every page is then read whole.

Defined results: a null or empty html, or a page whose best region is not positive, has an empty text; a page that breaks off
inside a tag, comment, script or reference is read to its end; repeated rows are extracted once each; a null page_id or url is passed on; an empty
table gives no rows; without labelled pages in it the generated ones alone decide; further columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

MOST, PASSED, AGAINST = 2000, 0.5, -1.0
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav noscript ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, or no text of the page.
_RAW = frozenset("script style template textarea title iframe noembed noframes xmp".split())
_HOLDERS = frozenset("html body main".split())
_CONTENT = frozenset("article main".split())
#: Elements whose name itself is evidence.
_NAMED = frozenset("nav header footer aside form dialog menu search fieldset button select noscript head".split())
_KINDS = frozenset("p li h1 h2 h3 h4 h5 h6 td th pre blockquote dt dd figcaption".split())
#: Elements inside which a new block opens beside an unclosed p rather than closing it.
_SCOPES = frozenset("html body table td th li ul ol div section article main blockquote button caption object dd dt figure".split())


class Element:
    __slots__ = ("name", "parent", "features", "kind", "content", "holds", "p", "link", "bad", "top", "out", "words", "outs", "first", "named")

    def __init__(self, name: str, parent: Element | None, rest: str):
        self.name, self.parent = name, parent
        self.content = name in _CONTENT or (parent is not None and parent.content)
        self.link = name == "a" or (parent is not None and parent.link)
        self.kind = name if name in _KINDS else "div" if name in _BLOCK or parent is None else parent.kind
        self.p = name == "p" or (parent is not None and parent.p and name not in _SCOPES)
        self.holds = False
        attrs = {a.lower(): x or y or z for a, x, y, z in _ATTR.findall(rest)} if "=" in rest else {}
        inside = "in:" if parent is not None and parent.content else ""
        own = [inside + name] if name in _NAMED else []
        if name not in _HOLDERS:
            words = (w.lower() for a in ("class", "id", "role") for w in _NAME_PART.findall(attrs.get(a, "")))
            own += [f"{'article' if name == 'article' else ''}.{w}" for w in words]
            if attrs.get("aria-hidden") == "true" or re.search(r"(?i)(?<![\w-])hidden(?![\w-])", _ATTR.sub("", rest)):
                own.append(".hidden")
        self.features = tuple(dict.fromkeys(own))
        self.out = "data-loom-out" in rest

    def block(self) -> str:
        return f"word {self.kind}{' a' if self.link else ''}"


class Page:
    """Tokens of a page: (element, block number, text), with the text None for a tag, whose name the element has."""

    __slots__ = ("tokens", "elements")

    def __init__(self, source: str):
        self.elements = [Element("", None, "")]
        self.tokens: list[tuple[Element, int, str | None]] = []
        stack, open_, at, n, block, tag = [self.elements[0]], Counter(), 0, len(source), 0, _TAG

        def text(part: str) -> None:
            if part:
                self.tokens.append((stack[-1], block, " " if part.isspace() else entities.unescape(part)))

        def close(name: str) -> None:
            while True:
                gone = stack.pop()
                open_[gone.name] -= 1
                if gone.name == name:
                    return

        while at < n:
            cut = source.find("<", at)
            if cut < 0:
                text(source[at:])
                break
            text(source[at:cut])
            if source.startswith("<!--", cut):
                end = source.find("-->", cut + 4)
                at = n if end < 0 else end + 3
                continue
            if source.startswith(("<!", "<?"), cut):
                end = source.find(">", cut)
                at = n if end < 0 else end + 1
                continue
            m = tag.match(source, cut)
            if not m:
                if not (source.startswith("</", cut) or source[cut + 1 : cut + 2].isalpha()):
                    text("<")
                    at = cut + 1
                    continue
                # Quotes that do not close, or no end at all: from here on tags end at the first ">".
                tag = _PLAIN_TAG
                end = source.find(">", cut)
                if end < 0:
                    break
                m = tag.match(source, cut)
                if not m:
                    at = end + 1
                    continue
            closing, name, rest = m[1], m[2].lower(), m[3]
            at = m.end()
            if name in _BLOCK:
                block += 1
            if closing:
                if open_[name]:
                    close(name)
                self.tokens.append((stack[-1], block, None))
            elif name in _RAW and not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.I).search(source, at)
                at = n if end is None else end.start()
                if end is not None:
                    stop = source.find(">", at)
                    at = n if stop < 0 else stop + 1
            elif name not in _VOID and not rest.endswith("/"):
                if name in _BLOCK and stack[-1].p:
                    close("p")
                stack.append(Element(name, stack[-1], rest))
                open_[name] += 1
                self.elements.append(stack[-1])
                self.tokens.append((stack[-1], block, None))

    def judge(self, weights: dict[str, float]) -> bool:
        """Mark the elements that hold content and those left out, these with the outermost one they stand in; tell whether the page marks its content."""
        marked = False
        for e in self.elements:
            own = sum(weights.get(f, 0.0) for f in e.features)
            if e.name in _CONTENT and not e.parent.content and own >= AGAINST:
                marked = True
                up = e
                while up is not None and not up.holds:
                    up.holds, up = True, up.parent
        for e in self.elements:
            up = e.parent
            e.bad = up is not None and (up.bad or (not e.holds and sum(weights.get(f, 0.0) for f in e.features) < AGAINST))
            e.top = (up.top if up.bad else e) if e.bad else None
        return marked and any(e.content and not e.bad and t and t != " " for e, _, t in self.tokens)

    def counts(self, weights: dict[str, float]) -> tuple[Counter, Counter] | None:
        """Words by feature and block, tags by name, inside and outside the content that the page marks; None without such a mark. Weights tell what to leave out of both."""
        if not self.judge(weights):
            return None
        inside, outside = Counter(), Counter()
        for e in self.elements:
            up = e.parent
            e.words, e.outs = 0, ((up.outs if up else ()) + ((e,) if e.out else ()))[:4]
            e.first = up and (up.first or (None if e.holds else e))
            e.named = bool(up) and (up.named or (bool(e.features) and not e.holds))
        for e, _, part in self.tokens:
            if e.content and e.bad and not e.outs:
                continue
            label, n = e.content and not e.outs, max(1, len(part.split())) if part else 1
            if part is None:
                if label or not e.named:
                    (inside if label else outside)[f"tag {e.name}"] += 1
            elif part != " " and label:
                e.words += n
                inside[e.block()] += n
            elif part != " ":
                for x in e.outs or (e.first,):
                    if x:
                        outside.update(dict.fromkeys(x.features, n))
                if not e.named:
                    outside[e.block()] += n
        for e in reversed(self.elements):
            if e.parent:
                e.parent.words += e.words
            for f in e.features:
                inside[f] += e.words
        return +inside, outside


class Weights:
    def __init__(self, inside: dict[str, int], outside: dict[str, int]):
        odds = {k: math.log((inside.get(k, 0) + 1) / (outside.get(k, 0) + 1)) for k in {*inside, *outside}}
        self.feature = {k: max(-5.0, min(3.0, v)) for k, v in odds.items() if not k.startswith(("tag ", "word "))}
        self.word = {k: max(-3.0, min(1.0, v / 3)) for k, v in odds.items() if k.startswith("word ")}
        self.tag = {k[4:]: max(-1.0, min(-0.02, (v - 4) / 8)) for k, v in odds.items() if k.startswith("tag ")}


@functools.cache
def examples(seed: int = 3, pages: int = 300) -> tuple[str, ...]:
    """Generated pages of common layouts. Content stands in main or article; what inside it is none carries `data-loom-out`."""
    r = random.Random(seed)
    words = lambda n: " ".join("".join(r.choice("aeiourstlnmd") for _ in range(r.randint(2, 9))) for _ in range(n))
    link = lambda: f'<a href="/{r.randrange(99)}">{words(r.randint(1, 3))}</a>'
    # Names of parts that are no content, and of parts that hold it.
    menus = "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs skip share social related links tags toc".split()
    parts = "hd header masthead banner topbar ft footer copyright legal sidebar side widget ad ads advert advertisement adsense sponsor sponsored promo promotion cookie cookies consent notice popup modal overlay newsletter subscribe signup login comments comment reply replies respond discussion disqus hidden".split()
    holders = "content main post entry article body text story page wrapper container inner wrap column col row section box layout site single prose".split()

    def part(inside: bool = False) -> str:
        mark = " data-loom-out" if inside else ""
        pick, tag = r.randrange(6), r.choice(["div", "div", "div", "section"])
        if pick == 0 and not inside:
            return r.choice([f"<nav>{link()} {link()} {link()}</nav>", f"<ul><li>{link()}</li><li>{link()}</li></ul>", f"<header>{words(3)}</header>", f"<div>{link()} {link()}</div>"])
        if pick == 1:
            name = r.choice("nav aside form footer button select menu dialog noscript fieldset search".split())
            return f"<{name}{mark}>{r.choice([link, lambda: words(4)])()}</{name}>"
        if pick == 2:
            return f'<{tag} class="{r.choice(menus)}"{mark}>{link()} {link()}</{tag}>'
        if pick == 3 and not inside:
            return r.choice([f"<footer><p>{words(6)}</p></footer>", f'<section id="comments" data-loom-out><article class="comment" data-loom-out><p>{words(9)}</p></article></section>', f"<div>{words(3)}</div>"])
        name = r.choice(parts)
        return f'<{tag} {r.choice(["class", "class", "id"])}="{name}"{mark}{r.choice(["", "", " hidden"])}><p>{words(r.randint(2, 12))}</p></{tag}>'

    def block() -> str:
        pick, n = r.randrange(12), r.randint(8, 40)
        if pick < 6:
            return f"<p>{words(n)} {link() if r.random() < 0.4 else ''} {words(4)}</p>"
        return [
            lambda: f"<h2>{words(4)}</h2>", lambda: f"<ul><li>{words(6)}</li><li>{words(5)} {link()}</li></ul>", lambda: f"<table><tr><td>{words(2)}</td><td>{words(2)}</td></tr></table>",
            lambda: f"<blockquote>{words(n)}</blockquote>", lambda: f"<div>{words(n)}<br>{words(n)}</div>", lambda: f"<figure><figcaption>{words(5)}</figcaption></figure><pre>{words(6)}</pre>",
        ][pick - 6]()

    def page() -> str:
        name = r.choice(["main", "article"])
        body = [block() if r.random() < 0.85 else part(inside=True) for _ in range(r.randint(4, 10))]
        top = f"<header><h1>{words(5)}</h1></header>" if name == "article" and r.random() < 0.4 else f"<h1>{words(5)}</h1>"
        out = f'<{name}><div class="{r.choice(holders)} {r.choice(holders)}">{top}{"".join(body)}</div></{name}>'
        around = [part() for _ in range(r.randint(2, 6))]
        cut = r.randint(1, len(around))
        return f"<html><head><title>{words(3)}</title></head><body>{''.join(around[:cut])}<div class='{r.choice(holders)}'>{out}</div>{''.join(around[cut:])}</body></html>"

    return tuple(page() for _ in range(pages))


@functools.cache
def generated() -> tuple[Counter, Counter]:
    """Counts over the generated pages."""
    inside, outside = Counter(), Counter()
    for source in examples():
        a, b = Page(source).counts({})
        inside += a
        outside += b
    return inside, outside


def extract(source: str | None, weights: Weights) -> str:
    """The blocks of the best region, one on a line."""
    if not source:
        return ""
    page = Page(source)
    marked = page.judge(weights.feature)
    own, best, total, start, region, last, spent = [], 0.0, 0.0, 0, (0, 0), None, 0.0
    for i, (e, _, part) in enumerate(page.tokens):
        # What is passed over: an element left out, or a run of text beside marked content.
        over = e.top if e.bad else page if marked and not e.content else None
        if over is not last:
            last, spent = over, 0.0
        if over is not None:
            w = -min(len(part.split()) if part else 0.0, PASSED - spent)
            spent -= w
            own.append(-1.0)
        elif part is None:
            w = -0.001 if marked else weights.tag.get(e.name, -0.3)
            own.append(0.0)
        else:
            own.append(len(part.split()) * (1.0 if marked else weights.word.get(e.block(), 0.2)))
            w = own[-1]
        if total <= 0:
            total, start = 0.0, i
        total += w
        if total > best:
            best, region = total, (start, i + 1)
    blocks: dict[int, tuple[list[str], list[float]]] = {}
    for i in range(*region):
        e, block, part = page.tokens[i]
        if part is not None and (part == " " or not e.bad) and not (marked and not e.content):
            parts, sums = blocks.setdefault(block, ([], []))
            parts.append(part)
            sums.append(own[i])
    lines = (" ".join("".join(parts).split()) for parts, sums in blocks.values() if marked or sum(sums) > 0)
    return "\n".join(x for x in lines if x)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, outside = Counter(), Counter()
    known = Weights(*generated()).feature
    for b in batches:
        for source in b.column(0).to_pylist():
            if source and (found := Page(source).counts(known)):
                inside += found[0]
                outside += found[1]
    keys = sorted({*inside, *outside})
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())], names=["key", "a", "b"])


def fit(pages: DataFrame, sample: int = 2000) -> Weights:
    """Weights from at most about `sample` labelled pages (page_id, html)."""
    n = pages.select("page_id").where("page_id is not null").count()
    some = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample / max(1, n)))
    sums = some.select("html").mapInArrow(_count, "key string, a long, b long").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows = sums.orderBy(F.desc(F.col("a") + F.col("b")), "key").limit(MOST).collect()
    inside, outside = generated()
    return Weights(inside + Counter({r[0]: r[1] for r in rows}), outside + Counter({r[0]: r[2] for r in rows}))


def _extract(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x, weights) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract(weights), "page_id long, url string, text string, n_chars long")


def op10_maximum_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, fit(pages))
