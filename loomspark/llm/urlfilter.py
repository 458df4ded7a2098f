"""Operator 9: URL filters with redirect equivalence, in DataFrame operations only.

Rules (action, host, path) decide a URL whose host is the rule's or a subdomain of it and whose path starts with
the rule's; the longest wins. URLs that redirect to or name each other as canonical are aliases: connected
components over these edges carry a block to every alias that no rule of its own decides, unless the component also
holds a URL that a rule allows. A URL that nothing decides is allowed.

Edges are read from the pages themselves (canonical links, refreshing meta elements; relative targets are resolved against the
page's URL or its base element, character references decoded) and may be added from a redirect log; the SQL twin reads only
absolute targets without references. Only URLs on an edge enter the components; no group is gathered anywhere.

Defined results: a null URL, or one without "://", has an empty host and path, fits no rule and is allowed; a null or empty html
gives no edges; repeated URLs are one node, repeated rows are judged once each; a repeated or null page_id does no
harm; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
# Values in quotes may hold ">"; a tag whose quotes do not close ends at the first one.
_TAG = r"""(?is)<(?:link|meta|base)\b(?:(?:[^>"']++|"[^"<]*+"|'[^'<]*+')*+>|[^>]*+>)"""
# What a browser takes for no markup: comments, and elements whose content is text.
_NO_MARKUP = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(rf"<{name}\b.*?(?:</{name}\b[^>]*+>|\z)" for name in ("script", "style", "template", "textarea", "title", "xmp", "iframe", "noframes"))
_ATTRIBUTE = r"""(?is)^<\w++(?:[^\s"'>]++|\s++|"[^"]*+"|'[^']*+'|["'])*?(?<=[\s"'/])%s\s*+=\s*+("[^"]*+"|'[^']*+'|["']?[^\s"'>]++)"""
_REFERENCE = r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]*(?:;|(?![A-Za-z0-9=;]))|[^&]+|&"
_REFRESH = r"""(?is)^(?:\s*[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?|.*?\burl\s*=\s*)("[^"]*|'[^']*|[^\s"']\S*)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once and written once into the plan, also where a filter is pushed below it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decoded(text: Column) -> Column:
    """The text with its character references decoded, as in an attribute's value."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")

    def numbered(piece: Column) -> Column:
        short = F.regexp_extract(piece, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
        code = F.when(F.length(short) > 8, F.lit(None)).when(piece.rlike("^&#[xX]"), F.conv(short, 16, 10)).otherwise(short).try_cast("long")
        valid = lambda n: n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return _let(code, lambda n: F.when(valid(n), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("�"))

    one = lambda piece: F.when(piece.rlike("^&#[xX]?[0-9a-fA-F]"), numbered(piece)).when(piece.startswith("&"), F.coalesce(names[F.substring(piece, 2, 64)], piece)).otherwise(piece)
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), one), "")


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_replace(F.regexp_extract(tag, _ATTRIBUTE % name, 1), r"""(?s)^(["'])(.*)\1$|^["']""", "$2")


def resolved(base: Column, target: Column) -> Column:
    """A target as a page at base means it; null if it is empty, or relative to a base without "://". Absolute targets stay as they are."""
    site = r"(?s)^(.*?://[^/?#]*)"
    up = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))

    def flat(path: Column) -> Column:
        parts = F.aggregate(F.split(F.substr(path, F.lit(2)), "/"), F.array().cast("array<string>"), up)
        return F.when(path.rlike(r"/\.\.?/"), F.concat(F.lit("/"), F.array_join(parts, "/"))).otherwise(path)

    def joined(v: Column) -> Column:
        t, path = v["t"], v["path"]
        folder = F.concat(v["site"], F.when(path == "", "/").otherwise(F.regexp_extract(path, "(?s)^(.*/)", 1)))
        return F.when(t.startswith("//"), F.concat(F.regexp_extract(v["base"], "(?s)^(.*?:)//", 1), t)).when(t.startswith("/"), F.concat(v["site"], t)).otherwise(F.concat(folder, t))

    def whole(j: Column) -> Column:
        return F.concat(F.regexp_extract(j, site, 1), _let(F.regexp_replace(path_of(j), r"/(\.\.?)$", "/$1/"), flat), F.regexp_extract(j, r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1))

    def found(v: Column) -> Column:
        t = v["t"]
        same = F.when(t.startswith("?"), F.concat(v["site"], v["path"], t)).when(t.startswith("#"), F.concat(F.regexp_extract(v["base"], "(?s)^([^#]*)", 1), t)).otherwise(_let(joined(v), whole))
        return F.when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), t).when((t != "") & (v["site"] != ""), same)

    clean = F.regexp_replace(F.regexp_replace(target, r"[\t\r\n\f]", ""), "^ +| +$", "")
    parts = lambda v: F.struct(v["base"].alias("base"), v["t"].alias("t"), F.regexp_extract(v["base"], site, 1).alias("site"), path_of(v["base"]).alias("path"))
    return _let(F.struct(base.alias("base"), clean.alias("t")), lambda v: _let(parts(v), found))


def page_edges(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between URLs that the pages' canonical links and refreshing meta elements state, all of them, relative ones as the page means them; comments and scripts state none."""
    likely = pages.where("url is not null").where(F.col("html").rlike(r"(?i)\bcanonical\b|http-equiv"))
    tags = likely.select(F.col("url").alias("a"), F.regexp_extract_all(F.regexp_replace("html", _NO_MARKUP, " "), F.lit(_TAG), F.lit(0)).alias("tags"))
    of = lambda name: F.filter("tags", lambda x: F.lower(F.substring(x, 2, 4)) == name)
    links = F.transform(F.filter(of("link"), lambda x: _attribute(x, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)")), lambda x: F.struct(F.lit(False).alias("refresh"), _attribute(x, "href").alias("value")))
    refreshes = F.transform(F.filter(of("meta"), lambda x: F.lower(F.trim(_attribute(x, "http-equiv"))) == "refresh"), lambda x: F.struct(F.lit(True).alias("refresh"), _attribute(x, "content").alias("value")))
    first = F.get(F.filter(F.transform(of("base"), lambda x: _attribute(x, "href")), lambda x: x != ""), F.lit(0))
    found = tags.select("a", first.alias("first"), F.explode(F.concat(links, refreshes)).alias("l"))
    aimed = _let(F.struct(F.col("l.refresh").alias("refresh"), decoded(F.col("l.value")).alias("value")), lambda v: F.when(v["refresh"], F.regexp_replace(F.regexp_extract(v["value"], _REFRESH, 1), "^[\"']", "")).otherwise(v["value"]))
    base = F.coalesce(resolved(F.col("a"), decoded(F.col("first"))), F.col("a"))
    return found.select("a", resolved(base, aimed).alias("b")).where(F.col("b").contains("://"))


def _ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for pages (page_id, url, html); redirects (a, b) adds edges between URLs."""
    edges = page_edges(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select("a", "b"))
    parts = connected_components(edges)
    action = lambda url: _ruled(host_of(url), path_of(url), rules)["action"]
    found = parts.withColumn("action", action(F.col("node")))
    ruled = found.groupBy("component").agg(F.max(F.col("action") == "block").alias("blocked"), F.max(F.col("action") == "allow").alias("allowed"))
    aliases = found.join(ruled.where("blocked and not coalesce(allowed, false)"), "component").select(F.col("node").alias("url"), F.lit("block").alias("inherited"))
    out = pages.select("page_id", "url").join(aliases, "url", "left")
    out = out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "inherited")
    out = out.withColumn("r", _ruled(F.col("host"), F.col("path"), rules))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.action", "inherited", F.lit("allow")).alias("verdict"))


def op9_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
tag AS (
  SELECT url AS a, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?(-->|$)|<script\b.*?(</script[^>]*>|$)|<style\b.*?(</style[^>]*>|$)|<template\b.*?(</template[^>]*>|$)|<textarea\b.*?(</textarea[^>]*>|$)|<title\b.*?(</title[^>]*>|$)', ' ', 'g'),
    '(?is)<(?:link|meta)\b[^>]*>')) AS t FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
edge AS (
  SELECT a, regexp_extract(t, '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1) AS b FROM tag WHERE regexp_matches(t, '(?is)^<link\b.*\srel\s*=\s*["'']?(?:[^"''>]*\s)?canonical\b') UNION ALL
  SELECT a, regexp_extract(t, '(?is)\scontent\s*=\s*["''][^"''>]*url\s*=\s*([^"''\s>]+)', 1) FROM tag WHERE regexp_matches(t, '(?is)^<meta\b.*\shttp-equiv\s*=\s*["'']?refresh\b')),
both_ways AS (SELECT a, b FROM edge WHERE contains(b, '://') UNION SELECT b, a FROM edge WHERE contains(b, '://')),
reach AS (SELECT a AS node, b AS other FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
nodes AS (SELECT DISTINCT other, translate(regexp_extract(other, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(other, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM reach),
node_rule AS (
  SELECT other, arg_max(action, length(h || p)) AS action FROM nodes JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY other),
inherited AS (SELECT node FROM reach JOIN node_rule USING (other) GROUP BY node HAVING bool_or(action = 'block') AND NOT bool_or(action = 'allow')),
best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(action, CASE WHEN inherited.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (page_id) LEFT JOIN inherited ON u.url = inherited.node
"""
