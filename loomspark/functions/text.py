"""Text columns: tokens, sentences, headers, spans, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import DOCUMENT_TYPES

SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])|(?<=[.!?])\s*\n"
HEADER = r"(?md)^(#{1,4})\s+(.+)$"
CAPITALISED = r"\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)*\b"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), SENTENCE_END), strip), lambda s: s != "")


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,text>> of all matches, character offsets from 0, in one pass over the gaps between matches."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(s, pair):
        start = s["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("text")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, zero, step, lambda s: s["out"])).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))


def headers(text: Column) -> Column:
    """array<struct<pos,title>> of the section headers of a stripped text."""
    return F.transform(spans(text, HEADER), lambda s: F.struct(s["start"].alias("pos"), strip(F.regexp_replace(s["text"], r"^#{1,4}\s+", "")).alias("title")))


def section_at(heads: Column, position: Column) -> Column:
    """Title of the last header at or before a position; null before the first."""
    before = F.filter(heads, lambda h: h["pos"] <= position)
    return F.when(F.size(before) > 0, F.element_at(before, -1)["title"])


def suffix(path: Column) -> Column:
    """The lower-cased suffix of a path's last part, or an empty string."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^/.]+)$", 1))


def document_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in DOCUMENT_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(known, suffix(path)), F.lit("plaintext"))


def chunk_id(source: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", source, index.cast("string")), 256), 1, 16)


def capitalised_spans(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(0))


def normalised_name(name: Column) -> Column:
    """Trimmed; names in capitals of more than four characters become title case."""
    n = strip(name)
    return F.when((F.upper(n) == n) & (F.lower(n) != n) & (F.length(n) > 4), F.initcap(F.lower(n))).otherwise(n)


def word_overlap_f1(a: Column, b: Column) -> Column:
    """F1 of the sets of lower-cased words; 0 if either is empty."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    both = F.size(F.array_intersect(x, y))
    p, r = both / F.size(x), both / F.size(y)
    return F.when((F.size(x) > 0) & (F.size(y) > 0) & (both > 0), 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def passage_trim(text: Column, limit: int = 2000) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)
