"""Operator 5: benchmark decontamination by winnowing.

Of every window of `window` words the smallest k-gram hash is kept (the last one on ties), so a text that
shares such a window with an item shares its fingerprint, at the same place of the window: the join of
fingerprints misses nothing. A hit is extended to the whole window, word by word. Items shorter than a window
are looked up by the hash of all their words instead, at every place of a document.

A bit table of fixed size, made from the items' fingerprints, leaves out most of the documents' fingerprints
before the join; its size does not grow with either table. Fingerprints that pass it carry the words around
them, so texts are read once and never shuffled.

Defined results: null or wordless text has no words and no hits; a null item_id is not listed but its words are
hit; repeated items count once by item_id; rows that share a doc_id are judged apart; empty tables on either
side give documents without hits, or no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, table
from .hashing import ALNUM, Words, blocks, grams

#: Bits of the table that thins out fingerprints: 2 MB, whatever the input.
BITS = 24


def winnowed(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w hashes the place of its smallest, the last one on ties."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1]
    return np.arange(len(view)) + w - 1 - view.argmin(1)


def _windows(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, raw in blocks(texts):
                words = Words(raw, ALNUM)
                out: list[tuple] = []
                for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                    n = b - a
                    if n >= window:
                        h = grams(words.hash[a:b], k)
                        place = winnowed(h, window - k + 1)
                        out += [(ids[at + i], window, int(h[p].view(np.int64)), int(p) - s, words.text(a + s, a + s + window)) for s, p in enumerate(place)]
                    elif n:
                        out.append((ids[at + i], n, int(grams(words.hash[a:b], n)[0].view(np.int64)), 0, words.text(a, b)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["item_id", "n", "fp", "inner", "words"])

    return run


def _slots(h: np.ndarray, n: int) -> np.ndarray:
    return ((h ^ np.uint64(n * 0x9E3779B97F4A7)) >> np.uint64(64 - BITS)).astype(np.int64)


def _fingerprints(window: int, k: int, short: list[int], bits: np.ndarray):
    around = window - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, raw in blocks(texts):
                words = Words(raw, ALNUM)
                first = words.first
                found: list[list[dict]] = [[] for _ in raw]
                doc_of = np.repeat(np.arange(len(raw)), np.diff(first))
                for n in [window, *short]:
                    size = k if n == window else n
                    h = grams(words.hash, size)
                    if not len(h):
                        continue
                    slot = _slots(h, n)
                    keep = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                    keep = keep[doc_of[keep] == doc_of[keep + size - 1]]
                    if n == window and len(keep):
                        # A hash is a fingerprint if it is the smallest of some window of its document.
                        chosen = np.zeros(len(h), bool)
                        for d in np.unique(doc_of[keep]).tolist():
                            own = h[first[d] : max(first[d], first[d + 1] - k + 1)]
                            chosen[first[d] + winnowed(own, window - k + 1)] = True
                        keep = keep[chosen[keep]]
                    for p in keep.tolist():
                        d = int(doc_of[p])
                        lo, hi = (max(int(first[d]), p - around), min(int(first[d + 1]), p + k + around)) if n == window else (p, p + n)
                        found[d].append({"n": n, "fp": int(h[p].view(np.int64)), "at": p - int(first[d]), "lead": p - lo, "words": words.text(lo, hi)})
                kind = pa.list_(pa.struct([("n", pa.int32()), ("fp", pa.int64()), ("at", pa.int64()), ("lead", pa.int32()), ("words", pa.binary())]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + len(raw)], pa.int64()), batch.column(2).slice(at, len(raw)), pa.array(np.diff(first)), pa.array(found, kind)], names=["doc_id", "text_key", "n_words", "found"])

    return run


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose whole window stands in the document: row, window_id, place and number of its words."""
    for b in batches:
        out = []
        for row, at, lead, around, inner, n, text, window in zip(*(b.column(x).to_pylist() for x in ("row", "at", "lead", "around", "inner", "n", "words", "window_id")), strict=True):
            s = lead - inner
            if s >= 0 and around.split(b" ")[s : s + n] == text.split(b" "):
                out.append((row, window, at - inner, n))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["row", "window_id", "place", "n"])


def text_key() -> Column:
    return F.concat_ws(":", F.xxhash64("text").cast("string"), F.hash("text").cast("string"))


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """Per row of documents (doc_id, text): words, hit words and the items with occurring windows.

    text_key, two hashes of the text, lets a caller match rows whose doc_id is null or repeated."""
    items = materialise(benchmark.select("item_id", "text").mapInArrow(_windows(window, k), "item_id long, n int, fp long, inner int, words binary"), "items")
    windows = materialise(items.select("n", "fp", "inner", "words").distinct().withColumn("window_id", F.monotonically_increasing_id()), "windows")
    # The same slots as _slots, as 64-bit words of the table: at most 2**(BITS - 6) rows.
    slot = F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("n").cast("long") * F.lit(0x9E3779B97F4A7)), 64 - BITS)
    table_words = windows.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    bits = np.zeros(1 << BITS - 6, np.int64)
    for w, b in table_words.collect():
        bits[w] = b
    short = sorted(r[0] for r in windows.where(F.col("n") < window).select("n").distinct().collect())
    marked = documents.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(
        _fingerprints(window, k, short, bits.view(np.uint8)), "doc_id long, text_key string, n_words long, found array<struct<n:int,fp:long,at:long,lead:int,words:binary>>"
    )
    marked = materialise(marked.withColumn("row", F.monotonically_increasing_id()), "marked")
    near = marked.select("row", F.explode("found").alias("f")).select("row", "f.n", "f.fp", "f.at", "f.lead", F.col("f.words").alias("around"))
    hits = near.join(windows, ["n", "fp"]).mapInArrow(_confirmed, "row long, window_id long, place long, n int")
    hits = materialise(hits.distinct(), "hits")
    places = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("place", "n"))).alias("p"))
    covered = F.expr("aggregate(p, struct(0L as hit, 0L as upto), (s, x) -> struct(s.hit + greatest(0L, x.place + x.n - greatest(s.upto, x.place)) as hit, greatest(s.upto, x.place + x.n) as upto)).hit")
    where_used = items.join(windows, ["n", "fp", "inner", "words"]).select("window_id", "item_id").where("item_id is not null").distinct()
    used = hits.select("row", "window_id").distinct().join(where_used, "window_id").groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    out = marked.select("row", "doc_id", "text_key", "n_words").join(places.select("row", covered.alias("n_hit")), "row", "left").join(used, "row", "left")
    ids = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    return out.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256")).withColumn(
        "contaminated", F.col("n_hit") > 0
    )


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, p.n, i, item_id FROM places p JOIN win USING (n, t)),
hit_words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
