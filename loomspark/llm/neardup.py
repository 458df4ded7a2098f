"""Operator 7: near duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all coordinates: the first scatters the shingle hashes, the second is applied after a
circular shift by k for coordinate k. There are as many bands of 5 coordinates as it takes to miss a pair at the
threshold with a probability of 1e-6 (24 for 0.85, 35 for 0.8). Texts of one shingle set are one node from the start.
One bit of each coordinate makes a sketch of a few machine words: two sets at the threshold differ in more than
`most_unequal` of its bits with a probability of 1e-7, and pairs that do are dropped before any set is moved. Every other pair
is confirmed on full sets, which are made only for texts that some pair needs.

A bucket may hold a third of all documents, so its pairs are never listed. Links are found in passes, each
verified on full sets and followed by components, so that a later pass asks only for pairs across components:
1. every member against the bucket's smallest node;
2. all pairs of a bucket of at most `few` members; of a larger one the members outside its main component against some of that;
3. in larger buckets with at most `few` members still outside, these against all others; in the rest prefix filtering: with the
   shingles of each set in order of rarity, a pair whose first common shingle comes too late in either set cannot reach the
   threshold, so the first shingles are finer buckets, whose members meet the smallest node of each;
4. what is then still apart within those finer buckets, as far as position, size and sketch allow a link.
So no pair that shares a bucket is left undecided: it is verified, refuted, or joined through others. Passes without a pair cost nothing.
Up to `at_once` pairs or links are broadcast or joined into components on the driver, for a round of shuffles costs more than they do;
more of them take the same steps through shuffles, with the same result.

Defined results: null, empty or wordless text has an empty set, is linked with nothing and kept; rows that share a doc_id are
judged apart, each by its own text; a null doc_id has a null component and is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.joins import small
from ..session import materialise, release, table
from .hashing import NONSPACE, Words, blocks, grams, mix

ROWS = 5
#: Slots of the table that orders shingles by rarity: 1 MB, whatever the input.
SLOTS = 1 << 18
_SUMMARY = "doc_id long, text_key long, n_shingles long, h1 long, h2 long, bands array<long>, sketch array<long>"


def bands_for(similarity: float, rows: int = ROWS, miss: float = 1e-6) -> int:
    """Bands that a pair of this similarity shares none of with a probability of `miss` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows))) if similarity < 1 else 1


def most_unequal(bits: int, similarity: float, miss: float = 1e-7) -> int:
    """Unequal bits that two sketches of sets of this similarity exceed with a probability of `miss` at most."""
    p, total = (1 - similarity) / 2, 0.0
    for n in range(bits + 1):
        total += math.comb(bits, n) * p**n * (1 - p) ** (bits - n)
        if 1 - total <= miss:
            return n
    return bits


def shingle_sets(raw: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of k-word shingles of each text; a text of fewer words is one shingle."""
    words = Words(raw, NONSPACE)
    hashes, out = grams(words.hash, k), []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(hashes[a : b - k + 1]))
        else:
            out.append(np.array([len(words.hash[a:b])], np.uint64) + grams(words.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n circulant coordinates of each non-empty set, a row each."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])[:-1]
    first = (mix(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), n), np.uint32)
    for k in range(n):
        v = (first + np.uint32(k)) * np.uint32(0x7FEB352D)
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x846CA68B)
        v ^= v >> np.uint32(16)
        out[:, k] = np.minimum.reduceat(v, at)
    return out


def _summaries(k: int, bands: int, rows: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for at, raw in blocks(texts):
                sets = shingle_sets(raw, k)
                full = [i for i, x in enumerate(sets) if len(x)]
                h1, h2 = [None] * len(sets), [None] * len(sets)
                keys, sketches = [[]] * len(sets), [[]] * len(sets)
                if full:
                    some = [sets[i] for i in full]
                    sig = signatures(some, 64 * words)
                    bits = np.packbits((sig & 1).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
                    sig = sig[:, : bands * rows].astype(np.uint64).reshape(len(full), bands, rows)
                    band = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                    for r in range(rows):
                        band = mix(band + sig[:, :, r])
                    cuts = np.concatenate([[0], np.cumsum([len(x) for x in some])])[:-1]
                    flat = np.concatenate(some)
                    one, two = (np.add.reduceat(mix(flat + np.uint64(salt)), cuts).view(np.int64).tolist() for salt in (1, 0x5851F42D4C957F2D))
                    for j, i in enumerate(full):
                        h1[i], h2[i], keys[i], sketches[i] = one[j], two[j], band[j].view(np.int64), bits[j]
                long, many = pa.int64(), pa.list_(pa.int64())
                own = [batch.column(c).slice(at, len(raw)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(x) for x in sets], long), pa.array(h1, long), pa.array(h2, long), pa.array(keys, many), pa.array(sketches, many)], names=["doc_id", "text_key", "n_shingles", "h1", "h2", "bands", "sketch"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in blocks(batch.column(1).to_pylist()):
                sets = shingle_sets(raw, k)
                cut = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                values = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(raw)), pa.ListArray.from_arrays(pa.array(cut), values)], names=["node", "items"])

    return run


class _Near:
    """Whether two members (node, size, sketch) may be linked, by size (exactly) and sketch."""

    def __init__(self, percent: int, words: int, most: int):
        self.percent, self.words, self.most = percent, words, most

    def __call__(self, x: str, y: str) -> Column:
        unequal = sum((F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(self.words)), F.lit(0))
        sizes = 100 * F.least(f"{x}.size", f"{y}.size") >= self.percent * F.greatest(f"{x}.size", f"{y}.size")
        return sizes & (unequal <= self.most)


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task's sets fall into each slot."""
    total = np.zeros(SLOTS, np.int64)
    for b in batches:
        total += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False) & (SLOTS - 1), minlength=SLOTS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])


def _first_shingles(counts: np.ndarray, percent: int):
    """For each set the shingles of its prefix with their place in it, in order of their slot's count. One that is alone in its slot is in no other set, but keeps its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, places, kept = [], [], []
            for i in range(b.num_rows):
                items = b.column("items")[i].values.to_numpy(zero_copy_only=False)
                n = counts[items & (SLOTS - 1)]
                order = np.lexsort((items, n))[: len(items) + percent * len(items) // -100 + 1]
                at = np.flatnonzero(n[order] > 1)
                rows.append(np.full(len(at), i))
                places.append(at)
                kept.append(items[order[at]])
            if rows:
                own = b.drop_columns(["items"]).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.concatenate(places), pa.int64()), pa.array(np.concatenate(kept), pa.int64())], names=[*own.schema.names, "at", "band"])

    return run


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links between a and b, and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = list(range(len(nodes)))

    def root(i: int) -> int:
        while low[i] != i:
            low[i] = i = low[low[i]]
        return i

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        low[max(x, y)] = min(x, y)
    for i, x in enumerate(low):  # x is at most i
        low[i] = low[x]
    return nodes, nodes[np.array(low, np.int64)]


def _prefixes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The first shingles of members (node, ...): a link shares at least percent of either set, so it shares one of these.

    Any order of all shingles will do. This one is by counts in a table of fixed size, so that rare shingles come first."""
    own = materialise(members.join(sets, "node"), "prefix-sets")
    counts = np.zeros(SLOTS, np.int64)
    for slot, n in own.select("items").mapInArrow(_counted, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():
        counts[slot] = n
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields if f.name != "items"]
    out = own.mapInArrow(_first_shingles(np.minimum(counts, 2**32 - 1).astype(np.uint32), percent), ", ".join([*fields, "at long", "band long"]))
    out.scratch = own.scratch
    return out


def near_duplicates(documents: DataFrame, k: int = 5, similarity: float = 0.8, bands: int | None = None, rows: int = ROWS, hubs: int = 4, few: int = 16, at_once: int = 100_000) -> DataFrame:
    """For every row of documents (doc_id, text): doc_id, n_shingles, component_id, kept, text_key (a hash of the text), part.

    part tells components apart also where doc_ids repeat; it is null without a set or an id."""
    percent, bands = round(100 * similarity), bands or bands_for(similarity, rows)
    words = -(-bands * rows // 64)
    near = _Near(percent, words, most_unequal(64 * words, similarity))
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    summary = materialise(docs.mapInArrow(_summaries(k, bands, rows, words), _SUMMARY), "summary")
    same = ["h1", "h2", "n_shingles"]
    reps = summary.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.first(F.struct("bands", "sketch")).alias("s"))
    reps = materialise(reps.select(F.monotonically_increasing_id().alias("node"), *same, "one.doc_id", "one.text_key", "s.bands", "s.sketch"), "reps")
    entries = reps.select(F.explode("bands").alias("band"), "node")
    shared = entries.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where("n > 1")
    kin = reps.select("node", F.col("n_shingles").alias("size"), "sketch")
    members = materialise(entries.join(shared, "band").join(kin, "node").select("band", "n", "hub", "node", "size", "sketch"), "members")

    large = members.where(F.col("n") > few)
    x, y = members.where(F.col("n") <= few).alias("x"), members.where(F.col("n") <= few).alias("y")
    within = x.join(y, F.col("x.band") == F.col("y.band")).where((F.col("x.node") < F.col("y.node")) & near("x", "y")).select(*_pair("x", "y"), (F.col("x.node") == F.col("x.hub")).alias("star"))
    x, y = large.alias("x"), large.where("node = hub").alias("y")
    star = x.join(y, F.col("x.band") == F.col("y.band")).where((F.col("x.node") != F.col("y.node")) & near("x", "y")).select(*_pair("x", "y"), F.lit(True).alias("star"))
    close = materialise(within.unionByName(star).groupBy("a", "b").agg(F.max("star").alias("star")), "close")
    wanted = close.select(F.explode(F.array("a", "b")).alias("node")).unionByName(large.select("node")).distinct()
    wanted = materialise(reps.select("node", "doc_id", "text_key").join(wanted, "node"), "wanted")
    sets = docs.join(small(wanted, 200_000), ["doc_id", "text_key"]).select("node", "text").mapInArrow(_sets(k), "node long, items array<long>")
    sets = materialise(sets, "sets")

    def verified(pairs: DataFrame, n: int, label: str) -> DataFrame:
        if n <= at_once:
            right = sets.join(F.broadcast(pairs), F.col("node") == F.col("b")).select("a", "b", F.col("items").alias("y"))
            left = sets.join(F.broadcast(pairs.select(F.col("a").alias("node")).distinct()), "node", "left_semi")
            both = right.join(left.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
        else:
            nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            some = sets.join(small(nodes, 50_000), "node", "left_semi")
            left = some.select(F.col("node").alias("a"), F.col("items").alias("x"))
            right = some.select(F.col("node").alias("b"), F.col("items").alias("y"))
            both = pairs.join(right, "b").join(left, "a")
        common = F.size(F.array_intersect("x", "y"))
        seen = both.where(100 * common >= percent * (F.size("x") + F.size("y") - common))
        return materialise(seen.select("a", "b"), f"links-{label}")

    nothing = kin.where("false").select("node", F.col("node").alias("component"))
    known_rows: float = 0  # of the components so far, infinite if they were too many for the driver

    def light(parts: DataFrame) -> DataFrame:
        """Components, or as many rows, marked for broadcast where they are few."""
        return F.broadcast(parts) if known_rows <= 2 * at_once else parts

    def joined(parts: DataFrame, pairs: DataFrame, label: str) -> DataFrame:
        """The components with the links among pairs. Those so far stand for the links so far: each node with its smallest one."""
        nonlocal known_rows
        pairs = materialise(pairs.select("a", "b"), f"pairs-{label}")
        n = pairs.count()
        if not n:
            return parts
        links = verified(pairs, n, label)
        n = links.count()
        if not n:
            return parts
        known = parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        edges = known.unionByName(links)
        if n + known_rows <= at_once:
            here = edges.toArrow()
            nodes, low = united(*(here.column(c).to_numpy() for c in ("a", "b")))
            known_rows = len(nodes)
            out = materialise(docs.sparkSession.createDataFrame(pa.table({"node": nodes, "component": low})), f"parts-{label}")
        else:
            known_rows = math.inf
            found = connected_components(edges)
            out = materialise(found, f"parts-{label}")
            release(found)
        release(links, pairs)
        return out

    def across(pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """The pairs whose two nodes are in different components."""
        of = lambda c: light(parts.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}")))
        both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return both.where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b").distinct()

    def placed(parts: DataFrame, label: str) -> DataFrame:
        """Members of large buckets of more than one component, with their component and whether it is another than the bucket's main one; left: how many are outside."""
        all_ = large.join(light(parts), "node", "left").select("band", "n", "node", "size", "sketch", F.coalesce("component", "node").alias("component"))
        sums = all_.groupBy("band", "component").agg(F.count(F.lit(1)).alias("m"))
        main = sums.groupBy("band").agg(F.max(F.struct("m", "component")).alias("top")).select("band", "top.*").withColumnRenamed("component", "main")
        return materialise(all_.join(main, "band").where("m < n").select("band", "node", "size", "sketch", "component", (F.col("component") != F.col("main")).alias("outside"), (F.col("n") - F.col("m")).alias("left")), label)

    def met(members: DataFrame, others: DataFrame, also: Column | None = None) -> DataFrame:
        """Pairs of outside members with others of their bucket in another component that may be linked."""
        near_by = (F.col("x.component") != F.col("y.component")) & near("x", "y")
        return members.alias("x").join(others.alias("y"), F.col("x.band") == F.col("y.band")).where(near_by if also is None else near_by & also).select(*_pair("x", "y")).distinct()

    parts = joined(nothing, close.where("star"), "star")
    open_ = placed(parts, "open-2")
    second = across(close.where("not star"), parts)
    if open_.count():
        picks = [F.min_by(F.struct("node", "size", "sketch", "component"), F.xxhash64("node", F.lit(i))).alias(f"p{i}") for i in range(hubs)]
        chosen = open_.where("not outside").groupBy("band").agg(*picks).select("band", F.explode(F.array(*[f"p{i}" for i in range(hubs)])).alias("p")).select("band", "p.*")
        second = second.unionByName(met(open_.where("outside"), chosen)).distinct()
    parts = joined(parts, second, "second")
    rest = placed(parts, "open-3")
    if rest.count():
        listed = met(rest.where(F.col("outside") & (F.col("left") <= few)), rest.where(F.col("left") <= few))
        many = rest.where(F.col("left") > few)
        if many.limit(1).count():
            nodes = many.groupBy("node").agg(F.first("component").alias("component"), F.max("outside").alias("outside"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
            first = _prefixes(nodes, sets, percent)
            prefix = materialise(first, "prefix")
            release(first)
            hub = prefix.groupBy("band").agg(F.min("node").alias("hub"), F.max("outside").alias("some")).where("some")
            centre = prefix.join(hub, "band").where("node = hub").select("band", "node", "size", "sketch", "component", "outside")
            listed = listed.unionByName(met(prefix, centre, F.col("x.outside") | F.col("y.outside"))).distinct()
            parts = joined(parts, listed, "third")
            prefix = prefix.drop("component").join(light(parts), "node", "left").withColumn("component", F.coalesce("component", "node"))
            common = 1 + F.least(F.col("x.size") - F.col("x.at") - 1, F.col("y.size") - F.col("y.at") - 1)
            reach = (100 + percent) * common >= percent * (F.col("x.size") + F.col("y.size"))
            listed = met(prefix.where("outside"), prefix, reach)
        parts = joined(parts, listed, "last")

    least = reps.select("node", "doc_id").join(light(parts), "node").groupBy("component").agg(F.min("doc_id").alias("low"))
    lows = parts.join(light(least), "component").select("node", "component", "low")
    named = reps.select(*same, "node", "doc_id").join(light(lows), "node", "left").select(*same, F.coalesce("component", "node").alias("part"), F.coalesce("low", "doc_id").alias("low"))
    release(members, close, wanted, sets, open_, rest)
    out = summary.select("doc_id", "text_key", "n_shingles", "h1", "h2").join(named, same, "left")
    # Without a set or an id: a component of its own.
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id"))
    part = F.when(F.col("doc_id").isNotNull(), F.col("part")).alias("part")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), "text_key", part)


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, similarity=0.85).drop("text_key", "part")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS to_node FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.to_node = both_ways.a),
low AS (SELECT node, min(to_node) AS m FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low.m, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(low.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN sets s ON d.doc_id = s.doc_id LEFT JOIN low ON low.node = d.doc_id
"""
