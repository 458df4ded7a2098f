"""Queries on retrieval, fusion and re-ranking. Query sets: vectors whose vec_id is divisible by 50, and the benchmark items' texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import vectors as V
from ..operators import fusion, search, tree
from ..operators.joins import looked_up
from ..session import materialise, spread, table
from .registry import query

STEP = 50


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), "embedding", "label", "vec_id")


def vector_queries(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Vectors whose number, less shift, is divisible by STEP, as queries under the number less shift."""
    v = vectors(spark, sf_dir).where((F.col("vec_id") - shift) % STEP == 0)
    return v.select((F.col("vec_id") - shift).cast("string").alias("query_id"), F.col("embedding").alias("q_embedding"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select((F.col("item_id") * STEP).cast("string").alias("query_id"), "text")


def dense(spark: SparkSession, sf_dir: str, shift: int = 0, k: int = 20) -> DataFrame:
    return search.dense_topk(vectors(spark, sf_dir), vector_queries(spark, sf_dir, shift), k)


V_SQL = "v AS (SELECT CAST(vec_id AS VARCHAR) AS doc_id, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def dense_sql(name: str, shift: int = 0, k: int = 20) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT CAST(q.vec_id - {shift} AS VARCHAR) AS query_id, v.doc_id, list_sum(list_transform(range(1, len(v.e) + 1), lambda i: q.e[i] * v.e[i])) AS score
    FROM v q, v WHERE (q.vec_id - {shift}) % {STEP} = 0)) WHERE rank <= {k})"""


DENSE = f"{V_SQL}, {dense_sql('dense')}"


@query(f"WITH {DENSE} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM dense")
def dense_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {V_SQL} SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, round(score, 6) AS score
  FROM (SELECT v.doc_id, list_sum(list_transform(range(1, len(v.e) + 1), lambda i: q.e[i] * v.e[i])) AS score FROM v q, v WHERE q.vec_id = 0) ORDER BY score DESC, doc_id LIMIT 20""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query: the vector of number 0."""
    v = vectors(spark, sf_dir)
    one = v.where("vec_id = 0").select(F.lit("0").alias("query_id"), F.col("embedding").alias("q_embedding"))
    return search.dense_topk(v, one, 20).select("doc_id", "rank", F.round("score", 6).alias("score"))


_BM25 = r"""d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(coalesce(len(w), 0)) AS al FROM d),
t AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM p GROUP BY term), n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM t) ELSE raw END AS idf FROM t),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT CAST(item_id * 50 AS VARCHAR) AS query_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.w) / al))), 9) AS score FROM q JOIN idf USING (term) JOIN p USING (term) JOIN d USING (doc_id), n GROUP BY ALL),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 15)"""


@query(f"WITH {_BM25} SELECT doc_id, term, tf FROM p")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(corpus(spark, sf_dir))


@query(f"WITH {_BM25} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM bm25")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_topk(corpus(spark, sf_dir), text_queries(spark, sf_dir)).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {V_SQL}, {dense_sql("a")}, {dense_sql("b", 1)},
m AS (SELECT query_id, doc_id, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m) WHERE rank <= 20""")
def hyde_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector after a query's own stands for its hypothetical answer."""
    return search.merged(dense(spark, sf_dir), dense(spark, sf_dir, 1), 20).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {V_SQL}, c AS (SELECT q.vec_id, list_transform(range(1, len(q.e) + 1), lambda i: 0.4 * q.e[i] + (1 - 0.4) * h.e[i]) AS c FROM v q JOIN v h ON h.vec_id = q.vec_id + 1),
n AS (SELECT vec_id, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM c)
SELECT vec_id, CAST(unnest(range(0, len(c))) AS INTEGER) AS i, round(unnest(c) / n, 6) AS x FROM n""")
def hyde_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    h = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("h"))
    return v.join(h, "vec_id").select("vec_id", F.posexplode(V.combined(F.col("embedding"), F.col("h"))).alias("i", "x")).withColumn("x", F.round("x", 6))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four channels for the vector queries, without texts: dense, BM25 over the benchmark items, and two that stand for graph and tree: what is near the next vector, and the tree of leveled vectors."""
    asked = vector_queries(spark, sf_dir)
    sparse = search.bm25_topk(corpus(spark, sf_dir), text_queries(spark, sf_dir)).join(asked.select("query_id"), "query_id", "left_semi")
    leveled = vectors(spark, sf_dir).select(F.col("doc_id").alias("node_id"), (F.col("label") % 3).alias("level"), "embedding")
    found = {"vector": dense(spark, sf_dir), "bm25": sparse, "graph": dense(spark, sf_dir, 1, 15), "tree": tree.tree_topk(leveled, asked, max_level=2)}
    parts = [df.select("query_id", F.lit(name).alias("channel"), "doc_id", "rank", "score", F.lit(None).cast("string").alias("text")) for name, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_CHANNELS = f"""{DENSE}, {_BM25},
ids AS (SELECT CAST(vec_id AS VARCHAR) AS query_id FROM embeddings WHERE vec_id % 50 = 0),
texts AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents),
{dense_sql("near_next", 1, 15)},
leveled AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, v.doc_id, list_sum(list_transform(range(1, len(v.e) + 1), lambda i: q.e[i] * v.e[i])) * (1.0::DOUBLE - 0.1::DOUBLE * abs(v.label % 3 - 1.0::DOUBLE) / 2) AS score FROM v q, v WHERE q.vec_id % 50 = 0),
tree AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM leveled),
hits AS (
  SELECT query_id, 'vector' AS channel, doc_id, rank, score FROM dense UNION ALL
  SELECT query_id, 'bm25', doc_id, rank, score FROM bm25 SEMI JOIN ids USING (query_id) UNION ALL
  SELECT query_id, 'graph', doc_id, rank, score FROM near_next UNION ALL
  SELECT query_id, 'tree', doc_id, rank, score FROM tree WHERE rank <= 10),
w(channel, weight, o) AS (VALUES ('vector', 0.30, 0), ('bm25', 0.15, 1), ('graph', 0.30, 2), ('tree', 0.25, 3)),
f AS (
  SELECT query_id, doc_id, round(sum(CAST(weight AS DOUBLE) / (60 + rank)), 12) AS fused, min(o * 1000000 + rank) AS first_seen, arg_max(channel, struct_pack(s := score, o := -o)) AS primary_channel,
    max(CASE WHEN channel = 'vector' THEN rank END) AS vector_rank, max(CASE WHEN channel = 'bm25' THEN rank END) AS bm25_rank, max(CASE WHEN channel = 'graph' THEN rank END) AS graph_rank, max(CASE WHEN channel = 'tree' THEN rank END) AS tree_rank
  FROM hits JOIN w USING (channel) GROUP BY ALL),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first_seen) AS rank FROM f) WHERE rank <= 10)"""


def fused(spark: SparkSession, sf_dir: str, k: int | None = None) -> DataFrame:
    return fusion.fuse(channels(spark, sf_dir), k)


@query(f"""WITH {_CHANNELS} SELECT query_id, CAST(rank AS INTEGER) AS rank, fused.doc_id, round(fused, 9) AS fused_score, CAST(vector_rank AS INTEGER) AS vector_rank, CAST(bm25_rank AS INTEGER) AS bm25_rank,
  CAST(graph_rank AS INTEGER) AS graph_rank, CAST(tree_rank AS INTEGER) AS tree_rank, text FROM fused LEFT JOIN texts USING (doc_id)""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = [F.element_at("channel_ranks", c).alias(f"{c}_rank") for c in fusion.CHANNELS]
    best = materialise(fused(spark, sf_dir).select("query_id", "rank", "doc_id", F.round("fused_score", 9).alias("fused_score"), *ranks), "fused")
    return looked_up(best, table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"), "doc_id")


@query(f"WITH {_CHANNELS} SELECT query_id, channel, count(*) AS n FROM fused JOIN hits USING (query_id, doc_id) GROUP BY ALL")
def channel_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("query_id", F.explode(F.map_keys("channel_ranks")).alias("channel")).groupBy("query_id", "channel").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CHANNELS} SELECT query_id, doc_id, primary_channel FROM fused")
def primary_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("query_id", "doc_id", fusion.primary_channel(F.col("channel_scores")).alias("primary_channel"))


_KEYS = [("c1", "n1", "b1", "d1", "vector", "t"), ("", "n2", None, None, "tree", "t"), (None, "", "b3", "d3", "bm25", "t"), (None, None, None, "d4", "graph", "t"), (None, None, None, None, "graph", "a text"), ("", "", "", None, "tree", None), (None, None, None, "", "bm25", "x")]
_KEY_SQL = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in _KEYS)


@query(f"""SELECT *, coalesce(nullif(chunk_id, ''), nullif(node_id, ''), nullif(bm25_id, ''), doc_id, channel || '_' || sha256(left(coalesce(text, ''), 200))[1:16]) AS key
FROM (SELECT * FROM (VALUES {_KEY_SQL}) AS v(chunk_id, node_id, bm25_id, doc_id, channel, text) UNION ALL SELECT NULL, NULL, NULL, NULL, 'graph', text FROM documents)""")
def doc_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["chunk_id", "node_id", "bm25_id", "doc_id", "channel", "text"]
    rows = spark.createDataFrame(_KEYS, ", ".join(f"{c} string" for c in cols))
    none = F.lit(None).cast("string")
    docs = table(spark, sf_dir, "documents").select(none.alias("chunk_id"), none.alias("node_id"), none.alias("bm25_id"), none.alias("doc_id"), F.lit("graph").alias("channel"), "text")
    return rows.unionByName(docs).withColumn("key", fusion.document_key(*[F.col(c) for c in cols]))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each query with relevance = their score, to be diversified."""
    v = vectors(spark, sf_dir).select("doc_id", "embedding")
    return dense(spark, sf_dir).join(v, "doc_id").select("query_id", "doc_id", F.col("rank").alias("ord"), F.col("score").alias("relevance"), "embedding")


_MMR = f"""{DENSE}, cand AS (SELECT query_id, list(doc_id ORDER BY rank) AS ids, list(score ORDER BY rank) AS rel, list(e ORDER BY rank) AS es, count(*) AS n FROM dense JOIN v USING (doc_id) GROUP BY query_id),
m AS (
  SELECT query_id, 0 AS step, CAST([] AS BIGINT[]) AS sel FROM cand
  UNION ALL
  SELECT query_id, step + 1, list_append(sel, pick) FROM (
    SELECT m.query_id, step, sel, arg_max(i, (round(0.7 * rel[i] - (1 - 0.7) * greatest(0.0, coalesce(list_max(list_transform(sel, lambda j: list_sum(list_transform(range(1, len(es[i]) + 1), lambda x: es[i][x] * es[j][x])))), 0.0)), 12), -i)) AS pick
    FROM (SELECT m.*, rel, es, unnest(list_filter(range(1, n + 1), lambda i: NOT list_contains(sel, i))) AS i FROM m JOIN cand USING (query_id) WHERE step < 8) m
    GROUP BY m.query_id, step, sel)),
picked AS (SELECT query_id, unnest(sel) AS i, unnest(range(1, 9)) AS pick FROM m WHERE step = 8),
mmr AS (SELECT query_id, ids[i] AS doc_id, CAST(pick AS INTEGER) AS pick FROM picked JOIN cand USING (query_id))"""


@query(f"WITH RECURSIVE {_MMR} SELECT * FROM mmr")
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.mmr(candidates(spark, sf_dir))


@query(f"""WITH {DENSE}, parts AS (SELECT query_id, doc_id, rank, score, least(0.15::DOUBLE * (v.label % 4), 0.45::DOUBLE) AS coherence,
  0.05 * pow(0.5, floor((epoch(TIMESTAMP '2002-01-01') - epoch(o_orderdate)) / 86400) / 365.0) AS temporal FROM dense JOIN v USING (doc_id) JOIN orders ON o_orderkey = v.vec_id)
SELECT query_id, doc_id, round(score, 6) AS ce, round(coherence, 6) AS coherence, round(temporal, 6) AS temporal, round(score + coherence + temporal, 6) AS combined,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score + coherence + temporal, 9) DESC, doc_id) AS INTEGER) AS place FROM parts""")
def rerank_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three signals of the re-ranker: similarity, coherence (0.15 for each of label % 4 entities, 0.45 at most), recency of the order of the vector's number."""
    v = vectors(spark, sf_dir).select("doc_id", "vec_id", "label")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vec_id"), "o_orderdate")
    d = dense(spark, sf_dir).join(v, "doc_id").join(o, "vec_id")
    d = d.withColumn("coherence", F.least(0.15 * (F.col("label") % 4), F.lit(0.45))).withColumn("temporal", S.temporal_bonus(F.col("o_orderdate"), F.lit("2002-01-01").cast("timestamp")))
    d = d.withColumn("combined", F.col("score") + F.col("coherence") + F.col("temporal")).withColumnRenamed("score", "ce").withColumn("score", F.round("combined", 9))
    ranked = fusion.stable_rank(d.drop("rank"), ["doc_id"])
    return ranked.select("query_id", "doc_id", *[F.round(c, 6).alias(c) for c in ("ce", "coherence", "temporal", "combined")], F.col("rank").alias("place"))


@query("""SELECT o_orderkey, round(0.05 * pow(0.5, floor((epoch(TIMESTAMP '2002-01-01') - epoch(o_orderdate)) / 86400) / 365.0), 9) AS past,
  round(0.05 * pow(0.5, floor((epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate)) / 86400) / 365.0), 9) AS mixed, 0.0::DOUBLE AS missing FROM orders""")
def temporal_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda now: F.round(S.temporal_bonus(F.col("o_orderdate"), F.lit(now).cast("timestamp")), 9)
    missing = S.temporal_bonus(F.lit(None).cast("timestamp"), F.lit("2002-01-01").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", at("2002-01-01").alias("past"), at("2000-01-01").alias("mixed"), missing.alias("missing"))


@query(f"""WITH {DENSE}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM dense)
SELECT query_id, doc_id, CAST((rank - 1) % 3 AS INTEGER) AS draft FROM n""")
def draft_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.round_robin(dense(spark, sf_dir)).select("query_id", "doc_id", "draft")
