"""Queries on the summary tree; label % 3 stands for a node's level where no tree is built."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import tree
from ..session import table
from .registry import query
from .retrieval import STEP, V_SQL, vector_queries, vectors


def leveled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("doc_id").alias("node_id"), (F.col("label") % 3).alias("level"), "embedding")


@query("SELECT vec_id, label % 3 AS level, 1.0 - 0.1 * abs(label % 3 - 1.0) / 2 AS weight, CAST(1.0 AS DOUBLE) - 0.1 * abs(label % 3 - 0.5) AS flat FROM embeddings")
def tree_level_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights in a tree of two levels above the leaves, and (flat) with a highest level of 0, which counts as 1."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).alias("level"))
    return d.select("vec_id", "level", S.level_weight(F.col("level"), F.lit(2)).alias("weight"), S.level_weight(F.col("level"), F.lit(0)).alias("flat"))


@query(f"""WITH {V_SQL}, s AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, v.doc_id, v.label % 3 AS level, list_sum(list_transform(range(1, len(v.e) + 1), lambda i: q.e[i] * v.e[i])) AS raw
  FROM v q, v WHERE q.vec_id % {STEP} = 0), w AS (SELECT *, raw * (1.0::DOUBLE - 0.1::DOUBLE * abs(level - 1.0::DOUBLE) / 2) AS score FROM s)
SELECT query_id, doc_id, level, round(raw, 6) AS raw_similarity, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM w) WHERE rank <= 10""")
def tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tree.tree_topk(leveled(spark, sf_dir), vector_queries(spark, sf_dir), max_level=2)
    return found.select("query_id", "doc_id", "level", F.round("raw_similarity", 6).alias("raw_similarity"), F.round("score", 6).alias("score"), "rank")


@query("SELECT label % 3 AS level, count(*) AS n_nodes, CAST(sum(CASE WHEN label % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves FROM embeddings GROUP BY 1")
def tree_level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.level_stats(leveled(spark, sf_dir))


@query("SELECT 'leaf_' || vec_id AS node_id, 0 AS level, CAST(vec_id AS VARCHAR) AS source_chunk_id FROM embeddings")
def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.concat(F.lit("leaf_"), "doc_id").alias("node_id"), F.lit(0).alias("level"), F.col("doc_id").alias("source_chunk_id"))


@query("""WITH n AS (SELECT label AS id, count(*) AS n FROM embeddings GROUP BY label UNION ALL SELECT 1000 + x, x FROM range(0, 80) AS r(x))
SELECT id, n, CAST(CASE WHEN n < 3 THEN 1 ELSE least(greatest(2, least(n // 3, 20)), n) END AS INTEGER) AS k FROM n""")
def cluster_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n")).unionByName(spark.range(80).select((F.col("id") + 1000).alias("id"), F.col("id").alias("n")))
    return n.withColumn("k", S.cluster_count(F.col("n")))


@query()
def summary_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree over all vectors with the documents of their numbers as texts: node, level, parent, number of children."""
    from ..providers import ExtractiveSummary, HashedEmbedder

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    leaves = vectors(spark, sf_dir).join(docs, "doc_id", "left").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), "embedding")
    built = tree.build_tree(leaves, ExtractiveSummary().summaries, HashedEmbedder(64).of_nodes)
    children = built.groupBy(F.col("parent").alias("node_id")).agg(F.count(F.lit(1)).alias("n_children"))
    return built.join(children, "node_id", "left").select("node_id", "level", "parent", F.coalesce("n_children", F.lit(0)).alias("n_children"))
