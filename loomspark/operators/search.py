"""Dense and BM25 retrieval for batches of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..functions import text as T
from ..session import materialise
from . import matching
from .nearest import nearest

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rows (query, term) that a batch of queries may have to be broadcast; larger batches are joined by shuffles.
QUERY_TERMS = 100_000


def top_k(scored: DataFrame, k: int, by: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """rank from 1 within each query; Spark cuts each task's rows to k before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_topk(items: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, doc_id, score, rank by exact inner product of items (doc_id, embedding) and queries (query_id, q_embedding)."""
    return top_k(nearest(items.select("doc_id", "embedding"), queries, k).select("query_id", "doc_id", "score"), k)


def merged(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Two hit lists as one: the better score of each document, ranked anew."""
    both = first.select("query_id", "doc_id", "score").unionByName(second.select("query_id", "doc_id", "score"))
    return top_k(both.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)


def postings(documents: DataFrame) -> DataFrame:
    """doc_id, term, tf for documents (doc_id, text); terms are lower-cased white-space tokens."""
    if _alone(documents):
        return matching.postings(documents.select("doc_id", F.lower("text").alias("text")))
    # Dealt by document before the texts are parted: the counts then need no shuffle of their own.
    return documents.select("doc_id", "text").repartition("doc_id").select("doc_id", F.explode(T.words(F.lower("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def _alone(documents: DataFrame) -> bool:
    """Whether no doc_id stands twice."""
    return documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def lengths(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.coalesce(T.token_count(F.col("text")), F.lit(0)).alias("len"))


def term_weights(frequencies: DataFrame, documents: int) -> DataFrame:
    """term, idf from document frequencies (term, df). A negative idf becomes EPSILON times the mean over all terms; the mean is one row, whatever the vocabulary."""
    raw = frequencies.withColumn("raw", F.log(F.lit(documents) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_topk(documents: DataFrame, queries: DataFrame, k: int = 15, posted: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, rank for documents (doc_id, text) and queries (query_id, text); scores of 0 and below are left out.

    A batch of few query terms is matched with texts document by document, so that no tokens are shuffled (`matching`). Larger batches, stored
    postings and documents whose id stands twice are joined: query terms reach the tokens by an equi-join, so only tokens that are asked for are counted.
    """
    asked = queries.select("query_id", F.explode(T.words(F.lower("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    few = asked.limit(QUERY_TERMS + 1).count() <= QUERY_TERMS
    scored = _matched(documents, asked, k) if posted is None and few and _alone(documents) else _joined(documents, asked, few, posted)
    # Rounded before the cut, so that the order of summation decides no tie.
    return top_k(scored.where("score > 0").withColumn("score", F.round("score", 9)), k)


def _matched(documents: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score: the best documents of each query, and some more."""
    spark = documents.sparkSession
    binary = asked.select("query_id", F.col("term").cast("binary").alias("term"), "qtf")
    told, n = binary.collect(), documents.count()
    lowered = documents.select("doc_id", F.lower("text").alias("text"))
    known = matching.collection(lowered, binary.select("term").distinct(), n)
    idf = {bytes(r.term): r.raw if r.raw >= 0 else EPSILON * known.mean for r in known.terms}
    numbers = {name: i for i, name in enumerate(dict.fromkeys(r.query_id for r in told))}
    named = spark.createDataFrame([(i, name) for name, i in numbers.items()], StructType().add("query", LongType()).add("query_id", asked.schema["query_id"].dataType))
    found = matching.best_documents(lowered, [(numbers[r.query_id], bytes(r.term), r.qtf) for r in told], idf, k, (known.tokens or 0) / max(n, 1) or 1.0, K1, B)
    return found.join(F.broadcast(named), "query").select("query_id", "doc_id", "score")


def _joined(documents: DataFrame, asked: DataFrame, few: bool, posted: DataFrame | None) -> DataFrame:
    """query_id, doc_id, score of all pairs. Document frequencies are summed by term before anything is shuffled."""
    sizes = lengths(documents) if posted is None else materialise(lengths(documents), "lengths")
    n, mean_len = sizes.agg(F.count(F.lit(1)), F.avg("len")).first()
    hinted = F.broadcast if few else (lambda x: x)
    if posted is None:
        w = documents.select("doc_id", T.words(F.lower("text")).alias("w"))
        df = w.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        found = w.select("doc_id", F.size("w").alias("len"), F.explode("w").alias("term")).join(hinted(asked.select("term").distinct()), "term", "left_semi")
        # Dealt by document once: the counts and the sums below then need no further shuffle.
        counted = found.repartition("doc_id").groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    else:
        df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        counted = posted.join(hinted(asked.select("term").distinct()), "term", "left_semi").join(sizes, "doc_id")
    weights = hinted(term_weights(df, n).join(hinted(asked), "term"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean_len or 1.0)))
    return counted.join(weights, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
