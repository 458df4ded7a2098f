import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import matching, search

TEXTS = ["The cat sat on the mat", "the Cat the cat the cat", "", None, "dog dog dog\tdog\ndog\x0bdog\x0cdog\r dog", "a b   cat \x1c cat", "ÉLAN vital İstanbul", "élan VITAL", "no such word", "x " * 50 + "mat", "mat cat dog " * 9]
ASKED = [("1", "the cat"), ("2", "dog dog mat"), ("3", "élan i̇stanbul vital"), ("4", "absent"), ("5", ""), ("6", None), ("7", "the the the on sat a b x no such word  ")]


def tables(spark, extra=()):
    docs = [(f"d{i % 10}{i // 10}", t) for i, t in enumerate(TEXTS * 6)] + [("é", "cat"), (None, "the cat"), *extra]
    return spark.createDataFrame(docs, "doc_id string, text string").repartition(3), spark.createDataFrame(ASKED, "query_id string, text string")


def rows(df):
    return sorted((r.query_id, r.doc_id or "", r["rank"], round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize("pairs", [3, matching.PAIRS])
def test_matched_documents_are_those_of_the_joins(spark, monkeypatch, pairs):
    monkeypatch.setattr(matching, "PAIRS", pairs)
    monkeypatch.setattr(matching, "TERMS", 5)
    docs, queries = tables(spark)
    asked = queries.select("query_id", F.explode(T.words(F.lower("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    want = search._joined(docs, asked, True, None).where("score > 0").withColumn("score", F.round("score", 9))
    for k in (2, 5, 100):
        assert rows(search.bm25_topk(docs, queries, k)) == rows(search.top_k(want, k))


def test_tokens_are_not_shuffled(spark):
    """Many equal tokens: what leaves the tasks does not grow with them."""
    docs = spark.range(300).select(F.col("id").cast("string").alias("doc_id"), F.repeat(F.concat(F.lit("cat dog "), F.col("id").cast("string"), F.lit(" ")), 40).alias("text"))
    queries = spark.createDataFrame([("1", "cat dog 7")], "query_id string, text string")
    found = search.bm25_topk(docs, queries, 2)
    assert "Generate explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.doc_id for r in found.orderBy("rank").collect()][0] == "7"


def test_repeated_documents_and_none(spark):
    docs, queries = tables(spark, [("d00", "the cat again")])
    assert {r.query_id for r in search.bm25_topk(docs, queries, 3).collect()} == {"1", "2", "3", "7"}
    assert search.bm25_topk(docs.limit(0), queries, 3).count() == 0
    assert search.bm25_topk(docs, queries.where("query_id = '5'"), 3).count() == 0


def test_postings_and_hits_of_stored_ones(spark):
    """Postings are the same row by row and joined; stored ones find what texts do."""
    docs, queries = tables(spark)
    docs = docs.where("doc_id is not null")
    posted = search.postings(docs)
    again = docs.select("doc_id", F.explode(T.words(F.lower("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    assert posted.schema.simpleString() == again.schema.simpleString()
    assert sorted(map(tuple, posted.collect())) == sorted(map(tuple, again.collect()))
    assert "Generate explode" not in posted._jdf.queryExecution().optimizedPlan().toString()
    twice = search.postings(docs.unionByName(docs))
    assert sorted(map(tuple, twice.collect())) == sorted((r.doc_id, r.term, 2 * r.tf) for r in again.collect())
    assert rows(search.bm25_topk(docs, queries, 4, posted)) == rows(search.bm25_topk(docs, queries, 4))
