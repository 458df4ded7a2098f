import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import evaluation as E


def metrics(spark, retrieved, relevant, k=10):
    q = spark.createDataFrame([("q",)], "query_id string")
    got = spark.createDataFrame([("q", d, i) for i, d in enumerate(retrieved, 1)], "query_id string, doc_id string, rank int")
    want = spark.createDataFrame([("q", d) for d in relevant], "query_id string, doc_id string")
    return E.ranking_metrics(q, got, want, k).first()


@pytest.mark.parametrize(
    ("retrieved", "relevant", "k", "name", "value"),
    [
        (list("abc"), "abc", 3, "precision_at_k", 1.0), (list("axby"), "abc", 4, "precision_at_k", 0.5), ([], "a", 10, "precision_at_k", 0.0), (list("ab"), "a", 10, "precision_at_k", 0.5),
        (list("abc"), "abc", 3, "recall_at_k", 1.0), (list("ax"), "ab", 2, "recall_at_k", 0.5), (list("a"), "", 2, "recall_at_k", 0.0), (list("abc"), "a", 3, "mrr", 1.0), (list("xya"), "a", 3, "mrr", 1 / 3), (list("xy"), "a", 3, "mrr", 0.0),
        (list("ab"), "ab", 2, "ndcg_at_k", 1.0), (list("xy"), "a", 2, "ndcg_at_k", 0.0), (list("xa"), "a", 2, "ndcg_at_k", 1 / math.log2(3)), (list("aa"), "a", 2, "ndcg_at_k", 1 + 1 / math.log2(3)), (list("xa"), "a", 1, "hit_rate", 0.0), (list("xa"), "a", 2, "hit_rate", 1.0),
    ],
)
def test_ranking(spark, retrieved, relevant, k, name, value):
    assert metrics(spark, retrieved, relevant, k)[name] == pytest.approx(value)


@pytest.mark.parametrize(("a", "b", "low", "high"), [("the same words", "the same words", 1, 1), ("one two", "three four", 0, 0), ("the cat sat on the mat", "the cat on the mat", 0.8, 1), ("", "x", 0, 0), ("", "", 0, 0)])
def test_word_overlap(spark, a, b, low, high):
    assert low <= spark.createDataFrame([(a, b)], "a string, b string").select(T.word_overlap_f1(F.col("a"), F.col("b"))).first()[0] <= high


@pytest.mark.parametrize(("got", "gold", "value"), [(["a"], ["a", "b"], 0.5), ([], [], 1.0), (["a", "b"], ["a", "b"], 1.0), (None, ["a"], 0.0)])
def test_entity_coverage(spark, got, gold, value):
    assert spark.createDataFrame([(got, gold)], "a array<string>, b array<string>").select(E.entity_coverage(F.col("a"), F.col("b"))).first()[0] == value


def test_gate(spark):
    means = lambda *rows: spark.createDataFrame(rows, "metric string, value double")
    compared = E.regression_gate(means(("a", 0.5), ("b", 0.5), ("c", 0.2)), means(("a", 0.46), ("b", 0.4)))
    assert {r.metric: r.failed for r in compared.collect()} == {"a": False, "b": True, "c": True}
    assert tuple(E.gate_result(compared, spark.createDataFrame([(10,)], "n long")).first()) == (False, 10, 8, 2)


def test_labels_are_counted_without_pairs(spark):
    """The metrics of labels are those of all pairs, items under several labels, repeated ones and nulls included."""
    items = [(f"v{i}", i % 3) for i in range(60)] + [("v0", 1), ("v6", 2), ("v6", None), ("two", 0), ("two", 1), ("v9", 0), (None, 0), ("lone", 9), ("blank", None)]
    items = spark.createDataFrame(items, "doc_id string, label int")
    queries = items.where("doc_id in ('v0', 'v1', 'v6', 'two', 'lone', 'blank')").select(F.col("doc_id").alias("query_id"), "label").unionByName(spark.createDataFrame([("new", 2)], "query_id string, label int"))
    found = queries.select("query_id").distinct().crossJoin(items.select("doc_id").where("doc_id is not null").distinct()).where("pmod(xxhash64(query_id, doc_id), 4) = 0 or doc_id = 'lone'")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.xxhash64("doc_id", "query_id"))))
    relevant = items.join(queries, "label").where("doc_id <> query_id").select("query_id", "doc_id")
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert rows(E.labelled_metrics(queries, found, items)) == rows(E.ranking_metrics(queries, found, relevant))
