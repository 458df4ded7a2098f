import math
import random

import pytest
from pyspark.sql import functions as F

from loomspark.functions import vectors as V
from loomspark.operators import search, tree
from loomspark.operators.nearest import nearest

ITEMS, QUERIES = "doc_id string, embedding array<double>, w double", "query_id string, q_embedding array<double>"


def plain(rows, columns):
    text = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else x
    return sorted(tuple(str(text(r[c])) for c in columns) for r in rows)


def odd_tables(spark):
    r = random.Random(3)
    vector = lambda n=5: [r.choice([0.0, 0.5, -1.25, r.uniform(-1, 1)]) for _ in range(n)]
    items = [(f"d{i}", vector(), r.choice([1.0, 0.5])) for i in range(120)] + [(f"same{i}", [0.5, 0.5, 0.1, 0.2, 0.3], 1.0) for i in range(40)]
    items += [("é", vector(), 1.0), ("none", None, 1.0), ("hole", [1.0, None, 0.0, 0.0, 0.0], 1.0), ("short", vector(3), 1.0), ("nan", [math.nan, *vector(4)], 1.0), ("inf", [math.inf, *vector(4)], 1.0), ("huge", [1e308] * 5, 1.0), ("tiny", [1e-310] * 5, 1.0), (None, vector(), 1.0), ("unweighed", vector(), None), ("empty", [], 1.0)]
    queries = [(f"q{i}", vector()) for i in range(9)] + [("short", vector(3)), ("none", None), ("hole", [None, 1.0, 1.0, 1.0, 1.0]), ("big", [1e308] * 5), ("zero", [0.0] * 5), ("empty", [])]
    return spark.createDataFrame(items, ITEMS).repartition(3), spark.createDataFrame(queries, QUERIES).repartition(2)


@pytest.mark.parametrize(("blocks", "k"), [(((7, 1 << 20), (4, 1 << 20)), 6), (((64, 1 << 20), (4, 1 << 20)), 3), (((4096, 1 << 20), (1024, 1 << 20)), 6), (((4096, 200), (1024, 90)), 200)])
def test_blocks_find_what_all_pairs_give(spark, blocks, k):
    items, queries = odd_tables(spark)
    raw = V.dot(F.col("embedding"), F.col("q_embedding"))
    pairs = items.crossJoin(queries).select("query_id", "doc_id", raw.alias("raw"), (raw * F.col("w")).alias("score"))
    columns = ["query_id", "doc_id", "raw", "score", "rank"]
    want = plain(search.top_k(pairs, k).collect(), columns)
    got = search.top_k(nearest(items, queries, k, "w", *blocks), k)
    assert plain(got.collect(), columns) == want


def test_pairs_stay_inside_blocks(spark):
    """Only a few rows of each query leave the blocks, whatever the number of items, and no row is made for a pair."""
    items = spark.range(6000).select(F.col("id").cast("string").alias("doc_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i)).alias("embedding"))
    queries = items.where("cast(doc_id as long) % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q_embedding"))
    tasks = spark.sparkContext.defaultParallelism
    assert nearest(items, queries, 5).count() <= 120 * 5 * 2 * tasks
    for found in (search.dense_topk(items, queries, 5), tree.tree_topk(items.select(F.col("doc_id").alias("node_id"), F.lit(0).alias("level"), "embedding"), queries, 5, 2)):
        assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert found.count() == 120 * 5
