from pyspark.sql import functions as F

from loomspark.operators import graph


def shuffled(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False).iterator()
    total = 0
    while found.hasNext():
        total += found.next().totalShuffleWrite()
    return total


def test_texts_follow_the_cut(spark):
    """A hub beside 600 nodes with long texts: only the texts of the 15 results are moved."""
    n = spark.range(600).select(F.concat(F.lit("node "), F.col("id").cast("string")).alias("name"), F.lit("X").alias("entity_type"), F.lit("d").alias("description"), F.array(F.col("id").cast("string")).alias("source_chunks"), (F.col("id") + 1).alias("ord"))
    hub = spark.createDataFrame([("hub", "X", "the hub", ["hub"], 0)], n.schema)
    edges = n.select(F.lit("hub").alias("source"), F.col("name").alias("target"), F.lit("R").alias("relation_type"), F.lit("x").alias("description"), F.lit(0.9).alias("confidence"), "ord")
    edges = edges.unionByName(edges.where("ord < 50")).unionByName(edges.where("ord < 9").withColumn("confidence", F.lit(0.1)).withColumn("target", F.lit("hub")))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.sha2(F.concat(F.col("id").cast("string"), i.cast("string")), 256)), "")
    chunks = spark.range(500).select(F.col("id").cast("string").alias("chunk_id"), F.when(F.col("id") != 3, text).alias("text"))
    told = spark.createDataFrame([("hub", "c", "a summary"), ("node 1", "c", "another"), ("hub", "d", "")], "name string, community string, summary string")
    asked = spark.createDataFrame([("q", " HUB"), ("r", "nothing like it")], "query_id string, entity string")
    before = shuffled(spark)
    got = graph.graph_channel(asked, n.unionByName(hub), edges, told, chunks, 15).orderBy("rank").collect()
    assert shuffled(spark) - before < 2_000_000
    assert [r["rank"] for r in got] == list(range(1, 16))
    assert got[0].doc_id == "community_c" and got[0].text == "a summary" and got[0].score == 0.85
    assert got[1].doc_id == "entity_hub" and got[1].text.startswith("Entity: hub (X)")
    walked = {r.doc_id: r.text for r in got[2:]}
    assert list(walked) == sorted(str(i) for i in range(500))[:13]
    assert {r.chunk_id: r.text for r in chunks.collect() if r.chunk_id in walked} == walked
    assert {r.source_type for r in got[2:]} == {"graph_walk"} and {r.query_id for r in got} == {"q"}
