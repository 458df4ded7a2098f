"""Retrieval and generation metrics, the regression gate, failure analysis and the ablation table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scoring as S
from ..functions import text as T


def ranking_metrics(queries: DataFrame, retrieved: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """query_id, precision_at_k, recall_at_k, mrr, ndcg_at_k, hit_rate for queries (query_id), retrieved (query_id, doc_id, rank), relevant (query_id, doc_id).

    Precision divides by what was retrieved, k at most; recall counts distinct documents; a document that is
    retrieved twice gains twice. All metrics come from one equi-join and one aggregation.
    """
    rel = relevant.select("query_id", "doc_id").distinct()
    sizes = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    rows = retrieved.select("query_id", "doc_id", "rank").join(rel.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return _metrics(queries, rows, sizes, k)


def labelled_metrics(queries: DataFrame, retrieved: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """ranking_metrics where the items (doc_id, label) of a label that a query (query_id, label) has are relevant to it, other than itself.

    They are counted by label and no pair of a query and a relevant item is made, but for items that stand under several labels.
    """
    own = queries.groupBy("query_id").agg(F.collect_set("label").alias("q_labels"))
    kinds = items.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("label").alias("labels"))
    hit = F.when(F.arrays_overlap("labels", "q_labels") & (F.col("doc_id") != F.col("query_id")), 1)
    rows = retrieved.select("query_id", "doc_id", "rank").join(own, "query_id", "left").join(kinds, "doc_id", "left").select("query_id", "doc_id", "rank", hit.alias("hit"))
    asked = own.select("query_id", F.explode("q_labels").alias("label"))
    one = kinds.where(F.size("labels") == 1).select("doc_id", F.col("labels")[0].alias("label"))
    itself = one.select(F.col("doc_id").alias("query_id"), "label", F.lit(1).alias("itself"))
    by_label = one.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    single = asked.join(by_label, "label").join(itself, ["query_id", "label"], "left").select("query_id", (F.col("n") - F.coalesce("itself", F.lit(0))).alias("n"))
    several = kinds.where(F.size("labels") > 1).select("doc_id", F.explode("labels").alias("label")).join(asked, "label").where("doc_id <> query_id")
    several = several.select("query_id", "doc_id").distinct().select("query_id", F.lit(1).cast("long").alias("n"))
    sizes = single.unionByName(several).groupBy("query_id").agg(F.nullif(F.sum("n"), F.lit(0)).alias("n_rel"))
    return _metrics(queries, rows, sizes, k)


def _metrics(queries: DataFrame, rows: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """The metrics from retrieved rows (query_id, doc_id, rank, hit: null if not relevant) and numbers of relevant documents (query_id, n_rel)."""
    inside, hit = F.col("rank") <= k, F.col("hit").isNotNull()
    per = rows.groupBy("query_id").agg(
        F.sum(F.when(inside, 1).otherwise(0)).alias("n_top"), F.sum(F.when(inside & hit, 1).otherwise(0)).alias("n_hit"), F.count_distinct(F.when(inside & hit, F.col("doc_id"))).alias("n_found"),
        F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.when(inside & hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    d = queries.select("query_id").distinct().join(per, "query_id", "left").join(sizes, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return d.select(
        "query_id", zero(F.try_divide("n_hit", "n_top")).alias("precision_at_k"), zero(F.col("n_found") / F.col("n_rel")).alias("recall_at_k"), zero(1 / F.col("first")).alias("mrr"),
        zero(F.col("dcg") / ideal).alias("ndcg_at_k"), F.when(F.col("n_hit") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
    )


def entity_coverage(retrieved, gold):
    """Share of the gold entities that were retrieved; 1 without gold entities. Columns of arrays."""
    g = F.array_distinct(F.coalesce(gold, F.array().cast("array<string>")))
    return F.when(F.size(g) == 0, 1.0).otherwise(F.size(F.array_intersect(g, F.coalesce(retrieved, F.array().cast("array<string>")))) / F.size(g))


def generation_metrics(answers: DataFrame) -> DataFrame:
    """Metrics for answers (query_id, answer, gold_answer, reflection struct of support, usefulness, relevance, citations); missing scores are 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    similar = F.when(F.coalesce(F.length("gold_answer"), F.lit(0)) > 0, T.word_overlap_f1(F.col("answer"), F.col("gold_answer"))).otherwise(0.0)
    return answers.select(
        "query_id", zero("reflection.support").alias("faithfulness"), zero("reflection.usefulness").alias("answer_relevance"), zero("reflection.relevance").alias("context_precision"),
        zero("reflection.citations").alias("citation_accuracy"), similar.alias("answer_similarity"), F.length("answer").alias("answer_length"),
    )


def metric_means(per_query: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, value: means of the per-query values, each rounded to four places first."""
    long = per_query.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(f"`{m}`"), 4).alias("v")) for m in metrics])).alias("m"))
    return long.groupBy("m.metric").agg(F.avg("m.v").alias("value"))


def regression_gate(baseline: DataFrame, current: DataFrame, threshold: float = 0.05) -> DataFrame:
    """metric, baseline, current, diff, failed for each metric of the baseline (metric, value); a missing current value is 0."""
    both = baseline.select("metric", F.col("value").alias("baseline")).join(current.select("metric", F.col("value").alias("current")), "metric", "left").na.fill(0.0, ["current"])
    diff = F.col("current") - F.col("baseline")
    return both.select("metric", F.round("baseline", 4).alias("baseline"), F.round("current", 4).alias("current"), F.round(diff, 4).alias("diff"), (diff < -threshold).alias("failed"))


def gate_result(compared: DataFrame, total: DataFrame) -> DataFrame:
    """One row: passed, total_queries, passed_queries (queries less failed metrics), failed_queries (failed metrics). total (n)."""
    n = compared.agg(F.sum(F.col("failed").cast("int")).alias("bad"))
    return n.crossJoin(total).select((F.coalesce("bad", F.lit(0)) == 0).alias("passed"), F.col("n").alias("total_queries"), (F.col("n") - F.coalesce("bad", F.lit(0))).alias("passed_queries"), F.coalesce("bad", F.lit(0)).alias("failed_queries"))


def failures(cases: DataFrame) -> DataFrame:
    """Failed cases with failure_type, confidence and analysis, from cases (query_id, answer, gold_answer, retrieved, crag_quality, support, relevance, usefulness)."""
    similar = T.word_overlap_f1(F.col("answer"), F.col("gold_answer"))
    kind = S.failure_type(F.col("gold_answer"), F.col("confidence"), F.col("retrieved"), F.col("crag_quality"), F.col("support"), F.col("relevance"), F.col("usefulness"))
    one = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    analysis = F.format_string("Similarity: %.3f, CRAG: %s, Support: %.2f, Relevance: %.2f", "confidence", F.coalesce("crag_quality", F.lit("")), one("support"), one("relevance"))
    out = cases.withColumn("confidence", similar).withColumn("failure_type", kind).where("failure_type is not null")
    return out.select("query_id", "failure_type", F.substring("gold_answer", 1, 500).alias("expected"), F.substring("answer", 1, 500).alias("actual"), "confidence", analysis.alias("analysis"))


def failure_summary(failed: DataFrame) -> DataFrame:
    """failure_type, n, share, avg_confidence, recommendation."""
    total = failed.agg(F.count(F.lit(1)).alias("total"))
    advice = F.create_map(*[F.lit(x) for kv in fixed.RECOMMENDATIONS.items() for x in kv])
    per = failed.groupBy("failure_type").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence")).crossJoin(F.broadcast(total))
    text = F.element_at(advice, F.col("failure_type"))
    return per.select("failure_type", "n", (F.col("n") / F.col("total")).alias("share"), F.round("avg_confidence", 9).alias("avg_confidence"), F.when(text.isNotNull(), F.concat(F.lit("["), F.col("n").cast("string"), F.lit("x] "), text)).alias("recommendation"))


#: The nine configurations: those that switch off a stage also switch off the stages after it.
SWITCHES = ["vector", "bm25", "graph", "tree", "hyde", "crag", "speculative", "self_rag"]
ABLATIONS = {
    "vector_only": ["vector"], "vector_bm25": ["vector", "bm25"], "graph_only": ["graph"], "tree_only": ["tree"], "hybrid_no_hyde": SWITCHES[:4], "hybrid_no_crag": SWITCHES[:5],
    "hybrid_no_speculative": SWITCHES[:6], "hybrid_no_self_rag": SWITCHES[:7], "full_hybrid": SWITCHES,
}


def ablation_configs(spark) -> DataFrame:
    rows = [(name, *[s in on for s in SWITCHES]) for name, on in ABLATIONS.items()]
    return spark.createDataFrame(rows, "config string, " + ", ".join(f"{s} boolean" for s in SWITCHES))


def ablation_table(results: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per config with a column per metric, 0 where missing; results (config, metric, value). The columns are given, so no job looks for them."""
    return results.groupBy("config").pivot("metric", metrics).agg(F.round(F.max("value"), 4)).na.fill(0.0, metrics)
