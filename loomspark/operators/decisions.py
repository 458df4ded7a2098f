"""What is decided from model output after retrieval, as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialise
from . import fusion

_SCORE = "score:double,explanation:string"
REFLECTION = f"relevance struct<{_SCORE}>, support struct<{_SCORE},unsupported_claims:array<string>>, usefulness struct<{_SCORE}>, citations struct<{_SCORE},missing_citations:array<string>>, overall_pass boolean, recommended_action string"
JUDGEMENT = "overall_quality string, confidence double, reasoning string, relevant_doc_ids array<string>, irrelevant_doc_ids array<string>, missing_information string, recommended_action string"
DECOMPOSITION = "complexity_reasoning string, sub_questions array<struct<id:int,question:string,purpose:string,depends_on:array<int>>>, synthesis_plan string"
VERIFICATION = "selected_draft int, reasoning string, final_answer string, citations array<struct<claim:string,source:string>>"


def reflection(raw: Column) -> Column:
    """struct of the four scores (0.5 if missing), their mean, pass and action (ACCEPT if missing) from JSON."""
    r = F.from_json(raw, REFLECTION)
    s = {k: F.coalesce(r[k]["score"], F.lit(0.5)) for k in ("relevance", "support", "usefulness", "citations")}
    mean = (s["relevance"] + s["support"] + s["usefulness"] + s["citations"]) / 4
    return F.struct(*[v.alias(k) for k, v in s.items()], mean.alias("average"), F.coalesce(r["overall_pass"], F.lit(False)).alias("passed"), F.coalesce(r["recommended_action"], F.lit("ACCEPT")).alias("action"), F.coalesce(r["support"]["unsupported_claims"], F.array().cast("array<string>")).alias("unsupported"))


def judgement(raw: Column) -> Column:
    """struct<quality, confidence, relevant, irrelevant, missing> from a judge's JSON; AMBIGUOUS and 0.5 where it says nothing, null quality where it is no JSON."""
    r = F.from_json(raw, JUDGEMENT)
    bad = F.coalesce(r["overall_quality"], r["reasoning"], r["recommended_action"], F.when(r["confidence"].isNotNull(), "")).isNull()
    ids = lambda c: F.coalesce(r[c], F.array().cast("array<string>"))
    return F.struct(
        F.when(~bad, F.coalesce(r["overall_quality"], F.lit("AMBIGUOUS"))).alias("quality"), F.coalesce(r["confidence"], F.lit(0.5)).alias("confidence"), ids("relevant_doc_ids").alias("relevant"), ids("irrelevant_doc_ids").alias("irrelevant"),
        F.coalesce(r["missing_information"], F.lit("")).alias("missing"),
    )


def sub_questions(raw: Column) -> Column:
    """array<struct<id,question,purpose,depends_on>> from a decomposition's JSON; a missing id is the place from 1."""
    qs = F.coalesce(F.from_json(raw, DECOMPOSITION)["sub_questions"], F.array().cast("array<struct<id:int,question:string,purpose:string,depends_on:array<int>>>"))
    return F.transform(qs, lambda q, i: F.struct(F.coalesce(q["id"], i + 1).alias("id"), F.coalesce(q["question"], F.lit("")).alias("question"), F.coalesce(q["purpose"], F.lit("")).alias("purpose"), F.coalesce(q["depends_on"], F.array().cast("array<int>")).alias("depends_on")))


def verification(raw: Column) -> Column:
    """struct<selected (from 1), answer, n_citations> from a verifier's JSON."""
    r = F.from_json(raw, VERIFICATION)
    return F.struct(F.coalesce(r["selected_draft"], F.lit(1)).alias("selected"), F.coalesce(r["final_answer"], F.lit("")).alias("answer"), F.coalesce(F.size(r["citations"]), F.lit(0)).alias("n_citations"))


def feedback(r: Column) -> Column:
    """What a regeneration is told: the scores below 0.6 and the unsupported claims of a reflection struct."""
    low = [F.when(r[k] < 0.6, F.format_string(f"{k} is low (%.2f)", r[k])) for k in ("relevance", "support", "usefulness", "citations")]
    return F.concat_ws("; ", *low, F.when(F.size(r["unsupported"]) > 0, F.concat(F.lit("unsupported: "), F.array_join(r["unsupported"], ", "))))


def reflect_and_correct(answers: DataFrame, reflect, regenerate, rounds: int = 2) -> DataFrame:
    """query_id, answer, r (the last reflection), iterations for answers (query_id, answer).

    reflect (query_id, answer) -> (query_id, json); regenerate (query_id, answer, feedback) -> (query_id, answer). Answers that pass or are to be
    accepted stop; the others are written anew, at most `rounds` times, each round one job over all that are still open, written out.
    """
    open_, done = answers.select("query_id", "answer"), None
    for i in range(1, rounds + 2):
        seen = materialise(open_.join(reflect(open_).withColumn("r", reflection(F.col("json"))).select("query_id", "r"), "query_id").withColumn("iterations", F.lit(i)), "reflected")
        stop = F.col("r.passed") | (F.col("r.action") == "ACCEPT")
        part = seen if i > rounds else seen.where(stop)
        done = part if done is None else done.unionByName(part)
        rest = seen.where(~stop)
        if i > rounds or rest.isEmpty():
            break
        open_ = materialise(regenerate(rest.select("query_id", "answer", feedback(F.col("r")).alias("feedback"))).select("query_id", "answer"), "regenerated")
    return done


def display(response: DataFrame) -> Column:
    """A response as text for a terminal, from columns answer, confidence, sources, strategy, query_type, warnings."""
    lines = F.transform("sources", lambda s, i: F.format_string("\n  [%d] %s (score: %.3f, via: %s)\n      %s...", i + 1, s["source"], s["relevance_score"], s["channel"], F.substring(s["text_snippet"], 1, 150)))
    n = F.coalesce(F.size("sources"), F.lit(0))
    listed = F.when(n > 0, F.concat(F.format_string("\n\nSources (%d):", n), F.array_join(lines, ""))).otherwise("")
    warn = F.when(F.size("warnings") > 0, F.concat(F.lit("\n\nWarnings:"), F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("\n  - "), w)), ""))).otherwise("")
    return F.concat(F.format_string("Answer: %s\n\nConfidence: %.1f%%", "answer", F.col("confidence") * 100), listed, F.format_string("\n\nRetrieval Trace:\n  Strategy: %s\n  Query Type: %s", "strategy", "query_type"), warn)


def crag_filter(results: DataFrame, irrelevant: DataFrame) -> DataFrame:
    """results (query_id, doc_id, text) without those judged irrelevant (query_id, doc_id), long passages trimmed."""
    return results.join(irrelevant.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti").withColumn("text", T.passage_trim(F.col("text")))


def chosen_context(results: DataFrame, irrelevant: DataFrame, quality: DataFrame, web: DataFrame) -> DataFrame:
    """query_id, doc_id, text, origin: unfiltered results and web hits where retrieval was INCORRECT and the web has some, else the relevant ones, else all.

    quality (query_id, quality), web (query_id, doc_id, text).
    """
    good = crag_filter(results, irrelevant)
    state = results.select("query_id").distinct().join(quality, "query_id", "left")
    state = state.join(web.select("query_id").distinct().withColumn("has_web", F.lit(True)), "query_id", "left").join(good.select("query_id").distinct().withColumn("has_good", F.lit(True)), "query_id", "left")
    mode = F.when((F.col("quality") == "INCORRECT") & F.col("has_web"), "web").when(F.col("has_good"), "filtered").otherwise("all")
    state = state.select("query_id", mode.alias("mode"))
    cols = ["query_id", "doc_id", "text"]
    part = lambda df, modes: df.select(cols).join(state.where(F.col("mode").isin(modes)).select("query_id", "mode"), "query_id")
    rows = part(results, ["web", "all"]).withColumn("origin", F.lit("retrieved")).unionByName(part(good, ["filtered"]).withColumn("origin", F.lit("relevant")))
    return rows.unionByName(part(web, ["web"]).withColumn("origin", F.lit("web"))).drop("mode")


def verified(drafts: DataFrame, judged: DataFrame) -> DataFrame:
    """query_id, answer, strategy: the judge's choice counts the drafts that did not fail, from 1; without any a fixed message.

    drafts (query_id, draft_no, strategy, answer, failed), judged (query_id, selected).
    """
    alive = drafts.where("not failed").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("draft_no", "strategy", "answer"))).alias("d"))
    all_ = drafts.select("query_id").distinct().join(alive, "query_id", "left").join(judged, "query_id", "left")
    i = F.least(F.greatest(F.coalesce("selected", F.lit(1)), F.lit(1)), F.size("d"))
    pick = F.when(F.size("d") > 0, F.element_at("d", i))
    return all_.select("query_id", F.coalesce(pick["answer"], F.lit("Unable to generate a response.")).alias("answer"), pick["strategy"].alias("strategy"))


def sources(results: DataFrame) -> DataFrame:
    """query_id, sources: array of struct<doc_id,text_snippet,source,relevance_score,channel> in rank order; results are a fused top list."""
    ref = F.struct("rank", "doc_id", F.substring("text", 1, 300).alias("text_snippet"), F.coalesce("source", "doc_id").alias("source"), F.col("fused_score").alias("relevance_score"), fusion.primary_channel(F.col("channel_scores")).alias("channel"))
    return results.groupBy("query_id").agg(F.array_sort(F.collect_list(ref)).alias("sources"))


def explanation(r: DataFrame) -> Column:
    """The steps of a response as text, from columns strategy, query_type, sub_questions, hyde_used, hyde_document, channel_counts, crag_quality,
    crag_action, web_used, strategies, selected, iterations, scores, confidence, n_sources, latency_ms, warnings."""
    c = F.col
    listed = lambda head, items, line: F.concat(head, F.concat_ws("", F.transform(items, lambda x: F.concat(F.lit("\n"), line(x)))))
    subs = F.when(F.size("sub_questions") > 0, listed(F.format_string("\n   - Decomposed into %d sub-questions:", F.size("sub_questions")), c("sub_questions"), lambda x: F.concat(F.lit("     * "), x))).otherwise("")
    hyde = F.when(c("hyde_used"), F.concat(F.lit('2. HyDE: Generated hypothetical answer document ("'), F.substring("hyde_document", 1, 80), F.lit('...")'))).otherwise("2. HyDE: Skipped (not enabled for this query type)")
    channels = listed(F.format_string("3. RETRIEVAL: Used %d channels:", F.size("channel_counts")), c("channel_counts"), lambda x: F.format_string("   - %s: %d results", x["channel"], x["n"]))
    crag = F.when(c("crag_quality") != "", F.concat(F.format_string("4. CRAG EVALUATION: Quality=%s, Action=%s", "crag_quality", "crag_action"), F.when(c("web_used"), "\n   - Web search fallback was triggered").otherwise(""))).otherwise("4. CRAG: Skipped")
    drafts = F.when(F.size("strategies") > 0, listed(F.format_string("5. SPECULATIVE RAG (MoT): Generated %d drafts:", F.size("strategies")), c("strategies"), lambda x: F.concat(F.lit("   - "), x, F.when(x == c("selected"), " <-- SELECTED").otherwise("")))).otherwise("5. SPECULATIVE RAG: Skipped")
    reflect = F.when(c("iterations") > 0, listed(F.format_string("6. SELF-RAG: %d reflection iteration(s)", "iterations"), c("scores"), lambda x: F.format_string("   - %s: %.2f", x["name"], x["score"]))).otherwise("6. SELF-RAG: Skipped")
    result = F.format_string("7. RESULT: Confidence=%.1f%%, %d sources, latency=%.0fms", c("confidence") * 100, "n_sources", "latency_ms")
    warn = F.when(F.size("warnings") > 0, listed(F.lit("\n   WARNINGS:"), c("warnings"), lambda x: F.concat(F.lit("   - "), x))).otherwise("")
    return F.concat(F.format_string("1. ROUTING: Query classified as [%s] (type: %s)", "strategy", "query_type"), subs, F.lit("\n"), hyde, F.lit("\n"), channels, F.lit("\n"), crag, F.lit("\n"), drafts, F.lit("\n"), reflect, F.lit("\n"), result, warn)
