"""Queries on what is decided after retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scoring as S
from ..functions import text as T
from ..operators import decisions as D
from ..operators.joins import looked_up
from ..session import materialise, table
from .registry import query
from .retrieval import DENSE, dense, fused, vectors


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense hits, worked out once for all that is done with them."""
    return materialise(dense(spark, sf_dir).select("query_id", "doc_id"), "hits")


def hits(spark: SparkSession, sf_dir: str, near: DataFrame) -> DataFrame:
    """Dense hits with the document of the vector's number as text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return looked_up(near, docs, "doc_id").select("query_id", "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def irrelevant(spark: SparkSession, sf_dir: str, near: DataFrame) -> DataFrame:
    """Hits of another label than the query's vector are judged irrelevant."""
    v = vectors(spark, sf_dir).select("doc_id", "label")
    q = v.select(F.col("doc_id").alias("query_id"), F.col("label").alias("own"))
    return near.join(v, "doc_id").join(q, "query_id").where("label <> own").select("query_id", "doc_id")


_HITS = f"""{DENSE}, hits AS (SELECT query_id, dense.doc_id, coalesce(d.text, '') AS text, v.label = q.label AS good FROM dense JOIN v ON v.doc_id = dense.doc_id JOIN v q ON q.doc_id = query_id
  LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = dense.doc_id)"""
_TRIM = "CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END"


@query(f"WITH {_HITS} SELECT query_id, doc_id, {_TRIM} AS text FROM hits WHERE good")
def crag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = found(spark, sf_dir)
    return D.crag_filter(hits(spark, sf_dir, near), irrelevant(spark, sf_dir, near))


@query(f"SELECT doc_id, {_TRIM} AS passage FROM documents")
def passage_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.passage_trim(F.col("text")).alias("passage"))


@query("""WITH g AS (SELECT doc_id, doc_id % 3 AS results, CASE doc_id % 4 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'INCORRECT' END AS judged FROM labels)
SELECT doc_id, CASE WHEN results = 0 THEN 'INCORRECT' ELSE coalesce(judged, 'AMBIGUOUS') END AS quality,
  CASE WHEN results = 0 OR judged = 'INCORRECT' THEN 'WEB_SEARCH_FALLBACK' WHEN judged = 'AMBIGUOUS' THEN 'DECOMPOSE_AND_RETRY' ELSE 'PROCEED' END AS action FROM g""")
def crag_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    judged = F.when(i % 4 == 0, "CORRECT").when(i % 4 == 1, "AMBIGUOUS").when(i % 4 == 2, "INCORRECT")
    return table(spark, sf_dir, "labels").select("doc_id", S.crag_action(i % 3, judged).alias("a")).select("doc_id", "a.*")


@query(f"""WITH {_HITS}, state AS (SELECT query_id, (CAST(query_id AS BIGINT) // 50) % 3 AS m, bool_or(good AND (CAST(query_id AS BIGINT) // 50) % 5 <> 4) AS has_good FROM hits GROUP BY query_id),
mode AS (SELECT query_id, CASE WHEN m = 1 THEN 'web' WHEN has_good THEN 'filtered' ELSE 'all' END AS mode FROM state)
SELECT query_id, doc_id, CASE WHEN mode = 'filtered' THEN {_TRIM} ELSE text END AS text, CASE WHEN mode = 'filtered' THEN 'relevant' ELSE 'retrieved' END AS origin FROM hits JOIN mode USING (query_id) WHERE mode <> 'filtered' OR good
UNION ALL SELECT query_id, 'web', 'from the web', 'web' FROM mode WHERE mode = 'web'""")
def context_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the queries is judged INCORRECT with a web hit, two thirds not; some have no relevant hit at all."""
    near = found(spark, sf_dir)
    h = materialise(hits(spark, sf_dir, near), "texts")
    n = (F.col("query_id").cast("long") / 50).cast("long")
    quality = h.select("query_id").distinct().withColumn("quality", F.when(n % 3 == 1, "INCORRECT").when(n % 3 == 2, "AMBIGUOUS").otherwise("CORRECT"))
    web = quality.where("quality = 'INCORRECT'").select("query_id", F.lit("web").alias("doc_id"), F.lit("from the web").alias("text"))
    bad = irrelevant(spark, sf_dir, near).unionByName(h.where(n % 5 == 4).select("query_id", "doc_id"))
    return D.chosen_context(h, bad, quality, web)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of a response for each labelled document, derived from its numbers; hundredths, so that sums are exact to nine places."""
    i = F.col("doc_id")
    score = lambda k: ((i * k) % 101) / 100
    return table(spark, sf_dir, "labels").select(
        "doc_id", "quality", "toxic", F.when(i % 4 == 0, "CORRECT").when(i % 4 == 1, "AMBIGUOUS").when(i % 4 == 2, "INCORRECT").otherwise("").alias("crag_quality"), (i % 7).cast("int").alias("n_sources"),
        F.when(i % 5 != 0, score(3)).alias("support"), F.when(i % 5 != 0, score(7)).alias("relevance"), F.when(i % 5 != 0, score(11)).alias("usefulness"), F.when(i % 5 != 0, score(13)).alias("citations"),
    )


SCORED = """s AS (SELECT doc_id, quality, toxic, CASE doc_id % 4 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'INCORRECT' ELSE '' END AS crag_quality, CAST(doc_id % 7 AS INTEGER) AS n_sources,
  CASE WHEN doc_id % 5 <> 0 THEN ((doc_id * 3) % 101) / 100.0::DOUBLE END AS support, CASE WHEN doc_id % 5 <> 0 THEN ((doc_id * 7) % 101) / 100.0::DOUBLE END AS relevance,
  CASE WHEN doc_id % 5 <> 0 THEN ((doc_id * 11) % 101) / 100.0::DOUBLE END AS usefulness, CASE WHEN doc_id % 5 <> 0 THEN ((doc_id * 13) % 101) / 100.0::DOUBLE END AS citations FROM labels)"""


@query(f"""WITH {SCORED}, c AS (SELECT *, CASE crag_quality WHEN 'CORRECT' THEN 0.9::DOUBLE WHEN 'AMBIGUOUS' THEN 0.5 ELSE 0.2 END AS a, CASE WHEN n_sources >= 5 THEN 0.9::DOUBLE WHEN n_sources >= 2 THEN 0.7 WHEN n_sources >= 1 THEN 0.5 ELSE 0.1 END AS b,
  (relevance + support + usefulness + citations) / 4 AS m FROM s) SELECT doc_id, round(CASE WHEN m IS NULL THEN (a + b) / 2 ELSE (a + m + b) / 3 END, 9) AS confidence FROM c""")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = (F.col("relevance") + F.col("support") + F.col("usefulness") + F.col("citations")) / 4
    return scored(spark, sf_dir).select("doc_id", F.round(S.confidence(F.col("crag_quality"), mean, F.col("n_sources")), 9).alias("confidence"))


@query(f"""WITH {SCORED} SELECT doc_id, array_to_string(list_filter([CASE WHEN crag_quality = 'INCORRECT' THEN '{fixed.WARN_INCORRECT}' END, CASE WHEN crag_quality = 'AMBIGUOUS' THEN '{fixed.WARN_AMBIGUOUS}' END,
  CASE WHEN coalesce(support, 1.0) < 0.5 THEN '{fixed.WARN_SUPPORT}' END, CASE WHEN n_sources = 0 THEN '{fixed.WARN_SOURCES}' END], lambda x: x IS NOT NULL), ' | ') AS warnings FROM s""")
def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", F.array_join(S.warnings(F.col("crag_quality"), F.col("support"), F.col("n_sources")), " | ").alias("warnings"))


@query("""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 0.5::DOUBLE ELSE ((doc_id * 3) % 101) / 100.0 END AS relevance, CASE WHEN doc_id % 6 = 0 THEN 0.5::DOUBLE ELSE quality / 1.0 END AS support, 0.5::DOUBLE AS usefulness, CASE WHEN doc_id % 6 = 0 THEN 0.5::DOUBLE ELSE 1.0 END AS citations FROM labels)
SELECT x.doc_id, relevance, support, usefulness, citations, round((relevance + support + usefulness + citations) / 4, 9) AS average, CASE WHEN x.doc_id % 6 = 0 THEN false ELSE toxic = 0 END AS passed, CASE WHEN x.doc_id % 6 <> 0 AND x.doc_id % 2 = 0 THEN 'REGENERATE' ELSE 'ACCEPT' END AS action,
  CASE WHEN x.doc_id % 6 = 0 THEN 0 ELSE 1 END AS n_unsupported FROM x JOIN labels USING (doc_id)""")
def reflection_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of a reflecting model, made from labels: usefulness and some actions missing, every sixth is no JSON."""
    i = F.col("doc_id")
    part = lambda v: F.struct(v.cast("double").alias("score"), F.lit("as told").alias("explanation"))
    support = F.struct(F.col("quality").cast("double").alias("score"), F.lit("x").alias("explanation"), F.array(F.lit("a claim")).alias("unsupported_claims"))
    raw = F.to_json(F.struct(part(((i * 3) % 101) / 100).alias("relevance"), support.alias("support"), part(F.lit(1)).alias("citations"), (F.col("toxic") == 0).alias("overall_pass"), F.when(i % 2 == 0, "REGENERATE").alias("recommended_action")))
    d = table(spark, sf_dir, "labels").select("doc_id", D.reflection(F.when(i % 6 == 0, "not json").otherwise(raw)).alias("r"))
    return d.select("doc_id", "r.relevance", "r.support", "r.usefulness", "r.citations", F.round("r.average", 9).alias("average"), "r.passed", "r.action", F.size("r.unsupported").alias("n_unsupported"))


@query("""WITH a AS (SELECT conv_id, turn // 3 AS part, turn % 3 AS turn, text, (conv_id + turn) % 4 = 0 AS failed FROM conversations),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn) AS n FROM a WHERE NOT failed),
c AS (SELECT conv_id, part, max(n) AS n FROM d GROUP BY conv_id, part), p AS (SELECT conv_id, part, least(greatest(1 + conv_id % 3, 1), n) AS pick FROM c)
SELECT a.conv_id || '-' || a.part AS query_id, coalesce(d.text, 'Unable to generate a response.') AS answer, CASE d.turn WHEN 0 THEN 'step_by_step' WHEN 1 THEN 'evidence_first' WHEN 2 THEN 'contrarian_check' END AS strategy
FROM (SELECT DISTINCT conv_id, part FROM a) a LEFT JOIN p USING (conv_id, part) LEFT JOIN d ON d.conv_id = a.conv_id AND d.part = a.part AND d.n = pick""")
def draft_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each three turns of a conversation as drafts of one question, some failed; the judge picks number 1 + conv_id % 3 of those that are left."""
    no = (F.col("turn") % 3).cast("int")
    names = F.element_at(F.array(*map(F.lit, fixed.DRAFT_STRATEGIES)), no + 1)
    asked = F.concat_ws("-", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 3).cast("string"))
    t = table(spark, sf_dir, "conversations").select(asked.alias("query_id"), "conv_id", no.alias("draft_no"), names.alias("strategy"), F.col("text").alias("answer"), ((F.col("conv_id") + F.col("turn")) % 4 == 0).alias("failed"))
    judged = t.select("query_id", (1 + F.col("conv_id") % 3).cast("int").alias("selected")).distinct()
    return D.verified(t.drop("conv_id"), judged)


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN quality = 1 THEN 'CORRECT' ELSE 'AMBIGUOUS' END AS quality, CASE WHEN doc_id % 6 = 0 THEN 0.5::DOUBLE ELSE (doc_id % 11) / 10.0::DOUBLE END AS confidence,
  CASE WHEN doc_id % 6 = 0 THEN '' ELSE doc_id || ',x' END AS relevant, 0 AS n_irrelevant FROM labels""")
def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of a judging model, made from labels: quality missing where a document is poor, every sixth is no JSON."""
    i = F.col("doc_id")
    raw = F.to_json(F.struct(F.when(F.col("quality") == 1, "CORRECT").alias("overall_quality"), ((i % 11) / 10).alias("confidence"), F.array(i.cast("string"), F.lit("x")).alias("relevant_doc_ids")))
    d = table(spark, sf_dir, "labels").select("doc_id", D.judgement(F.when(i % 6 == 0, "{broken").otherwise(raw)).alias("j"))
    return d.select("doc_id", "j.quality", "j.confidence", F.array_join("j.relevant", ",").alias("relevant"), F.size("j.irrelevant").alias("n_irrelevant"))


@query("""SELECT doc_id, CAST(unnest(CASE WHEN doc_id % 6 = 0 THEN [] WHEN doc_id % 2 = 0 THEN [7, 2] ELSE [1, 2] END) AS INTEGER) AS id, unnest(CASE WHEN doc_id % 6 = 0 THEN [] ELSE ['what is ' || doc_id, ''] END) AS question FROM labels""")
def decompose_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of a decomposing model with two sub-questions, the second without id and text; every sixth is no JSON."""
    i = F.col("doc_id")
    first = F.struct(F.when(i % 2 == 0, 7).alias("id"), F.concat(F.lit("what is "), i.cast("string")).alias("question"))
    second = F.struct(F.lit(None).cast("int").alias("id"), F.lit(None).cast("string").alias("question"))
    raw = F.to_json(F.struct(F.array(first, second).alias("sub_questions")))
    return table(spark, sf_dir, "labels").select("doc_id", F.explode(D.sub_questions(F.when(i % 6 == 0, "[").otherwise(raw))).alias("q")).select("doc_id", "q.id", "q.question")


@query("""SELECT doc_id, CAST(CASE WHEN doc_id % 6 = 0 OR quality = 0 THEN 1 ELSE 3 END AS INTEGER) AS selected, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'answer ' || doc_id END AS answer, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 1 END AS n_citations FROM labels""")
def verify_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    raw = F.to_json(F.struct(F.when(F.col("quality") == 1, 3).alias("selected_draft"), F.concat(F.lit("answer "), i.cast("string")).alias("final_answer"), F.array(F.struct(F.lit("c").alias("claim"), F.lit("s").alias("source"))).alias("citations")))
    return table(spark, sf_dir, "labels").select("doc_id", D.verification(F.when(i % 6 == 0, "?").otherwise(raw)).alias("v")).select("doc_id", "v.*")


@query("""WITH a AS (SELECT conv_id || '-' || turn AS query_id, turn, length(text) AS n, text FROM conversations)
SELECT query_id, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text || '+' ELSE text || '++' END AS answer, CAST(CASE turn % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS INTEGER) AS iterations, turn % 4 < 3 AS passed FROM a""")
def correction_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers: a model passes them after turn % 4 regenerations, each of which appends a sign; after two the loop ends."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "turn", F.col("text").alias("answer"))
    needs = c.select("query_id", (F.col("turn") % 4).alias("needs"), F.length("answer").alias("n"))

    def reflect(open_: DataFrame) -> DataFrame:
        passed = F.length("answer") - F.col("n") >= F.col("needs")
        return open_.join(needs, "query_id").select("query_id", F.to_json(F.struct(passed.alias("overall_pass"), F.lit("REGENERATE").alias("recommended_action"))).alias("json"))

    done = D.reflect_and_correct(c, reflect, lambda rest: rest.select("query_id", F.concat("answer", F.lit("+")).alias("answer")))
    return done.select("query_id", "answer", "iterations", "r.passed")


_CONF = "CASE crag_quality WHEN 'CORRECT' THEN 0.9::DOUBLE WHEN 'AMBIGUOUS' THEN 0.5 ELSE 0.2 END"
_HAVE = "CASE WHEN n_sources >= 5 THEN 0.9::DOUBLE WHEN n_sources >= 2 THEN 0.7 WHEN n_sources >= 1 THEN 0.5 ELSE 0.1 END"
_LINE = " || ".join(f"chr(10) || printf('   - {n}: %.2f', {n})" for n in ("relevance", "support", "usefulness", "citations"))


@query(f"""WITH {SCORED}, c AS (SELECT *, floor(100 * CASE WHEN support IS NULL THEN ({_CONF} + {_HAVE}) / 2 ELSE ({_CONF} + (relevance + support) / 2 + {_HAVE}) / 3 END + 0.000001) / 100 AS conf,
  list_filter([CASE WHEN crag_quality = 'INCORRECT' THEN '{fixed.WARN_INCORRECT}' END, CASE WHEN crag_quality = 'AMBIGUOUS' THEN '{fixed.WARN_AMBIGUOUS}' END, CASE WHEN coalesce(support, 1.0) < 0.5 THEN '{fixed.WARN_SUPPORT}' END,
    CASE WHEN n_sources = 0 THEN '{fixed.WARN_SOURCES}' END], lambda x: x IS NOT NULL) AS w FROM s)
SELECT doc_id, '1. ROUTING: Query classified as [moderate] (type: factoid)' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '   - Decomposed into 2 sub-questions:' || chr(10) || '     * one?' || chr(10) || '     * two?' ELSE '' END || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN '2. HyDE: Generated hypothetical answer document ("a hypothetical answer...")' ELSE '2. HyDE: Skipped (not enabled for this query type)' END || chr(10)
  || '3. RETRIEVAL: Used 2 channels:' || chr(10) || '   - vector: 20 results' || chr(10) || '   - bm25: 15 results' || chr(10)
  || CASE WHEN crag_quality <> '' THEN '4. CRAG EVALUATION: Quality=' || crag_quality || ', Action=PROCEED' || CASE WHEN crag_quality = 'INCORRECT' THEN chr(10) || '   - Web search fallback was triggered' ELSE '' END ELSE '4. CRAG: Skipped' END || chr(10)
  || '5. SPECULATIVE RAG (MoT): Generated 3 drafts:' || chr(10) || '   - step_by_step <-- SELECTED' || chr(10) || '   - evidence_first' || chr(10) || '   - contrarian_check' || chr(10)
  || CASE WHEN support IS NOT NULL THEN '6. SELF-RAG: 1 reflection iteration(s)' || {_LINE} ELSE '6. SELF-RAG: Skipped' END || chr(10)
  || printf('7. RESULT: Confidence=%.1f%%, %d sources, latency=12ms', conf * 100, n_sources) || CASE WHEN len(w) > 0 THEN chr(10) || '   WARNINGS:' || chr(10) || '   - ' || array_to_string(w, chr(10) || '   - ') ELSE '' END AS explanation FROM c""")
def explain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = scored(spark, sf_dir), F.col
    names = ("relevance", "support", "usefulness", "citations")
    rows = s.select(
        "doc_id", F.lit("moderate").alias("strategy"), F.lit("factoid").alias("query_type"), F.when(c("doc_id") % 3 == 0, F.array(F.lit("one?"), F.lit("two?"))).otherwise(F.array().cast("array<string>")).alias("sub_questions"), (c("doc_id") % 2 == 0).alias("hyde_used"),
        F.lit("a hypothetical answer").alias("hyde_document"), F.array(F.struct(F.lit("vector").alias("channel"), F.lit(20).alias("n")), F.struct(F.lit("bm25").alias("channel"), F.lit(15).alias("n"))).alias("channel_counts"), "crag_quality",
        F.lit("PROCEED").alias("crag_action"), (c("crag_quality") == "INCORRECT").alias("web_used"), F.array(*map(F.lit, fixed.DRAFT_STRATEGIES)).alias("strategies"), F.lit(fixed.DRAFT_STRATEGIES[0]).alias("selected"),
        F.when(c("support").isNotNull(), 1).otherwise(0).alias("iterations"), F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(n, F.lit(0.0)).alias("score")) for n in names]).alias("scores"),
        (F.floor(100 * S.confidence(c("crag_quality"), (c("relevance") + c("support")) / 2, c("n_sources")) + 0.000001) / 100).alias("confidence"), "n_sources", F.lit(12.0).alias("latency_ms"), S.warnings(c("crag_quality"), c("support"), c("n_sources")).alias("warnings"),
    )
    return rows.select("doc_id", D.explanation(rows).alias("explanation"))


@query()
def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source references of the fused results as JSON, scores to three places, snippets of 200 characters."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    r = looked_up(materialise(fused(spark, sf_dir).drop("text"), "fused"), texts, "doc_id").withColumn("source", F.lit(None).cast("string"))
    d = D.sources(r)
    short = F.transform("sources", lambda s: F.struct(s["doc_id"].alias("doc_id"), F.substring(s["text_snippet"], 1, 200).alias("text_snippet"), s["source"].alias("source"), F.round(s["relevance_score"], 3).alias("relevance_score"), s["channel"].alias("channel")))
    return d.select("query_id", F.to_json(F.struct("query_id", short.alias("sources"))).alias("response"))
