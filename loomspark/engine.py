"""The whole pipeline: ingest builds and stores the indexes, query answers a batch of questions.

Questions are rows, not calls: each step is one plan over all of them. Model calls go through providers.
"""

from __future__ import annotations

import functools
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import providers as P
from .config import Settings
from .functions import fixed, guard, pii, routing
from .functions import scoring as S
from .operators import audit, chunking, decisions, evaluation, fusion, graph, search, tree
from .operators.joins import looked_up
from .session import materialise
from .sources import files
from .tracing import Tracer, traced

TABLES = ["chunks", "nodes", "edges", "communities", "summaries", "tree", "postings", "lengths", "embeddings"]


class Engine:
    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None, *, summary=None, embedder=None, scorer=None, web=None, extractor=None, judge=None, reflector=None, verifier=None, splitter=None, query_entities=None, names=None, tracer=None):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings or Settings.from_environment()
        self.summary, self.embedder, self.scorer = summary or P.ExtractiveSummary(), embedder or P.HashedEmbedder(self.settings.embedding_dim), scorer or P.WordOverlap()
        self.web, self.extractor = web or P.NoWeb(), extractor or P.CapitalisedExtractor()
        self.judge, self.reflector, self.verifier = judge or P.OverlapJudge(), reflector or P.OverlapReflector(), verifier or P.OverlapVerifier()
        self.splitter, self.query_entities = splitter or P.Splitter(), query_entities or P.CapitalisedQueryEntities()
        self.names, self.tracer = names, tracer or Tracer()
        self.tables: dict[str, DataFrame] = {}

    def _screened(self, rows: DataFrame, key: str, column: str) -> DataFrame:
        """rows with a column free of personal data: by patterns, and by the model for names where one is given."""
        text = F.col(column)
        if self.names is None:
            return rows.withColumn(column, pii.redacted(text, pii.kept(pii.detections(text))))
        found = self.names.entities(rows.select(F.col(key).alias("id"), text.alias("text"))).select(F.col("id").alias(key), F.col("found").alias("__found"))
        return rows.join(found, key, "left").withColumn(column, pii.redacted(text, pii.swept(text, pii.detections(text), F.col("__found")))).drop("__found")

    @traced
    def ingest(self, source: str | DataFrame, glob: str = "*") -> dict:
        """Build all stores from a file, a folder or a DataFrame (source, text); returns counts."""
        began, s = time.time(), self.settings
        docs = source if isinstance(source, DataFrame) else files.read_directory(self.spark, source, glob)
        chunks = materialise(chunking.chunk_documents(docs, s.chunk_size, s.chunk_overlap), "chunks")
        told = chunks.select("chunk_id", "text", F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 40)).alias("ord"))
        nodes = materialise(graph.dedupe_entities(self.extractor.entities(told)), "nodes")
        edges = materialise(graph.build_edges(nodes, graph.dedupe_edges(self.extractor.edges(told))), "edges")
        members = materialise(graph.label_propagation(nodes, edges), "communities")
        context = graph.community_context(members, nodes, edges, chunks)
        summaries = self.summary.complete(context.select(F.col("community").alias("id"), F.concat_ws("\n", "chunks", "entities", "relationships").alias("prompt"))).select(F.col("id").alias("community"), F.col("text").alias("summary"))
        embedded = materialise(chunks.select(F.col("chunk_id").alias("id"), "text").transform(self.embedder.embed), "embedded").select(F.col("id").alias("doc_id"), "embedding")
        leaves = chunks.select("chunk_id", "text").join(embedded.withColumnRenamed("doc_id", "chunk_id"), "chunk_id")
        built = materialise(tree.build_tree(leaves, self.summary.summaries, lambda n: self.embedder.embed(n.select(F.col("node_id").alias("id"), "text")).withColumnRenamed("id", "node_id"), s), "tree")
        # Both indexes hold the chunks and the summaries above the leaves.
        corpus = chunks.select(F.col("chunk_id").alias("doc_id"), "text").unionByName(built.where("level > 0").select(F.col("node_id").alias("doc_id"), "text"))
        vectors = embedded.unionByName(built.where("level > 0").select(F.col("node_id").alias("doc_id"), "embedding"))
        stores = {"chunks": chunks, "nodes": nodes, "edges": edges, "communities": members, "summaries": members.join(summaries, "community"), "tree": built, "lengths": corpus, "embeddings": vectors}
        files.save_tables(stores, self.folder)
        files.save_postings(search.postings(corpus), f"{self.folder}/postings")
        self.load()
        counts = {name: self.tables[name].count() for name in ("chunks", "nodes", "edges", "tree", "embeddings")}
        return {
            "chunks": counts["chunks"], "entities": counts["nodes"], "relationships": counts["edges"], "graph_nodes": counts["nodes"], "graph_edges": counts["edges"], "communities": members.select("community").distinct().count(),
            "tree_nodes": counts["tree"], "tree_levels": (built.agg(F.max("level")).first()[0] or 0) + 1, "vector_index_size": counts["embeddings"], "elapsed_seconds": round(time.time() - began, 2),
        }

    def load(self) -> None:
        """Open all stores, the chunks too, so that no channel is off after a restart."""
        self.tables = files.load_tables(self.spark, self.folder, TABLES)

    def health(self) -> dict:
        return {"status": "healthy", **{name: df.count() for name, df in self.tables.items() if name in ("chunks", "nodes", "tree")}}

    def explain(self, trace_id: str) -> DataFrame:
        return files.read_audit(self.spark, f"{self.folder}/audit", trace_id)

    def channels(self, asked: DataFrame, only: list[str] | None = None, hyde: bool = True) -> DataFrame:
        """Hits (query_id, channel, doc_id, rank, score, text) of all or some channels for questions (query_id, text).

        With hyde the vector channel is the better of the hits of the question and of a hypothetical answer. Only what the channels need is worked out."""
        s, t, wanted = self.settings, self.tables, [c for c in fusion.CHANNELS if only is None or c in only]
        q = materialise(self.embedder.embed(asked.select(F.col("query_id").alias("id"), "text")).select(F.col("id").alias("query_id"), F.col("embedding").alias("q_embedding")), "asked")
        corpus = t["lengths"]
        told = lambda hits, texts: looked_up(materialise(hits, "hits"), texts, "doc_id", "inner")
        found = {}
        if "vector" in wanted:
            found["vector"] = told(self._dense(asked, q, hyde and s.hyde_enabled), corpus)
        if "bm25" in wanted:
            found["bm25"] = told(search.bm25_topk(corpus, asked, s.bm25_top_k, t["postings"]), corpus)
        if "graph" in wanted:
            found["graph"] = graph.graph_channel(self.query_entities.entities(asked), t["nodes"], t["edges"], t["summaries"], t["chunks"], s.graph_top_k, s)
        if "tree" in wanted:
            found["tree"] = told(tree.tree_topk(t["tree"], q, s.tree_top_k, settings=s), t["tree"].select(F.col("node_id").alias("doc_id"), "text"))
        parts = [df.select("query_id", F.lit(name).alias("channel"), "doc_id", "rank", "score", "text") for name, df in found.items()]
        return functools.reduce(DataFrame.unionByName, parts)

    def _dense(self, asked: DataFrame, q: DataFrame, hyde: bool) -> DataFrame:
        s, t = self.settings, self.tables
        vec = search.dense_topk(t["embeddings"], q, s.dense_top_k)
        if hyde:
            guess = self.summary.complete(asked.select(F.col("query_id").alias("id"), F.col("text").alias("prompt")))
            h = materialise(self.embedder.embed(guess).select(F.col("id").alias("query_id"), F.col("embedding").alias("q_embedding")), "guessed")
            vec = search.merged(vec, search.dense_topk(t["embeddings"], h, s.dense_top_k), s.dense_top_k)
        return vec

    @traced
    def query(self, queries: DataFrame, users: DataFrame | None = None, acls: DataFrame | None = None, now: str = "1970-01-01T00:00:00") -> DataFrame:
        """Responses for questions (query_id, text, user_id, role): blocked, strategy, answer, sources, confidence, warnings, trace_id; audit rows are appended."""
        s = self.settings
        g = guard.check(F.col("text"), limit=s.max_query_length)
        q = queries.withColumn("trace_id", audit.trace_id(F.col("query_id").cast("string"), F.col("text"), F.lit(now))).withColumn("timestamp", F.lit(now)).withColumn("guard", g)
        clean = F.col("guard.sanitized_query")
        q = self._screened(q.withColumn("question", clean), "query_id", "question")
        q = materialise(q.withColumn("plan", routing.route(F.col("question"), s.hyde_enabled)), "questions")
        open_ = q.where("guard.is_safe")
        hard = open_.where("plan.strategy <> 'simple'")
        results = fusion.fuse(self.channels(hard.select("query_id", F.col("question").alias("text"))), settings=s).withColumn("source", F.col("doc_id"))
        if users is not None and acls is not None:
            results = fusion.permitted(results.join(hard.select("query_id", "user_id"), "query_id"), users, acls).drop("user_id")
        best = materialise(self._reranked(results, hard, now), "context")
        judged = materialise(self.judge.judge(best.where("rank <= 10").join(hard.select("query_id", "question"), "query_id")).withColumn("j", decisions.judgement(F.col("json"))), "judged")
        bad = judged.select("query_id", F.explode("j.irrelevant").alias("doc_id"))
        web = self.web.search(judged.where("j.quality = 'INCORRECT'").join(hard, "query_id").select("query_id", F.col("question").alias("text")))
        context = decisions.chosen_context(best, bad, judged.select("query_id", "j.quality"), web).join(best.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
        order = Window.partitionBy("query_id").orderBy(F.col("rank").asc_nulls_last(), "doc_id")
        context = materialise(context.withColumn("rank", F.row_number().over(order)), "chosen")
        drafts = materialise(self._drafts(context, hard), "drafts")
        told_in = context.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("context"))
        alive = drafts.where("not failed").join(hard.select("query_id", "question"), "query_id").join(told_in, "query_id")
        picked = self.verifier.verify(alive.select("query_id", "question", "context", "draft_no", "answer")).select("query_id", decisions.verification(F.col("json"))["selected"].alias("selected"))
        answered = decisions.verified(drafts, picked)
        reflect = lambda a: self.reflector.reflect(a.join(hard.select("query_id", "question"), "query_id").join(told_in, "query_id"))
        again = lambda a: self.summary.complete(a.select(F.col("query_id").alias("id"), F.concat_ws("\n", "answer", "feedback").alias("prompt"))).select(F.col("id").alias("query_id"), F.col("text").alias("answer"))
        corrected = decisions.reflect_and_correct(answered.join(told_in.select("query_id"), "query_id"), reflect, again, s.reflection_loops)
        answered = answered.select("query_id", "strategy").join(corrected, "query_id")
        told = decisions.sources(best).withColumn("n_sources", F.size("sources"))
        used = best.select("query_id", F.explode(F.map_keys("channel_ranks")).alias("channel")).groupBy("query_id").agg(F.array_sort(F.collect_set("channel")).alias("channels"))
        split = self.splitter.decompose(hard.where("plan.strategy = 'complex'").select("query_id", "question")).select("query_id", decisions.sub_questions(F.col("json")).alias("sub_questions"))
        simple = self.summary.complete(open_.where("plan.strategy = 'simple'").select(F.col("query_id").alias("id"), F.col("question").alias("prompt"))).select(F.col("id").alias("query_id"), F.col("text").alias("answer"), F.lit(None).cast("string").alias("draft"))
        answers = answered.withColumnRenamed("strategy", "draft").unionByName(simple.select("query_id", "answer", "draft"), allowMissingColumns=True)
        out = q.join(answers, "query_id", "left").join(judged.select("query_id", "j.quality"), "query_id", "left").join(told, "query_id", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))
        out = out.join(used, "query_id", "left").join(split, "query_id", "left")
        crag = S.crag_action(F.col("n_sources"), F.col("quality"))
        quality = F.coalesce("quality", F.lit(""))
        mean = F.col("r.average")
        out = self._screened(out.withColumn("answer", F.coalesce("answer", F.lit(""))), "query_id", "answer")
        out = out.select(
            "query_id", "trace_id", "timestamp", "user_id", (~F.col("guard.is_safe")).alias("blocked"), F.col("question").alias("query"), F.col("plan.strategy").alias("strategy"), F.col("plan.query_type").alias("query_type"),
            F.when(F.col("guard.is_safe"), F.col("answer")).otherwise(F.col("guard.blocked_reason")).alias("answer"), "sources", "n_sources", crag["quality"].alias("crag_quality"), crag["action"].alias("crag_action"),
            F.when(F.col("guard.is_safe"), S.confidence(quality, mean, F.col("n_sources"))).otherwise(0.0).alias("confidence"),
            S.warnings(quality, F.col("r.support"), F.col("n_sources")).alias("warnings"), F.coalesce("iterations", F.lit(0)).alias("iterations"), "draft", F.lit(P.PROVIDER).alias("provider"), F.col("guard.risk_score").alias("risk_score"), "channels", "sub_questions",
        )
        out = materialise(out, "responses")
        log = f"{self.folder}/audit"
        files.append_audit(audit.query_events(queries.join(out.select("query_id", "trace_id", "timestamp"), "query_id").withColumnRenamed("text", "query").withColumnRenamed("role", "user_role")), log)
        files.append_audit(audit.security_events(out.where("blocked").withColumnRenamed("answer", "reason")), log)
        rest = out.where("not blocked").withColumn("latency_ms", F.lit(0.0))
        files.append_audit(audit.retrieval_events(rest.withColumn("num_results", F.col("n_sources"))), log)
        files.append_audit(audit.generation_events(rest.withColumn("model", F.col("provider")).withColumn("num_drafts", F.when(F.col("draft").isNotNull(), s.drafts).otherwise(0))), log)
        files.append_audit(audit.response_events(out.withColumn("latency_ms", F.lit(0.0))), log)
        return out

    @traced
    def evaluate(self, gold: DataFrame, k: int = 10, only: list[str] | None = None, hyde: bool = True) -> DataFrame:
        """Ranking metrics per gold query (query_id, text, gold_source_ids), over all channels or some, with or without hypothetical answers (ablation)."""
        asked = gold.select("query_id", "text")
        found = fusion.fuse(self.channels(asked, only, hyde), k, self.settings).select("query_id", "doc_id", "rank")
        return evaluation.ranking_metrics(asked, found, gold.select("query_id", F.explode("gold_source_ids").alias("doc_id")), k)

    @traced
    def ablation(self, gold: DataFrame, k: int = 10) -> DataFrame:
        """One row of mean metrics for each configuration; those that differ only after retrieval have equal rows here."""
        names, rows, runs = ["precision_at_k", "recall_at_k", "mrr", "ndcg_at_k", "hit_rate"], None, {}
        for config, on in evaluation.ABLATIONS.items():
            key = tuple(c for c in fusion.CHANNELS if c in on), "hyde" in on
            if key not in runs:
                runs[key] = materialise(evaluation.metric_means(self.evaluate(gold, k, list(key[0]), key[1]), names), "means")
            part = runs[key].withColumn("config", F.lit(config))
            rows = part if rows is None else rows.unionByName(part)
        return evaluation.ablation_table(rows, names)

    def _reranked(self, results: DataFrame, questions: DataFrame, now: str) -> DataFrame:
        """The fused results in the order of three signals (relevance, coherence with the question's entities, recency where chunks have a created_at) and diversity."""
        s = self.settings
        r = materialise(results.join(questions.select("query_id", "question"), "query_id"), "fused")
        asked = self.query_entities.entities(questions.select("query_id", F.col("question").alias("text")))
        have = r.select("query_id", "doc_id").join(graph.chunk_entities(self.tables["nodes"]).withColumnRenamed("chunk_id", "doc_id"), "doc_id")
        r = r.join(fusion.graph_coherence(have, asked, self.tables["edges"], s), ["query_id", "doc_id"], "left")
        if "created_at" in self.tables["chunks"].columns:
            r = r.join(self.tables["chunks"].select(F.col("chunk_id").alias("doc_id"), F.col("created_at").cast("timestamp").alias("created_at")), "doc_id", "left").withColumn("recency", S.temporal_bonus(F.col("created_at"), F.lit(now).cast("timestamp"))).drop("created_at")
        else:
            r = r.withColumn("recency", F.lit(0.0))
        r = r.withColumn("ce", self.scorer.score(F.col("question"), F.col("text")) + F.coalesce("coherence", F.lit(0.0)) + F.coalesce("recency", F.lit(0.0)))
        embedded = self.tables["embeddings"].unionByName(self.tables["tree"].where("level = 0").select(F.col("node_id").alias("doc_id"), "embedding"))
        cand = looked_up(materialise(r.select("query_id", "doc_id", "rank", "ce"), "scored"), embedded, "doc_id").select("query_id", "doc_id", F.col("rank").alias("ord"), F.col("ce").alias("relevance"), F.coalesce("embedding", F.array().cast("array<double>")).alias("embedding"))
        picks = fusion.mmr(cand, settings=s)
        return r.drop("rank", "question", "coherence", "recency").join(picks, ["query_id", "doc_id"]).withColumn("fused_score", F.col("ce")).withColumnRenamed("pick", "rank")

    def _drafts(self, context: DataFrame, questions: DataFrame) -> DataFrame:
        """One draft for each strategy from its share of the passages."""
        dealt = fusion.round_robin(context.select("query_id", "rank", "text"), self.settings.drafts)
        joined = dealt.groupBy("query_id", "draft").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("prompt"))
        told = self.summary.complete(joined.select(F.struct("query_id", "draft").alias("id"), "prompt"))
        return told.select("id.query_id", F.col("id.draft").cast("int").alias("draft_no"), F.element_at(F.array(*map(F.lit, fixed.DRAFT_STRATEGIES)), (F.col("id.draft") + 1).cast("int")).alias("strategy"), F.col("text").alias("answer"), (F.col("text") == "").alias("failed"))
