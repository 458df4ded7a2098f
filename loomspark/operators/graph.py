"""The entity graph: deduplication, build, neighbourhoods, matching, contexts and communities, all as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import scoring as S
from ..functions import text as T
from ..session import materialise
from .components import connected_components
from .joins import meet, small

EXTRACTION = "entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,target:string,type:string,description:string,confidence:double>>"


def parse_extraction(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges from model output in JSON (chunk_id, ord, json); what cannot be parsed gives none."""
    parsed = raw.select("chunk_id", "ord", F.from_json("json", EXTRACTION).alias("p"))
    e = parsed.select("chunk_id", "ord", F.posexplode("p.entities").alias("i", "e"))
    entities = e.select(
        "chunk_id", (F.col("ord") * 1000 + F.col("i")).alias("ord"), T.normalised_name(F.col("e.name")).alias("name"), F.coalesce("e.type", F.lit("CONCEPT")).alias("entity_type"), F.coalesce("e.description", F.lit("")).alias("description")
    ).where("name is not null and name <> ''")
    r = parsed.select("chunk_id", "ord", F.posexplode("p.relationships").alias("i", "r"))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("r.confidence", F.lit(0.7))))
    edges = r.select(
        "chunk_id", (F.col("ord") * 1000 + F.col("i")).alias("ord"), T.normalised_name(F.col("r.source")).alias("source"), T.normalised_name(F.col("r.target")).alias("target"),
        F.coalesce("r.type", F.lit("RELATES_TO")).alias("relation_type"), F.coalesce("r.description", F.lit("")).alias("description"), conf.alias("confidence"),
    ).where("source <> '' and target <> ''")
    return entities, edges


def dedupe_entities(entities: DataFrame) -> DataFrame:
    """One row per name regardless of case: first name and type, longest description (the first of them), all chunks."""
    g = entities.groupBy(F.lower("name").alias("key"))
    return g.agg(
        F.min_by("name", "ord").alias("name"), F.min_by("entity_type", "ord").alias("entity_type"), F.max_by("description", F.struct(F.length("description"), -F.col("ord"))).alias("description"),
        F.array_sort(F.collect_set("chunk_id")).alias("source_chunks"), F.min("ord").alias("ord"),
    )


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One row per source, type and target regardless of case: highest confidence, first description, all chunks."""
    g = edges.groupBy(F.lower("source").alias("s"), "relation_type", F.lower("target").alias("t"))
    return g.agg(
        F.min_by("source", "ord").alias("source"), F.min_by("target", "ord").alias("target"), F.max("confidence").alias("confidence"), F.min_by("description", "ord").alias("description"),
        F.array_sort(F.collect_set("chunk_id")).alias("source_chunks"), F.min("ord").alias("ord"),
    ).drop("s", "t")


def build_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends exist, case and all; of several for one ordered pair the last stays."""
    names = nodes.select("name")
    ends = edges.join(names.withColumnRenamed("name", "source"), "source", "left_semi").join(names.withColumnRenamed("name", "target"), "target", "left_semi")
    rest = [c for c in edges.columns if c not in ("source", "target")]
    # Of edges with the same order the greatest, so that the result does not depend on how rows are dealt.
    last = F.max(F.struct("ord", *[c for c in rest if c != "ord"])).alias("r")
    return ends.groupBy("source", "target").agg(last).select("source", "target", *[F.col(f"r.{c}").alias(c) for c in rest])


def chunk_entities(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("source_chunks").alias("chunk_id"), F.col("name").alias("entity")).distinct()


def neighbours(edges: DataFrame, starts: DataFrame, hops: int = 2, least: float = 0.5) -> DataFrame:
    """start, node, depth: nodes within hops steps along edges of enough confidence, in either direction; starts (start)."""
    strong = edges.where(F.coalesce("confidence", F.lit(0.5)) >= least)
    both = strong.select(F.col("source").alias("node"), F.col("target").alias("to")).unionByName(strong.select(F.col("target").alias("node"), F.col("source").alias("to")))
    found = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    front = found
    for depth in range(1, hops + 1):
        # Repeated edges go with the repeated nodes after the join, so edges are not moved while the front is small.
        step = both.join(small(front.select("start", "node")), "node").select("start", F.col("to").alias("node")).distinct().join(found.select("start", "node"), ["start", "node"], "left_anti")
        front = step.withColumn("depth", F.lit(depth))
        front = materialise(front, "front") if depth < hops else front
        found = found.unionByName(front)
    return found.where("depth > 0")


def fuzzy_match(nodes: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """query_id, entity, name, score, rank: equal names 1, one inside the other 0.8, else Jaccard of words above 0.3; first nodes first on ties."""
    # Words are parted once a row, not once a pair.
    parted = lambda df, c, w: df.withColumn(w, F.array_distinct(T.words(F.col(c))))
    met = meet(parted(queries.select("query_id", "entity", F.lower(T.strip(F.col("entity"))).alias("q")), "q", "qw"), parted(nodes.select("name", "ord", F.lower("name").alias("n")), "n", "nw"))
    jaccard = F.size(F.array_intersect("qw", "nw")) / F.size(F.array_union("qw", "nw"))
    score = F.when(F.col("n") == F.col("q"), 1.0).when(F.col("n").contains(F.col("q")) | F.col("q").contains(F.col("n")), 0.8).when(jaccard > 0.3, jaccard)
    w = Window.partitionBy("query_id", "entity").orderBy(F.desc("score"), "ord")
    return met.withColumn("score", score).where("score is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "entity", "name", "score", "rank")


def graph_walk(near: DataFrame, mentions: DataFrame) -> DataFrame:
    """start, chunk_id, score, node, depth: the chunks of each neighbour; the start's own are not among them. mentions (chunk_id, entity)."""
    return near.join(mentions.withColumnRenamed("entity", "node"), "node").select("start", "chunk_id", S.hop_score(F.col("depth")).alias("score"), "node", "depth")


def edge_context(nodes: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """start, num_edges, text: a description of an entity and of its out- and in-edges, in edge order; none without edges. entities (start)."""
    line = F.format_string("%s --[%s]--> %s: %s (confidence: %.2f)", "source", F.coalesce("relation_type", F.lit("RELATES_TO")), "target", F.coalesce("description", F.lit("")), F.coalesce("confidence", F.lit(0.5)))
    named = small(entities.distinct())
    lines = [edges.join(named.withColumnRenamed("start", end), end).select(F.col(end).alias("start"), F.lit(i).alias("side"), "ord", line.alias("line")) for i, end in enumerate(("source", "target"))]
    own = lines[0].unionByName(lines[1]).groupBy("start").agg(F.array_sort(F.collect_list(F.struct("side", "ord", "line"))).alias("l"))
    head = nodes.select(F.col("name").alias("start"), F.format_string("Entity: %s (%s)\nDescription: %s\nRelationships:\n", "name", F.coalesce("entity_type", F.lit("unknown")), F.coalesce("description", F.lit(""))).alias("head"))
    return own.join(head, "start").select("start", F.size("l").alias("num_edges"), F.concat("head", F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, community: connected components; nodes without edges stand alone; fewer than two nodes have none."""
    parts = connected_components(edges.select(F.col("source").alias("a"), F.col("target").alias("b"))).withColumnRenamed("node", "name")
    return nodes.select("name").join(parts, "name", "left").select("name", F.coalesce("component", "name").alias("community"))


def label_propagation(nodes: DataFrame, edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """name, community by label propagation: each node takes the label of most weight around it (its own included), the smaller on ties.

    Rounds go on until no label changes; where two states follow each other in turn, each node has the smaller of its two labels.
    Labels are written out after each round; sums are partial before the shuffle, so a hub's edges never meet in one task.
    """
    sides = [edges.select(F.col(a).alias("name"), F.col(b).alias("to"), F.coalesce("confidence", F.lit(0.5)).alias("w")) for a, b in (("source", "target"), ("target", "source"))]
    both = materialise(sides[0].unionByName(sides[1]).where("name <> to"), "both-ways")
    labels = materialise(nodes.select("name", F.col("name").alias("community")), "labels")
    mark = lambda df: tuple(df.agg(F.sum(F.xxhash64("name", "community") % 1_000_003), F.bit_xor(F.xxhash64("name", "community"))).first())
    before, seen = None, [mark(labels)]
    for _ in range(most_rounds):
        votes = both.join(labels.withColumnRenamed("name", "to"), "to").select("name", "community", "w").unionByName(labels.withColumn("w", F.lit(0.5)))
        sums = votes.groupBy("name", "community").agg(F.round(F.sum("w"), 9).alias("w"))
        best = sums.groupBy("name").agg(F.max("w").alias("w")).join(sums, ["name", "w"]).groupBy("name").agg(F.min("community").alias("community"))
        before, labels = labels, materialise(best, "labels")
        seen.append(mark(labels))
        if seen[-1] == seen[-2]:
            return labels
        if len(seen) > 2 and seen[-1] == seen[-3]:
            other = before.select("name", F.col("community").alias("other"))
            return labels.join(other, "name").select("name", F.least("community", "other").alias("community"))
    raise RuntimeError("labels did not settle")


def community_context(members: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, most_entities: int = 20, most_edges: int = 20, most_chunks: int = 5) -> DataFrame:
    """community, size, entities, relationships, chunks: the bounded context from which a community is summarised; two members at least.

    The windows cut each community to its first rows before anything is collected into a list.
    """
    first = lambda df, n, *order: df.withColumn("__n", F.row_number().over(Window.partitionBy("community").orderBy(*order))).where(F.col("__n") <= n)
    listed = lambda df, c, name: df.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", c))), lambda x: x[c]), "\n").alias(name))
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    described = members.join(nodes, "name").withColumn("line", F.format_string("- %s (%s): %s", "name", F.coalesce("entity_type", F.lit("unknown")), F.coalesce("description", F.lit("no description"))))
    inside = edges.join(members.select(F.col("name").alias("source"), "community"), "source").join(members.select(F.col("name").alias("target"), F.col("community").alias("other")), "target").where("community = other")
    inside = inside.withColumn("line", F.format_string("- %s --[%s]--> %s: %s", "source", "relation_type", "target", F.coalesce("description", F.lit(""))))
    told = members.join(nodes.select("name", F.explode(F.slice("source_chunks", 1, 3)).alias("chunk_id")), "name").select("community", "chunk_id").distinct().join(chunks.select("chunk_id", F.substring("text", 1, 500).alias("text")), "chunk_id")
    out = sizes.join(listed(first(described, most_entities, "name"), "line", "entities"), "community", "left")
    out = out.join(listed(first(inside, most_edges, "ord"), "line", "relationships"), "community", "left")
    return out.join(listed(first(told, most_chunks, "chunk_id"), "text", "chunks"), "community", "left").na.fill("", ["entities", "relationships", "chunks"])


def graph_channel(entities: DataFrame, nodes: DataFrame, edges: DataFrame, summaries: DataFrame, chunks: DataFrame, k: int | None = None, settings=DEFAULTS) -> DataFrame:
    """query_id, doc_id, score, rank, text, source_type of the graph channel for query entities (query_id, entity).

    summaries (name, community, summary), chunks (chunk_id, text). Matched entities bring their neighbours' chunks, their
    community's summary (0.85) and their edges' description (0.75); the best sighting of each document or text stays.
    """
    matched = materialise(fuzzy_match(nodes, entities), "matched").select("query_id", F.col("name").alias("start")).distinct()
    starts = matched.select("start").distinct()
    # Texts of chunks follow the cut: until then a hit is its ids and its score.
    mentions = chunk_entities(nodes).join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    near = neighbours(edges, starts, settings.graph_max_hops, settings.graph_min_confidence)
    cols = ["start", "doc_id", "source_type", "key", "score"]
    walk = graph_walk(near, mentions).select("start", F.col("chunk_id").alias("doc_id"), F.lit("graph_walk").alias("source_type"), F.col("chunk_id").alias("key"), "score")
    named = small(starts)
    told = summaries.where("summary <> ''").withColumnRenamed("name", "start").join(named, "start").select("start", F.concat(F.lit("community_"), F.col("community")).alias("doc_id"), F.lit("community_summary").alias("source_type"), F.lit(0.85).alias("score"), F.col("summary").alias("text"))
    context = edge_context(nodes, edges, starts).select("start", F.concat(F.lit("entity_"), F.col("start")).alias("doc_id"), F.lit("entity_context").alias("source_type"), F.lit(0.75).alias("score"), "text")
    written = materialise(told.unionByName(context).withColumn("key", F.substring("text", 1, 100)), "written")
    hits = walk.unionByName(written.select(cols)).join(small(matched), "start")
    best = hits.groupBy("query_id", "key").agg(F.max_by(F.struct(*cols[:3], "score"), F.struct("score", "doc_id")).alias("h")).select("query_id", "key", "h.*")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    top = materialise(best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= (k or settings.graph_top_k)), "ranked")
    walked = F.col("source_type") == "graph_walk"
    asked = small(top.where(walked).select(F.col("doc_id").alias("chunk_id")).distinct(), 100_000)
    texts = chunks.select("chunk_id", "text").join(asked, "chunk_id", "left_semi").groupBy(F.col("chunk_id").alias("doc_id")).agg(F.max("text").alias("text"))
    own = top.where(~walked).join(written.groupBy(cols[:4]).agg(F.max("text").alias("text")), cols[:4])
    return top.where(walked).join(texts, "doc_id").unionByName(own, allowMissingColumns=True).select("query_id", "doc_id", "score", "rank", "text", "source_type")
