"""Queries on the entity graph.

Nodes are regions, nations, suppliers, customers and parts; edges lead from nations to regions (PART_OF), from suppliers and
customers to nations (LOCATED_IN), and from suppliers to the parts they sold (USED_BY, confidence = mean quantity / 50).
A node's chunk is the document of its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..session import materialise, table
from .registry import query


def nodes(spark: SparkSession, sf_dir: str, parts: bool = True) -> DataFrame:
    def one(name, key, label, kind, base):
        about = F.concat(F.lit(f"A {kind.lower()} of number "), F.col(key).cast("string"))
        return table(spark, sf_dir, name).select(label.alias("name"), F.lit(kind).alias("entity_type"), about.alias("description"), F.array(F.col(key).cast("string")).alias("source_chunks"), (F.lit(base) + F.col(key)).cast("long").alias("ord"))

    out = one("region", "r_regionkey", F.col("r_name"), "REGION", 0).unionByName(one("nation", "n_nationkey", F.col("n_name"), "NATION", 1_000)).unionByName(one("supplier", "s_suppkey", F.col("s_name"), "SUPPLIER", 1_000_000))
    out = out.unionByName(one("customer", "c_custkey", F.col("c_name"), "CUSTOMER", 1_000_000_000))
    return out.unionByName(one("part", "p_partkey", F.concat(F.lit("Part#"), F.col("p_partkey").cast("string")), "PART", 1_000_000_000_000)) if parts else out


def edges(spark: SparkSession, sf_dir: str, parts: bool = True) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    rest = lambda kind, about, conf: [F.lit(kind).alias("relation_type"), F.lit(about).alias("description"), conf.alias("confidence"), F.lit(0).cast("long").alias("ord")]
    n = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    out = n.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"), *rest("PART_OF", "lies in", F.lit(1.0)))
    for name, key, label in (("supplier", "s_nationkey", "s_name"), ("customer", "c_nationkey", "c_name")):
        out = out.unionByName(t(name).join(n, F.col(key) == F.col("n_nationkey")).select(F.col(label).alias("source"), F.col("n_name").alias("target"), *rest("LOCATED_IN", "sits in", F.lit(1.0))))
    if parts:
        sold = t("lineitem").groupBy("l_suppkey", "l_partkey").agg((F.avg("l_quantity") / 50).alias("c"))
        s = t("supplier").select("s_suppkey", "s_name")
        out = out.unionByName(sold.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_name").alias("source"), F.concat(F.lit("Part#"), F.col("l_partkey").cast("string")).alias("target"), *rest("USED_BY", "sold", F.col("c"))))
    return out


GRAPH = """nodes AS (
  SELECT r_name AS name, 'REGION' AS entity_type, 'A region of number ' || r_regionkey AS description, CAST(r_regionkey AS VARCHAR) AS chunk, CAST(r_regionkey AS BIGINT) AS ord FROM region UNION ALL
  SELECT n_name, 'NATION', 'A nation of number ' || n_nationkey, CAST(n_nationkey AS VARCHAR), 1000 + n_nationkey FROM nation UNION ALL
  SELECT s_name, 'SUPPLIER', 'A supplier of number ' || s_suppkey, CAST(s_suppkey AS VARCHAR), 1000000 + s_suppkey FROM supplier UNION ALL
  SELECT c_name, 'CUSTOMER', 'A customer of number ' || c_custkey, CAST(c_custkey AS VARCHAR), 1000000000 + c_custkey FROM customer UNION ALL
  SELECT 'Part#' || p_partkey, 'PART', 'A part of number ' || p_partkey, CAST(p_partkey AS VARCHAR), 1000000000000 + p_partkey FROM part),
place AS (
  SELECT n_name AS source, r_name AS target, 'PART_OF' AS relation_type, 'lies in' AS description, 1.0::DOUBLE AS confidence FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
  SELECT s_name, n_name, 'LOCATED_IN', 'sits in', 1.0 FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL
  SELECT c_name, n_name, 'LOCATED_IN', 'sits in', 1.0 FROM customer JOIN nation ON c_nationkey = n_nationkey),
edges AS (
  SELECT * FROM place UNION ALL
  SELECT s_name, 'Part#' || l_partkey, 'USED_BY', 'sold', avg(l_quantity) / 50 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name, l_partkey)"""


@query(f"WITH {GRAPH} SELECT name, chunk AS chunk_id FROM nodes")
def chunk_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chunk_entities(nodes(spark, sf_dir)).select(F.col("entity").alias("name"), "chunk_id")


@query("""WITH raw AS (SELECT s_name AS source, 'Part#' || l_partkey AS target, l_returnflag AS relation_type, l_quantity / 50 AS confidence, l_orderkey * 10 + l_linenumber AS ord FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT source, target, arg_max(relation_type, (ord, relation_type, confidence)) AS relation_type, round(arg_max(confidence, (ord, relation_type, confidence)), 9) AS confidence, max(ord) AS ord FROM raw GROUP BY source, target""")
def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge a line item: the last of each ordered pair stays; some ends are written in lower case and so do not exist."""
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    raw = li.join(s.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    cols = [F.concat(F.lit("Part#"), F.col("l_partkey").cast("string")).alias("target"), F.col("l_returnflag").alias("relation_type"), (F.col("l_quantity") / 50).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")]
    rows = raw.select(F.col("s_name").alias("source"), *cols)
    absent = raw.select(F.lower("s_name").alias("source"), *cols)
    return G.build_edges(nodes(spark, sf_dir), rows.unionByName(absent)).withColumn("confidence", F.round("confidence", 9))


@query(f"""WITH {GRAPH}, both_ways AS (SELECT source AS a, target AS b FROM edges WHERE confidence >= 0.5 UNION SELECT target, source FROM edges WHERE confidence >= 0.5),
h0 AS (SELECT r_name AS start FROM region UNION ALL SELECT n_name FROM nation),
h1 AS (SELECT DISTINCT start, b AS node FROM h0 JOIN both_ways ON start = a WHERE b <> start),
h2 AS (SELECT DISTINCT start, b AS node FROM h1 JOIN both_ways ON node = a WHERE b <> start)
SELECT start, node, min(depth) AS depth FROM (SELECT *, 1 AS depth FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY start, node""")
def khop_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "region").select(F.col("r_name").alias("start")).unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("start")))
    return G.neighbours(edges(spark, sf_dir), starts)


@query("SELECT n_name AS name, 'NATION' AS entity_type FROM nation")
def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by name regardless of case: the nations' names in lower case."""
    asked = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("key"))
    return nodes(spark, sf_dir).withColumn("key", F.lower("name")).join(asked, "key").select("name", "entity_type")


@query("""WITH m AS (SELECT r_name AS r, r_name AS name FROM region UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT name, min(name) OVER (PARTITION BY r) AS community FROM m UNION ALL SELECT 'Part#' || p_partkey, 'Part#' || p_partkey FROM part""")
def communities_cc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components without the edges to parts: a community a region, and each part alone.

    All nodes take part. The twin leaves these edges out too; with them all nodes of the tables are one community.
    """
    return G.communities(nodes(spark, sf_dir), edges(spark, sf_dir, parts=False))


@query("SELECT n_name AS asked, r_name AS community, 'All about ' || r_name AS summary FROM nation JOIN region ON n_regionkey = r_regionkey")
def community_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The community and summary of nations, asked for in lower case; a community is called by its smallest name among regions and nations."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = r.select(F.col("r_name").alias("name")).unionByName(n.select(F.col("n_name").alias("name")))
    places = edges(spark, sf_dir).where("relation_type = 'PART_OF'")
    members = G.communities(names, places)
    summaries = members.join(r.select(F.col("r_name").alias("name")), "name").select("community", F.col("name").alias("region"), F.concat(F.lit("All about "), "name").alias("summary"))
    asked = n.select(F.lower("n_name").alias("key"), F.col("n_name").alias("asked"))
    return members.withColumn("key", F.lower("name")).join(asked, "key").join(summaries, "community").select("asked", F.col("region").alias("community"), "summary")


@query()
def communities_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.label_propagation(nodes(spark, sf_dir), edges(spark, sf_dir))


@query("""WITH e AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, p_type AS entity_type, p_brand AS description, CAST(p_partkey % 50 AS VARCHAR) AS chunk FROM part)
SELECT arg_min(name, ord) AS name, arg_min(entity_type, ord) AS entity_type, arg_max(description, (length(description), -ord)) AS description, string_agg(DISTINCT chunk, ',' ORDER BY chunk) AS chunks FROM e GROUP BY lower(name)""")
def dedupe_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_type").alias("entity_type"), F.col("p_brand").alias("description"), (F.col("p_partkey") % 50).cast("string").alias("chunk_id"))
    return G.dedupe_entities(rows).select("name", "entity_type", "description", F.array_join("source_chunks", ",").alias("chunks"))


@query("""WITH e AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS source, p_brand AS target, p_type AS kind, p_size / 50.0::DOUBLE AS confidence, 'no. ' || p_partkey AS description, CAST(p_partkey % 50 AS VARCHAR) AS chunk FROM part)
SELECT arg_min(source, ord) AS source, arg_min(target, ord) AS target, kind AS relation_type, max(confidence) AS confidence, arg_min(description, ord) AS description, string_agg(DISTINCT chunk, ',' ORDER BY chunk) AS chunks FROM e GROUP BY lower(source), kind, lower(target)""")
def dedupe_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = table(spark, sf_dir, "part"), F.col
    rows = p.select(
        c("p_partkey").alias("ord"), F.when(c("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(c("p_name")).alias("source"), c("p_brand").alias("target"), c("p_type").alias("relation_type"), (c("p_size") / 50).alias("confidence"),
        F.concat(F.lit("no. "), c("p_partkey").cast("string")).alias("description"), (c("p_partkey") % 50).cast("string").alias("chunk_id"),
    )
    return G.dedupe_edges(rows).select("source", "target", "relation_type", "confidence", "description", F.array_join("source_chunks", ",").alias("chunks"))


_NAMES = ["  spaced name ", "LOUD NAME", "ABCD", "ABCDE", "12345", "Mixed Case", "ÉLAN VITAL", "MIDDLE   EAST", "\tTABBED\n"]


@query(r"""WITH r AS (SELECT s_name AS raw FROM supplier UNION ALL SELECT upper(c_mktsegment || ' ' || c_name) FROM customer UNION ALL SELECT r_name FROM region UNION ALL SELECT * FROM (VALUES
  ('  spaced name '), ('LOUD NAME'), ('ABCD'), ('ABCDE'), ('12345'), ('Mixed Case'), ('ÉLAN VITAL'), ('MIDDLE   EAST'), (chr(9) || 'TABBED' || chr(10))) AS v(raw)),
n AS (SELECT raw, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS n FROM r)
SELECT raw, CASE WHEN upper(n) = n AND lower(n) <> n AND length(n) > 4 THEN array_to_string(list_transform(string_split(lower(n), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') ELSE n END AS name FROM n""")
def normalize_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    raw = t("supplier").select(F.col("s_name").alias("raw")).unionByName(t("customer").select(F.upper(F.concat_ws(" ", "c_mktsegment", "c_name")).alias("raw"))).unionByName(t("region").select(F.col("r_name").alias("raw")))
    return raw.unionByName(spark.createDataFrame([(x,) for x in _NAMES], "raw string")).select("raw", T.normalised_name(F.col("raw")).alias("name"))


@query("""SELECT 'entity' AS kind, CAST(p_partkey AS VARCHAR) AS chunk_id, p_name AS a, CASE WHEN p_size % 3 = 0 THEN 'CONCEPT' ELSE p_type END AS b, 0.0::DOUBLE AS confidence FROM part
UNION ALL SELECT 'edge', CAST(p_partkey AS VARCHAR), p_name, p_brand, CASE WHEN p_size % 4 = 0 THEN 0.7 ELSE least(1.0, p_size / 25.0::DOUBLE) END FROM part""")
def parse_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output in JSON, made from parts, some fields missing, and two outputs that are no JSON."""
    p, c = table(spark, sf_dir, "part"), F.col
    entity = F.struct(c("p_name").alias("name"), F.when(c("p_size") % 3 != 0, c("p_type")).alias("type"))
    edge = F.struct(c("p_name").alias("source"), c("p_brand").alias("target"), F.when(c("p_size") % 4 != 0, c("p_size") / 25).alias("confidence"))
    raw = p.select(c("p_partkey").cast("string").alias("chunk_id"), c("p_partkey").alias("ord"), F.to_json(F.struct(F.array(entity).alias("entities"), F.array(edge).alias("relationships"))).alias("json"))
    raw = raw.unionByName(spark.createDataFrame([("bad", -1, "no json {"), ("null", -2, None)], "chunk_id string, ord long, json string"))
    entities, rels = G.parse_extraction(raw)
    return entities.select(F.lit("entity").alias("kind"), "chunk_id", F.col("name").alias("a"), F.col("entity_type").alias("b"), F.lit(0.0).alias("confidence")).unionByName(rels.select(F.lit("edge").alias("kind"), "chunk_id", F.col("source").alias("a"), F.col("target").alias("b"), "confidence"))


@query()
def entity_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline extractor over whole documents: capitalised spans, joined by co-occurrence in a sentence."""
    from ..providers import CapitalisedExtractor

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("doc_id").alias("ord"))
    return G.dedupe_entities(CapitalisedExtractor().entities(docs)).select("name", "entity_type", F.size("source_chunks").alias("n_chunks"))


_ASKED = ["ring", "red", "small widget", "hot blue gear", "GIZMO", "big red thing now", "none of these", " Blue Bolt "]
_ASKED_SQL = ", ".join(f"('{a}')" for a in _ASKED)


@query(rf"""WITH n AS (SELECT p_name AS name, min(p_partkey) AS ord, lower(p_name) AS n FROM part GROUP BY p_name),
q AS (SELECT entity, regexp_replace(lower(entity), '^\s+|\s+$', '', 'g') AS q FROM (SELECT * FROM (VALUES {_ASKED_SQL}) AS v(entity) UNION ALL SELECT n_name FROM nation)),
x AS (SELECT *, list_distinct(string_split(q, ' ')) AS qw, list_distinct(string_split(n, ' ')) AS nw FROM q, n),
s AS (SELECT entity, name, ord, CASE WHEN n = q THEN 1.0 WHEN contains(n, q) OR contains(q, n) THEN 0.8 ELSE len(list_intersect(qw, nw)) / CAST(len(list_distinct(list_concat(qw, nw))) AS DOUBLE) END AS score FROM x)
SELECT entity, name, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, ord) AS rank FROM s WHERE score > 0.3) WHERE rank <= 3""")
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    asked = spark.createDataFrame([(x,) for x in _ASKED], "entity string").unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity")))
    return G.fuzzy_match(n, asked.withColumn("query_id", F.lit(1))).select("entity", "name", F.round("score", 9).alias("score"), "rank")


_NEAR = """both_ways AS (SELECT source AS a, target AS b FROM edges WHERE confidence >= 0.5 UNION SELECT target, source FROM edges WHERE confidence >= 0.5),
h1 AS (SELECT DISTINCT start, b AS node FROM starts JOIN both_ways ON start = a WHERE b <> start), h2 AS (SELECT DISTINCT start, b AS node FROM h1 JOIN both_ways ON node = a WHERE b <> start),
near AS (SELECT start, node, min(depth) AS depth FROM (SELECT *, 1 AS depth FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY start, node)"""


@query(f"""WITH {GRAPH}, starts AS (SELECT r_name AS start FROM region), {_NEAR}
SELECT start, node, chunk AS chunk_id, 1.0 / (1.0 + depth * 0.5) AS score FROM near JOIN nodes ON node = name""")
def graph_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "region").select(F.col("r_name").alias("start"))
    near = G.neighbours(edges(spark, sf_dir), starts)
    return G.graph_walk(near, G.chunk_entities(nodes(spark, sf_dir))).select("start", "node", "chunk_id", "score")


_CONTEXT = """lines AS (SELECT source AS start, 0 AS side, source || ' --[' || relation_type || ']--> ' || target || ': ' || description || ' (confidence: 1.00)' AS line FROM place
  UNION ALL SELECT target, 1, source || ' --[' || relation_type || ']--> ' || target || ': ' || description || ' (confidence: 1.00)' FROM place),
context AS (SELECT start, count(*) AS num_edges, 'Entity: ' || start || ' (' || any_value(entity_type) || ')' || chr(10) || 'Description: ' || any_value(description) || chr(10) || 'Relationships:' || chr(10) || string_agg(line, chr(10) ORDER BY side, line) AS text
  FROM starts JOIN lines USING (start) JOIN nodes ON start = name GROUP BY start)"""


@query(f"WITH {GRAPH}, starts AS (SELECT r_name AS start FROM region UNION ALL SELECT n_name FROM nation), {_CONTEXT} SELECT start, CAST(num_edges AS INTEGER) AS num_edges, text FROM context")
def entity_edge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "region").select(F.col("r_name").alias("start")).unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("start")))
    return G.edge_context(nodes(spark, sf_dir), edges(spark, sf_dir), starts)


@query(f"""WITH {GRAPH},
q AS (SELECT 'q' || r_regionkey AS query_id, lower(r_name) AS q FROM region UNION ALL SELECT 'n' || n_nationkey, lower(n_name) FROM nation),
low AS (SELECT name, ord, lower(name) AS n FROM nodes),
m AS (SELECT query_id, name AS start, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS r FROM
  (SELECT query_id, name, ord, CASE WHEN n = q THEN 1.0 WHEN contains(n, q) OR contains(q, n) THEN 0.8
    ELSE len(list_intersect(string_split(q, ' '), string_split(n, ' '))) / CAST(len(list_distinct(list_concat(string_split(q, ' '), string_split(n, ' ')))) AS DOUBLE) END AS score FROM q, low) WHERE score > 0.3),
matched AS (SELECT DISTINCT query_id, start FROM m WHERE r <= 3), starts AS (SELECT DISTINCT start FROM matched),
{_NEAR}, {_CONTEXT},
hits AS (
  SELECT start, chunk AS doc_id, max(1.0 / (1.0 + depth * 0.5)) AS score, any_value(d.text) AS text, 'graph_walk' AS source_type FROM near JOIN nodes ON node = name JOIN documents d ON CAST(d.doc_id AS VARCHAR) = chunk GROUP BY start, chunk
  UNION ALL SELECT r_name, 'community_' || r_name, 0.85, 'All about ' || r_name, 'community_summary' FROM region
  UNION ALL SELECT start, 'entity_' || start, 0.75, text, 'entity_context' FROM context),
best AS (SELECT query_id, unnest(arg_max(struct_pack(doc_id := doc_id, score := score, source_type := source_type), struct_pack(score := score, doc_id := doc_id)))
  FROM matched JOIN hits USING (start) GROUP BY query_id, CASE WHEN source_type = 'graph_walk' THEN doc_id ELSE left(text, 100) END)
SELECT query_id, doc_id, score, source_type, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM best) WHERE rank <= 15""")
def graph_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole channel for regions and nations asked by name, over the whole graph."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    asked = r.select(F.concat(F.lit("q"), "r_regionkey").alias("query_id"), F.lower("r_name").alias("entity")).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("query_id"), F.lower("n_name").alias("entity")))
    named = nodes(spark, sf_dir)
    told = r.select(F.col("r_name").alias("name"), F.col("r_name").alias("community"), F.concat(F.lit("All about "), "r_name").alias("summary"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    return G.graph_channel(asked, named, materialise(edges(spark, sf_dir), "edges"), told, chunks).select("query_id", "doc_id", "score", "source_type", "rank")


@query(f"""WITH {GRAPH}, members AS (SELECT r_name AS name, r_name AS community FROM region UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT s_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT community, name, '- ' || name || ' (' || entity_type || '): ' || description AS line, row_number() OVER (PARTITION BY community ORDER BY name) AS k FROM members JOIN nodes USING (name)),
i AS (SELECT a.community, '- ' || source || ' --[' || relation_type || ']--> ' || target || ': ' || description AS line FROM place JOIN members a ON a.name = source JOIN members b ON b.name = target AND a.community = b.community),
ir AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY line) AS k FROM i),
c AS (SELECT DISTINCT community, chunk FROM members JOIN nodes USING (name)),
cr AS (SELECT community, chunk, left(text, 500) AS t, row_number() OVER (PARTITION BY community ORDER BY chunk) AS k FROM c JOIN documents ON CAST(doc_id AS VARCHAR) = chunk)
SELECT community, count(*) AS size, (SELECT string_agg(line, chr(10) ORDER BY k) FROM e WHERE e.community = m.community AND k <= 20) AS entities,
  (SELECT string_agg(line, chr(10) ORDER BY k) FROM ir WHERE ir.community = m.community AND k <= 20) AS relationships,
  coalesce((SELECT string_agg(t, chr(10) ORDER BY k) FROM cr WHERE cr.community = m.community AND k <= 5), '') AS chunks FROM members m GROUP BY community HAVING count(*) >= 2""")
def community_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    members = t("region").select(F.col("r_name").alias("name"), F.col("r_name").alias("community")).unionByName(n.select(F.col("n_name").alias("name"), F.col("r_name").alias("community")))
    for name, key, label in (("supplier", "s_nationkey", "s_name"), ("customer", "c_nationkey", "c_name")):
        members = members.unionByName(t(name).join(n, F.col(key) == F.col("n_nationkey")).select(F.col(label).alias("name"), F.col("r_name").alias("community")))
    ordered = edges(spark, sf_dir).withColumn("ord", F.concat("source", F.lit(" --["), "relation_type", F.lit("]--> "), "target"))
    chunks = t("documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    return G.community_context(members, nodes(spark, sf_dir), ordered, chunks)


@query(f"""WITH {GRAPH},
q AS (SELECT 'r' || r_regionkey AS query_id, n_name AS entity FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || n_nationkey, lower(n_name) FROM nation),
size AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id),
have AS (SELECT s_name AS doc_id, s_name AS entity FROM supplier UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
s AS (SELECT size.query_id, doc_id, CASE WHEN d.entity IS NOT NULL THEN 0.15::DOUBLE ELSE 0.075::DOUBLE * n * (SELECT count(*) FROM place JOIN q ON q.query_id = size.query_id AND lower(q.entity) = lower(target) WHERE lower(source) = lower(have.entity)) END AS part
  FROM have, size LEFT JOIN q d ON d.query_id = size.query_id AND lower(d.entity) = lower(have.entity))
SELECT query_id, doc_id, round(least(sum(part), 0.45::DOUBLE), 6) AS coherence FROM s GROUP BY ALL""")
def graph_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their nation as results of queries for a region's nations and for one nation."""
    from ..operators.fusion import graph_coherence as coherence
    from ..operators.joins import meet

    t = lambda name: table(spark, sf_dir, name)
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    asked = n.select(F.concat(F.lit("r"), "r_regionkey").alias("query_id"), F.col("n_name").alias("entity")).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("query_id"), F.lower("n_name").alias("entity")))
    s = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    have = s.select(F.col("s_name").alias("doc_id"), F.explode(F.array("s_name", "n_name")).alias("entity"))
    results = meet(asked.select("query_id").distinct(), have)
    return coherence(results, asked, edges(spark, sf_dir)).withColumn("coherence", F.round("coherence", 6))
