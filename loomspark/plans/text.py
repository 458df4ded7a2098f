"""Queries on text: scans, identifiers, sentences, headers, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.chunking import chunk_documents as chunks_of
from ..session import spread, table
from .registry import query

PATHS = ["notes/a.md", "b.TXT", "c.tar.pdf", "d.html", "e.json", "f.py", "g.js", "h.ts", "i.csv", "dir.md/none", "j.unknown", ".md", "x/.md", "", "k.Md"]
_VALUES = ", ".join(f"('{p}')" for p in PATHS)


@query(f"""
WITH p AS (SELECT url AS path FROM pages UNION ALL SELECT path FROM (VALUES {_VALUES}) AS v(path)),
s AS (SELECT path, lower(regexp_extract(path, '[^/.][^/]*?(\\.[^/.]+)$', 1)) AS e FROM p)
SELECT path, CASE e WHEN '.md' THEN 'markdown' WHEN '.txt' THEN 'plaintext' WHEN '.pdf' THEN 'pdf' WHEN '.html' THEN 'html' WHEN '.json' THEN 'json'
  WHEN '.py' THEN 'code' WHEN '.js' THEN 'code' WHEN '.ts' THEN 'code' ELSE 'plaintext' END AS document_type FROM s""")
def doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "pages").select(F.col("url").alias("path")).unionByName(spark.createDataFrame([(p,) for p in PATHS], "path string"))
    return paths.select("path", T.document_type(F.col("path")).alias("document_type"))


@query(r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS n_tokens FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


@query("SELECT doc_id, i AS chunk_index, sha256(CAST(doc_id AS VARCHAR) || '::' || CAST(i AS VARCHAR))[1:16] AS chunk_id FROM documents, (VALUES (0), (1), (17)) AS v(i)")
def chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(17))).alias("chunk_index"))
    return d.withColumn("chunk_id", T.chunk_id(F.col("doc_id").cast("string"), F.col("chunk_index")))


def marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (doc_id, source, text), with section headers about their texts."""
    d = spread(table(spark, sf_dir, "documents"))
    text = F.concat(F.lit("# From "), F.coalesce("source", F.lit("-")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n##  Language \nIt is "), F.coalesce("lang", F.lit("-")), F.lit(".\n#no header\n##### nor this\n#### End\nDone."))
    return d.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), text.alias("text"))


MARKED = r"""d AS (SELECT doc_id, regexp_replace('# From ' || coalesce(source, '-') || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '##  Language ' || chr(10) || 'It is ' || coalesce(lang, '-')
  || '.' || chr(10) || '#no header' || chr(10) || '##### nor this' || chr(10) || '#### End' || chr(10) || 'Done.', '^\s+|\s+$', '', 'g') AS t FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d),
placed AS (SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM lines),
heads AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, regexp_replace(regexp_replace(line, '^#{1,4}\s+', ''), '^\s+|\s+$', '', 'g') AS title FROM placed WHERE regexp_matches(line, '^#{1,4}\s+.+$'))"""


@query(f"WITH {MARKED} SELECT doc_id, pos, title FROM heads")
def section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_up(spark, sf_dir).select("doc_id", F.explode(T.headers(T.strip(F.col("text")))).alias("h")).select("doc_id", "h.pos", "h.title")


@query(rf"""WITH {MARKED},
probes AS (SELECT doc_id, unnest([0, 7, length(t) // 2, length(t)]) AS position, unnest([0, 1, 2, 3]) AS probe FROM d)
SELECT probes.doc_id, probe, arg_max(title, pos) AS section FROM probes LEFT JOIN heads ON heads.doc_id = probes.doc_id AND pos <= position GROUP BY probes.doc_id, probe""")
def section_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = marked_up(spark, sf_dir).withColumn("t", T.strip(F.col("text"))).withColumn("heads", T.headers(F.col("t")))
    d = d.select("doc_id", "heads", F.posexplode(F.array(F.lit(0), F.lit(7), F.floor(F.length("t") / 2).cast("int"), F.length("t"))).alias("probe", "position"))
    return d.select("doc_id", "probe", T.section_at(F.col("heads"), F.col("position")).alias("section"))


_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])(?:\s+([A-Z])|\s*\n)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""


@query(
    "WITH s AS (SELECT doc_id, "
    + _SENTENCES.format(t=r"regexp_replace(text, '^\s+|\s+$', '', 'g')")
    + " AS s FROM documents) SELECT doc_id, CAST(unnest(range(0, len(s))) AS INTEGER) AS n, unnest(s) AS sentence FROM s"
)
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))


SIZE, OVERLAP = 100, 20
_WORDS = r"list_filter(string_split_regex({t}, '\s+'), lambda w: w <> '')"


@query(f"""WITH RECURSIVE {MARKED},
ss AS (SELECT doc_id, {_SENTENCES.format(t="t")} AS sents FROM d),
s AS (SELECT doc_id, sents, len(sents) AS n, list_transform(sents, lambda x: CAST(len({_WORDS.format(t="x")}) AS INTEGER)) AS toks FROM ss),
r AS (
  SELECT doc_id, 0 AS i, 0 AS st, CAST([] AS INTEGER[]) AS win, CAST(0 AS BIGINT) AS cur, CAST(0 AS BIGINT) AS pos, CAST([] AS STRUCT(a INTEGER, b INTEGER, piece INTEGER, pos BIGINT)[]) AS out FROM s
  UNION ALL
  SELECT doc_id, i + 1,
    CASE WHEN t > {SIZE} THEN i + 1 WHEN cur + t > {SIZE} THEN i - kept ELSE st END,
    CASE WHEN t > {SIZE} THEN CAST([] AS INTEGER[]) WHEN cur + t > {SIZE} THEN list_concat(win[len(win) - kept + 1 : len(win)], [t]) ELSE list_concat(win, [t]) END,
    CASE WHEN t > {SIZE} THEN 0 WHEN cur + t > {SIZE} THEN coalesce(list_sum(win[len(win) - kept + 1 : len(win)]), 0) + t ELSE cur + t END,
    pos + l + CASE WHEN t > {SIZE} THEN 0 ELSE 1 END,
    CASE WHEN t > {SIZE} THEN list_concat(list_concat(out, CASE WHEN len(win) > 0 THEN [struct_pack(a := st, b := i, piece := -1, pos := pos)] ELSE [] END),
        list_transform(range(0, CAST(ceil(t / {SIZE}.0) AS BIGINT)), lambda p: struct_pack(a := i, b := i + 1, piece := CAST(p AS INTEGER), pos := pos)))
      WHEN cur + t > {SIZE} THEN list_concat(out, [struct_pack(a := st, b := i, piece := -1, pos := pos)]) ELSE out END
  FROM (SELECT r.*, s.toks[i + 1] AS t, length(s.sents[i + 1]) AS l,
      CAST(list_max(list_filter(range(0, len(win) + 1), lambda k: coalesce(list_sum(win[len(win) - k + 1 : len(win)]), 0) <= {OVERLAP})) AS INTEGER) AS kept
    FROM r JOIN s USING (doc_id) WHERE i < s.n)),
done AS (
  SELECT s.doc_id, sents, CASE WHEN len(win) > 0 THEN list_concat(out, [struct_pack(a := st, b := CAST(n AS INTEGER), piece := -1, pos := pos)]) ELSE out END AS out FROM r JOIN s ON r.doc_id = s.doc_id AND r.i = s.n),
c AS (SELECT doc_id, sents, len(out) AS total, unnest(out) AS x, unnest(range(0, len(out))) AS k FROM done),
texts AS (
  SELECT doc_id, total, k, x, CASE WHEN x.piece < 0 THEN array_to_string(sents[x.a + 1 : x.b], ' ') ELSE array_to_string(({_WORDS.format(t="sents[x.b]")})[x.piece * {SIZE} + 1 : (x.piece + 1) * {SIZE}], ' ') END AS text FROM c),
sect AS (SELECT t.doc_id, k, arg_max(title, h.pos) AS section_header FROM texts t LEFT JOIN heads h ON h.doc_id = t.doc_id AND h.pos <= t.x.pos GROUP BY t.doc_id, k)
SELECT CAST(doc_id AS VARCHAR) || '.md' AS source, CAST(k AS INTEGER) AS chunk_index, sha256(CAST(doc_id AS VARCHAR) || '.md::' || CAST(k AS VARCHAR))[1:16] AS chunk_id, text,
  CAST(len({_WORDS.format(t="text")}) AS INTEGER) AS token_count, section_header, 'markdown' AS document_type, CAST(total AS INTEGER) AS total_chunks
FROM texts JOIN sect USING (doc_id, k)""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of(marked_up(spark, sf_dir), SIZE, OVERLAP)
