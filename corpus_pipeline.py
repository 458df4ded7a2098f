"""A corpus pipeline of five stages, each on all rows that the stage before it kept.

1. language ID: documents without a recognisable language go;
2. MinHash near-dedup: of each group of near duplicates the document with the smallest doc_id stays;
3. benchmark decontamination: documents that hold a window of a benchmark item go;
4. secret scans: every document stays, its secrets are masked and n_chars follows;
5. best-fit packing: the pieces of all documents with their sequence and offset.

Defined results: rows with a null doc_id are kept by stages 1 to 4 on the same terms as others, save that they are no one's
near duplicate; rows that share a doc_id are judged apart by their texts, of equal ones one stays; further columns are carried through stages 1 to 4.

Stages 2 and 3 take rows away by an anti-join on short keys. The keys are broadcast if there are few of them; beyond that the documents
are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm import decontaminate, language, neardup, packing, secretscan, tokens
from loomspark.operators.joins import small
from loomspark.session import importable, materialise, table

#: Keys that are broadcast at most.
KEYS = 200_000


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return language.accepted(docs, language.fit(docs))


def _unused(name: str, docs: DataFrame) -> str:
    """A column name that docs does not have."""
    return f"__{name}" + "_" * max((len(c) for c in docs.columns), default=0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    doc, text = _unused("doc", docs), _unused("text", docs)
    found = neardup.near_duplicates(docs).where("doc_id is not null")
    found = materialise(found.select(F.col("doc_id").alias(doc), F.col("text_key").alias(text), "part"), "near")
    # The first of each component stays: the smallest doc_id, and of that the text of the smallest hash.
    first = found.where("part is not null").groupBy("part").agg(F.min(F.struct(doc, text)).alias("first"))
    going = materialise(found.join(first, "part").where(F.struct(doc, text) != F.col("first")).select(doc, text).distinct(), "going")
    twice = materialise(found.groupBy(doc, text).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(doc, text), "twice")
    left = docs.withColumn(doc, F.col("doc_id")).withColumn(text, F.xxhash64("text")).join(small(going, KEYS), [doc, text], "left_anti")
    if twice.count():
        keys = small(twice, KEYS)
        left = left.join(keys, [doc, text], "left_anti").unionByName(left.join(keys, [doc, text], "left_semi").dropDuplicates([doc, text]))
    return left.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    bad = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("text_key").distinct()
    bad = materialise(bad, "contaminated")
    key = _unused("key", docs)
    return docs.withColumn(key, decontaminate.text_key()).join(small(bad.withColumnRenamed("text_key", key), KEYS), key, "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    out = docs.withColumn("text", secretscan.redacted(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return packing.pack(docs, tokens.word_vocabulary())


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]
#: The first stage learns from the data, which SQL cannot express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
