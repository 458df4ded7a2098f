"""The pipeline: each stage on edge rows, and the whole against the operators' own results."""

import corpus_pipeline
from loomspark.llm import neardup

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_survive_edge_rows(spark, edge_documents, no_documents):
    docs = edge_documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.fieldNames() == edge_documents.schema.fieldNames(), name
        assert stage(spark, no_documents, SF).count() == 0
        docs = out
    kept = [r.doc_id for r in docs.select("doc_id").collect()]
    assert {1, 7, 10, 11} <= set(kept)
    assert kept.count(5) == 1
    assert 6 not in kept  # a copy of 5
    assert corpus_pipeline.pack_sequences(spark, no_documents, SF).count() == 0


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in rows}
    assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
    near = neardup.near_duplicates(docs).where("not kept").select("doc_id").collect()
    assert not ids & {r.doc_id for r in near}
    assert all(r.offset + r.length <= 2048 for r in rows)
