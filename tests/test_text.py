import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators.chunking import chunk_documents


def chunks(spark, text, source="unknown", size=50, overlap=10):
    df = spark.createDataFrame([(source, text)], "source string, text string")
    return sorted(chunk_documents(df, size, overlap).collect(), key=lambda r: r.chunk_index)


def test_empty_text(spark):
    assert chunks(spark, "") == chunks(spark, None) == chunks(spark, " \n\t ") == []


def test_single_sentence(spark):
    (c,) = chunks(spark, "This is a short sentence.", "test.txt")
    assert (c.text, c.source, c.total_chunks, c.token_count, c.document_type) == ("This is a short sentence.", "test.txt", 1, 5, "plaintext")


def test_multiple_chunks(spark):
    assert len(chunks(spark, " ".join(f"This is sentence number {i}." for i in range(100)), "test.md")) > 1


def test_chunk_ids_are_unique(spark):
    ids = [c.chunk_id for c in chunks(spark, " ".join(f"Sentence {i}." for i in range(50)), "test.txt", 20, 4)]
    assert len(ids) == len(set(ids)) > 1


def test_document_type(spark):
    assert chunks(spark, "# Header\n\nSome content here.", "doc.md")[0].document_type == "markdown"


def test_section_headers(spark):
    found = chunks(spark, "# Introduction\n\nFirst paragraph.\n\n# Methods\n\nSecond paragraph.", "paper.md", 6, 0)
    assert [c.section_header for c in found] == ["Introduction", "Methods"]


def model(text, size, overlap):
    """The chunk texts, sentence by sentence."""
    text, out, current = text.strip(), [], []
    count = lambda s: len(s.split())
    for s in [x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z])|(?<=[.!?])\s*\n", text) if x.strip()]:
        n = count(s)
        if n > size:
            if current:
                out.append(" ".join(current))
            current = []
            w = s.split()
            out += [" ".join(w[i : i + size]) for i in range(0, n, size)]
            continue
        if sum(map(count, current)) + n > size:
            out.append(" ".join(current))
            keep = []
            for x in reversed(current):
                if sum(map(count, keep)) + count(x) > overlap:
                    break
                keep.insert(0, x)
            current = keep
        current.append(s)
    return out + [" ".join(current)] if current else out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(1, 14), max_size=12), min_size=1, max_size=8), st.integers(1, 12), st.integers(0, 6))
def test_chunks_against_a_model(spark, docs, size, overlap):
    texts = [" ".join("W" + " w" * (n - 1) + ("." if n % 3 else ".\n") for n in lengths) for lengths in docs]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source string, text string")
    got: dict = {}
    for r in sorted(chunk_documents(df, size, overlap).collect(), key=lambda r: r.chunk_index):
        got.setdefault(int(r.source), []).append(r.text)
    assert {i: m for i, t in enumerate(texts) if (m := model(t, size, overlap))} == got


def test_spans(spark):
    df = spark.createDataFrame([("a12b345",), ("",), ("99",), ("none",)], "t string").select(F.transform(T.spans(F.col("t"), r"\d+"), lambda s: F.concat_ws(":", s["start"], s["end"], s["text"])).alias("s"))
    assert [r.s for r in df.collect()] == [["1:3:12", "4:7:345"], [], ["0:2:99"], []]


def test_section_at_before_the_first_header(spark):
    df = spark.createDataFrame([("text\n# One\nx",)], "t string").select(T.section_at(T.headers(F.col("t")), F.lit(2)).alias("a"), T.section_at(T.headers(F.col("t")), F.lit(5)).alias("b"))
    assert tuple(df.first()) == (None, "One")
