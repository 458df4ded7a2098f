import random

import pytest

#: Column names that the operators use inside, to clash with.
EXTRA = "row string, band long, n int, found string, component long, score double, text_key string, rep long, kept boolean"


def extra(i):
    return (f"r{i}", i, i, "x", 7, 0.5, "k", -1, True)


@pytest.fixture(scope="session")
def edge_rows():
    """Null ids and texts, empty and blank texts, ties, repeated rows, a very long text."""
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Ünder", "naïve", "x1", "42", "don't", "a.b", "<|x|>", "日本語"]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    long = some(60_000)
    twice = some(50)
    rows = [(1, some(30)), (2, None), (3, ""), (4, " \t\n "), (5, twice), (5, twice), (6, twice), (None, twice), (None, None), (7, long), (8, long + " end"), (9, "!!! 123 ???"), (10, "one"), (11, "two words")]
    return rows


@pytest.fixture(scope="session")
def edge_documents(spark, edge_rows):
    return spark.createDataFrame([(*row, "en", *extra(i)) for i, row in enumerate(edge_rows)], f"doc_id long, text string, lang string, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def no_documents(edge_documents):
    return edge_documents.where("false")
