"""Operator 7: against brute force over all pairs."""

import random
import re

import pytest

from loomspark.llm import neardup

COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]
_LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, k, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    link = list(range(len(rows)))

    def root(i):
        while link[i] != i:
            i = link[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                if x != y:
                    x, y = sorted((x, y), key=lambda z: rows[z][0])
                    link[y] = x
    out = []
    for i, (doc, _) in enumerate(rows):
        c = rows[root(i)][0] if doc is not None else None
        out.append((doc, len(sets[i]), c, doc is None or doc == c))
    return sorted(out, key=str)


def corpus(seed, edge_rows):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    rows, doc = [*edge_rows, (5, "another text of the same id, of eleven words in all")], 100
    for _ in range(12):
        base = [word() for _ in range(r.choice([3, 8, 30, 90]))]
        for _ in range(r.randint(1, 12)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                copy[r.randrange(len(copy))] = word()
            rows.append((doc, " ".join(copy)))
            doc += 1
            base = copy if r.random() < 0.3 else base  # chains
    return rows


@pytest.mark.parametrize(("k", "similarity", "seed", "few"), [(3, 0.85, 1, 16), (5, 0.8, 2, 16), (3, 0.85, 3, 1), (5, 0.8, 4, 2)])
def test_against_brute_force(spark, edge_rows, k, similarity, seed, few):
    rows = corpus(seed, edge_rows)
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "doc_id long, text string, band int, component int, a int").repartition(4)
    got = sorted((tuple(r) for r in neardup.near_duplicates(df, k=k, similarity=similarity, few=few).select(COLUMNS).collect()), key=str)
    assert got == brute(rows, k, round(100 * similarity))


def test_a_large_group_of_near_copies_with_words_of_their_own(spark):
    r = random.Random(9)
    base = [f"b{i}" for i in range(40)]
    rows = [(i, " ".join([*base[: r.randint(34, 40)], *(f"own{i}-{j}" for j in range(r.randint(0, 3)))])) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in neardup.near_duplicates(df, k=3, similarity=0.85).select(COLUMNS).collect()), key=str)
    assert got == brute(rows, 3, 85)


def test_no_documents(no_documents):
    assert neardup.near_duplicates(no_documents).count() == 0


def test_links_are_united_without_rounds_of_shuffles(spark, edge_rows, monkeypatch):
    def rounds(edges):
        raise AssertionError("few links went through rounds of shuffles")

    rows = corpus(5, edge_rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(neardup, "connected_components", rounds)
    got = sorted((tuple(r) for r in neardup.near_duplicates(df, k=3, similarity=0.85, few=2).select(COLUMNS).collect()), key=str)
    assert got == brute(rows, 3, 85)


@pytest.mark.parametrize("at_once", [0, 30])
def test_more_links_than_are_united_at_once(spark, edge_rows, at_once):
    rows = corpus(6, edge_rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in neardup.near_duplicates(df, k=3, similarity=0.85, few=2, at_once=at_once).select(COLUMNS).collect()), key=str)
    assert got == brute(rows, 3, 85)
