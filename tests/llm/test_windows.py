"""Operator 5: against brute force and its SQL."""

import hashlib
import random
import re

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import decontaminate

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return _WORD.findall((text or "").translate(_LOWER))


def brute(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes, out = {len(w) for w in wins}, []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    ids |= found
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.integers(1, 8))
def test_every_window_keeps_its_smallest_hash(values, w):
    h = np.array(values, np.uint64)
    assert decontaminate.winnowed(h, w).tolist() == [max(j for j in range(i, i + w) if values[j] == min(values[i : i + w])) for i in range(len(values) - w + 1)]


def test_against_brute_force(spark, edge_rows, no_documents, edge_documents):
    r = random.Random(4)
    word = lambda: r.choice(["aa", "Bb", "cc", "d1", "é", "ff", "gg"])
    some = lambda n: r.choice([" ", ", "]).join(word() for _ in range(n))
    items = [(i, some(r.randint(0, 25))) for i in range(30)] + [(100, None), (101, ""), (102, "one"), (103, "two words"), (None, "gamma delta"), (7, "aa aa"), (7, "aa aa")]
    docs = [*edge_rows, *[(100 + i, some(r.randint(0, 60)) + " " + items[i % 30][1] + " " + some(5)) for i in range(60)], (300, "z " * 20), (301, (items[0][1] + " ") * 500)]
    d = spark.createDataFrame([(*x, i, "n") for i, x in enumerate(docs)], "doc_id long, text string, n int, fp string").repartition(3)
    b = spark.createDataFrame([(*x, "w") for x in items], "item_id long, text string, words string").repartition(2)
    got = sorted((tuple(r) for r in decontaminate.contaminated(d, b).drop("text_key").collect()), key=str)
    assert got == brute(docs, items)
    assert decontaminate.contaminated(no_documents, b).count() == 0
    assert decontaminate.contaminated(edge_documents, b.where("false")).where("contaminated").count() == 0


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = decontaminate.op5_winnowing(spark, "/root/testdata/sf0.001").select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(tuple(r) for r in got) == sorted(con.execute(decontaminate.SQL).fetchall())
