"""Operator 4: held-out accuracy and defined results."""

import math
import random
import zlib

import numpy as np

from loomspark.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)


def test_edge_rows(edge_documents, edge_rows, no_documents):
    model = language.fit(edge_documents.where(~language.held_out()))
    got = language.identify(edge_documents, model).collect()
    assert len(got) == len(edge_rows)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (2, 3, 4)} == dict.fromkeys((2, 3, 4), ("und", 0.0))
    assert all(not r.held_out for r in got if r.doc_id is None)
    assert {r.lang_pred for r in got if r.doc_id in (1, 7)} == {"en"}
    assert language.fit(no_documents) is None
    assert language.identify(no_documents, None).count() == 0
    assert {r.lang_pred for r in language.identify(edge_documents, None).collect()} == {"und"}
    kept = language.accepted(edge_documents, model)
    assert kept.columns == edge_documents.columns
    assert {r.doc_id for r in kept.collect()} == {1, 5, 6, 7, 8, 10, 11, None}


def test_three_families(spark):
    text = {"en": "the cat and the dog went with this", "de": "der hund und die katze gehen nicht", "fr": "le chat est avec les chiens dans une", "ru": "кот и собака пошли вместе"}
    rows = [(i, f"{t} {' '.join(t.split()[::-1])}", lang) for i, (lang, t) in enumerate(x for x in text.items() for _ in range(6))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert model.families == ["germanic", "romance", "slavic"]
    assert all(r.lang_pred == rows[r.doc_id][2] for r in language.identify(df, model).collect())


def test_predictions_against_a_plain_version():
    """Features, margins, votes and scores worked out one by one."""
    r = random.Random(4)
    words = {"en": "the and was with this from they have", "de": "und der nicht mit sich auf für eine", "nl": "het een van niet met zijn voor maar", "fr": "les des une pour dans avec est être", "es": "los las una para con está por más"}
    texts = [(lang, " ".join(r.choices(w.split(), k=r.randint(4, 25)))) for lang, w in words.items() for _ in range(12)]
    model = language.Model(np.array([language.vector(t) for _, t in texts]), [lang for lang, _ in texts])

    def plain(text):
        data = [b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode()]
        data = [b for i, b in enumerate(data) if not (b == 32 and i and data[i - 1] == 32)]
        data = [32, *data, 32]
        count = [0] * language.DIM
        for i in range(len(data) - 1):
            count[((data[i] << 8 | data[i + 1]) + 0x1000000) * 0x9E3779B1 % 2**32 >> 20] += 1
            if i + 2 < len(data):
                count[(data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 0x9E3779B1 % 2**32 >> 20] += 1
        norm = math.sqrt(sum(count))
        margins = [sum(float(w) * math.sqrt(c) / norm for w, c in zip(row, count, strict=False) if c) + float(row[-1]) for row in model.weights]
        own = dict(zip(model.families, margins, strict=False))
        family = max(model.families, key=lambda f: own[f])
        at = len(model.families)
        for f in model.families:
            pairs = [(a, b) for i, a in enumerate(model.langs[f]) for b in model.langs[f][i + 1 :]]
            if f == family:
                told = dict(zip(pairs, margins[at:], strict=False))
            at += len(pairs)
        votes = {x: (sum((v > 0) if x == a else (v <= 0) for (a, b), v in told.items() if x in (a, b)), sum(v if x == a else -v for (a, b), v in told.items() if x in (a, b))) for x in model.langs[family]}
        best = max(model.langs[family], key=lambda x: votes[x])
        return best, 1 / (1 + math.exp(-4 * min([own[family], *(v if best == a else -v for (a, b), v in told.items() if best in (a, b))])))

    mixed = [t for _, t in texts] + [f"{a} {b}" for (_, a), (_, b) in zip(texts, texts[17:], strict=False)] + ["Ünïcode ß 42 !!", "x"]
    got = model.predict(np.array([language.vector(t) for t in mixed]))
    for text, (lang, score) in zip(mixed, got, strict=True):
        want, certain = plain(text)
        assert lang == want
        assert abs(score - certain) < 1e-4


def test_many_rows_of_one_id_and_many_labels(spark):
    rows = [(1, f"the cat and the dog number {'abcdefghij'[i % 10] * 3}", "en") for i in range(3000)] + [(i, "der hund und die katze", "de") for i in range(2, 40)] + [(100 + i, "abc def", f"x{i:03}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.fit(df, per_language=20, most_rows=200, most_languages=10)
    assert sum(len(v) for v in model.langs.values()) == 10
    assert {"en", "de"} <= {x for v in model.langs.values() for x in v}
