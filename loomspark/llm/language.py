"""Operator 4: language identification by hierarchical discrimination.

A text is a vector of hashed byte 2-grams and 3-grams of its lower-cased form (white space runs as one space, digits
and ASCII punctuation left out), as square roots of counts scaled to length one. Linear support vector machines, one
against the rest, choose the language family; within it machines for each pair of languages vote.

The machines are fitted on at most `per_language` labelled texts of each language and `most_rows` in all, those of the lowest
hash of doc_id, by dual coordinate descent; of more than `most_languages` labels the commonest are learned. The cut is made on the
executors, also where many rows share a doc_id. Only the vectors come to the driver (16 KB each, so 160 MB at most).

Defined results: a null text, or one without a letter, is `und` with score 0; documents without a lang are judged but not
learned from; a null doc_id counts as not held out and is not learned from; with no labelled text everything with a letter is `und`; repeated rows are judged
once each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

DIM = 4096
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb", "romance": "fr es it pt ro ca gl oc", "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv", "uralic": "fi et hu", "turkic": "tr az kk uz ky tk", "indic": "hi ur bn mr gu pa ne", "semitic": "ar he mt am", "celtic": "ga cy br gd",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.array([b >= 128 or 97 <= b <= 122 for b in range(256)])


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def vector(text: str | None) -> np.ndarray | None:
    """The features of a whole text; None without a letter."""
    if not text or not _LETTER.search(text):
        return None
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    data = np.where(_KEEP[data], data, np.uint8(32))
    spaces = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(spaces[1:] & spaces[:-1])
    data = np.concatenate([[32], data[keep], [32]]).astype(np.uint32)
    two = data[:-1] << np.uint32(8) | data[1:]
    three = two[:-1] << np.uint32(8) | data[2:]
    hashed = lambda x, salt: (((x + np.uint32(salt)) * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.intp)
    count = np.bincount(hashed(two, 0x1000000), minlength=DIM) + np.bincount(hashed(three, 0), minlength=DIM)
    out = np.sqrt(count).astype(np.float32)
    return out / np.float32(np.linalg.norm(out))


def fit_machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 15) -> np.ndarray:
    """Weights of a linear support vector machine (y of +1 and -1, bias last), squared hinge loss."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha = np.zeros(x.shape[1], np.float64), np.zeros(len(x))
    share = len(x) / (2.0 * np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum())))
    diagonal = 1.0 / (2.0 * c * share)
    norm = (x.astype(np.float64) ** 2).sum(1) + diagonal
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - g / norm[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w.astype(np.float32)


class Model:
    """Families, their languages, and the weights of all machines."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        names = np.array(langs)
        kin = np.array([family_of(v) for v in langs])
        self.families = sorted(set(kin.tolist()))
        self.langs = {f: sorted(set(names[kin == f].tolist())) for f in self.families}
        self.pairs = {f: list(combinations(range(len(v)), 2)) for f, v in self.langs.items()}
        rows = []
        if len(self.families) > 1:
            rows += [fit_machine(x, np.where(kin == f, 1.0, -1.0)) for f in self.families]
        for f in self.families:
            for i, j in self.pairs[f]:
                a, b = self.langs[f][i], self.langs[f][j]
                own = (names == a) | (names == b)
                rows.append(fit_machine(x[own], np.where(names[own] == a, 1.0, -1.0)))
        self.weights = np.array(rows, np.float32).reshape(len(rows), DIM + 1)

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        n = len(self.families) if len(self.families) > 1 else 0
        at = np.cumsum([n] + [len(self.pairs[f]) for f in self.families])
        out = []
        for m in margin:
            k = int(m[:n].argmax()) if n else 0
            f = self.families[k]
            score = float(m[k]) if n else 1.0
            votes = np.zeros((len(self.langs[f]), 2))
            own = m[at[k] : at[k + 1]]
            for (i, j), v in zip(self.pairs[f], own, strict=True):
                votes[i if v > 0 else j, 0] += 1
                votes[i, 1] += v
                votes[j, 1] -= v
            best = max(range(len(votes)), key=lambda i: (votes[i, 0], votes[i, 1], -i))
            for (i, j), v in zip(self.pairs[f], own, strict=True):
                if best in (i, j):
                    score = min(score, float(v) if best == i else -float(v))
            out.append((self.langs[f][best], float(1 / (1 + np.exp(-4 * score)))))
        return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(lang, order, v.tobytes()) for lang, order, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if (v := vector(t)) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["lang", "order", "x"])


def fit(labelled: DataFrame, per_language: int = 400, most_rows: int = 10_000, most_languages: int = 200) -> Model | None:
    """A model from (doc_id, text, lang), from at most per_language texts of each language and most_rows in all, of the most_languages commonest languages."""
    labelled = labelled.where("lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    # Of different ids: many rows of one would make the share too small.
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("doc_id").alias("ids"))
    sizes = {r[0]: r[1] for r in counts.orderBy(F.desc("n"), "lang").limit(most_languages).select("lang", "ids").collect()}
    if not sizes:
        return None
    per_language = max(1, min(per_language, most_rows // len(sizes)))
    share = {lang: min(1.0, 1.3 * per_language / n + 20 / n) for lang, n in sizes.items()}
    order = F.xxhash64("doc_id")
    limit = F.create_map(*[F.lit(v) for kv in share.items() for v in kv])[F.col("lang")]
    some = labelled.where(F.pmod(order, F.lit(1_000_000)) < limit * 1_000_000)
    found = some.select("lang", order.alias("order"), "text").mapInArrow(_features, "lang string, order long, x binary")
    first = Window.partitionBy("lang").orderBy(F.pmod("order", F.lit(1_000_000)), "order", "x")
    kept = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language).select("lang", "order", "x").collect()
    kept.sort(key=lambda r: (r[1] % 1_000_000, r[1], r[0], r[2]))
    return Model(np.array([np.frombuffer(r[2], np.float32) for r in kept]), [r[0] for r in kept]) if kept else None


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            for at in range(0, len(texts) if model else 0, 512):
                found = [(at + i, v) for i, t in enumerate(texts[at : at + 512]) if (v := vector(t)) is not None]
                if found:
                    for (i, _), (lang, s) in zip(found, model.predict(np.array([v for _, v in found])), strict=True):
                        pred[i], score[i] = lang, s
            rest = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*rest, "lang_pred", "score"])

    return run


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of documents (doc_id, text)."""
    return documents.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def _accepted(model: Model | None, at: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows if model else 0, 512):
                part = b.slice(start, 512)
                found = [vector(t) for t in part.column(at).to_pylist()]
                some = [v for v in found if v is not None]
                good = iter([s >= least for _, s in model.predict(np.array(some))] if some else [])
                yield part.filter(pa.array([v is not None and next(good) for v in found], pa.bool_()))

    return run


def accepted(documents: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text has a language: not `und`, and a score of at least `least`.

    Rows pass through the workers whole, 512 at a time, so that the executor keeps no queue of them beside."""
    return documents.mapInArrow(_accepted(model, documents.columns.index("text"), least), documents.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs.where(~held_out())))
