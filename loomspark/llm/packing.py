"""Operator 3: best-fit packing by minimum bin slack.

Only the counts of the lengths decide how to pack, and there are at most `capacity` lengths. The plan is made
from them: the longest length that is left opens a bin; subset sums over the lengths still available (a bitset
as one large integer, counts by binary splitting) give the fullest feasible filling; that combination is then
removed as often as the counts allow. The plan's size depends on the capacity, not on the data.
Pieces are numbered within (task, length) while they are cut; counts by task turn this into numbers within each
length, and the plan's intervals give sequence and offset. No group of rows meets in one task.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed once each;
an empty table packs into nothing; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, table
from .tokens import encoder, pieces_of, word_vocabulary

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """A combination of the available lengths with the largest sum of at most room. Longer lengths are tried first."""
    reach, steps, goal = 1, [], 1 << room
    mask = (1 << room + 1) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, many = min(counts[length], room // length), 1
        while left and not reach & goal:
            take = min(many, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, many = left - take, many * 2
        if reach & goal:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first number, first sequence, uses in a sequence, offset), sorted; numbers count from 0 within a length."""
    left = {k: v for k, v in counts.items() if v > 0}
    taken: dict[int, int] = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        top = max(left)
        left[top] -= 1
        use = fullest(capacity - top, {k: v for k, v in left.items() if v})
        left[top] += 1
        use[top] = use.get(top, 0) + 1
        times, offset = min(left[k] // u for k, u in use.items()), 0
        for k in sorted(use, reverse=True):
            rows.append((k, taken[k], sequence, use[k], offset))
            offset += k * use[k]
            taken[k] += times * use[k]
            left[k] -= times * use[k]
            if not left[k]:
                del left[k]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode_texts, seen = TaskContext.get().partitionId(), encoder(path), {}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, some in pieces_of(texts):
                out = []
                for doc, tokens in zip(ids[at:], encode_texts(some), strict=False):
                    whole = np.append(tokens, np.uint32(end_id)).astype("<u4")
                    for p, start in enumerate(range(0, len(whole), capacity)):
                        part = whole[start : start + capacity]
                        k = len(part)
                        out.append((doc, p, start, k, zlib.crc32(part.tobytes()), task, seen.get(k, 0)))
                        seen[k] = seen.get(k, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"])

    return run


def _placed(rows: np.ndarray):
    key = rows[:, 0] << 48 | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "number"))
            at = np.searchsorted(key, length << 48 | number, side="right") - 1
            _, first, sequence, uses, offset = rows[at].T
            turn = number - first
            yield pa.RecordBatch.from_arrays(
                [b.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence + turn // uses, pa.int64()), pa.array(offset + turn % uses * length, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(documents: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    cut = materialise(documents.select("doc_id", "text").mapInArrow(_cut(vocabulary, end_id, capacity), _PIECES), "pieces")
    counts = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    rows = plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    numbered = cut.join(base, ["length", "task"]).withColumn("number", F.col("base") + F.col("number"))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(
        _placed(rows), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_vocabulary())
