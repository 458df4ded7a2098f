"""Operator 2: exact top-k search with vector-approximation files.

Each component is an integer, floor(1024 * x). The approximation file keeps of each only the number of its cell, one byte, in blocks of
at most `block` vectors whose cells are 2**shift wide, as narrow as the block's components allow. A first scan of the cells gives every
query's lower bounds of inner products; the k-th best of these over all blocks is what a result must reach. A second scan gives
upper bounds, and the vectors whose upper bound reaches that far are candidates. Exact vectors are read for them alone, in the order of their
bounds: the k best first, then those whose bound is not below the k-th exact score so far, which makes the result certain.

Query blocks are broadcast if they are few, else they meet vector blocks by the number of the bucket that a vector block lies in;
tasks work through pairs of blocks of bounded size, and what leaves a task is k bounds for each query and block, or candidates.

Defined results: vectors that are null, or hold null or non-finite components, take no part; scaled components beyond 2**28 count as
2**28, so that scores of up to 64 components of that size are exact; vectors of different lengths are never compared; a query never meets
rows of its own vec_id; of query rows that share a vec_id the one of the smallest vector is the query; other repeated rows count as often as they
stand there; rows with a null vec_id take no part; ties go to the smaller vec_id; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import small
from ..session import materialise, release, table

LARGEST = 1 << 28
_CELLS = "dim int, n int, shift int, ids binary, cells binary"
_QUERIES = "dim int, q_n int, q_ids binary, q_exact binary, q_least binary"


def cells_of(vectors: np.ndarray) -> tuple[int, np.ndarray]:
    """The narrowest width (as a shift) for which every component's cell number fits into a byte, and the cells."""
    most = int(np.maximum(vectors, ~vectors).max(initial=0))
    shift = max(0, most.bit_length() - 7)
    return shift, (vectors >> shift).astype(np.int8)


def bounds(queries: np.ndarray, shift: int, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products, from the cells alone."""
    q = queries.astype(np.float64)
    least = q @ (cells.astype(np.float64) * (1 << shift)).T
    # Rounding of the sums, beyond what they can be off.
    slack = (np.abs(q).sum(1) * (1 << shift + 7) * (queries.shape[1] + 2) * 2.3e-16)[:, None]
    width = (1 << shift) - 1
    return least + np.minimum(q, 0).sum(1)[:, None] * width - slack, least + np.maximum(q, 0).sum(1)[:, None] * width + slack


def _held(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(ids, vectors, third column) in blocks of at most size vectors of one length."""
    held: dict[int, tuple[list, list, list]] = {}
    out = lambda ids, vectors, more: (np.array(ids, np.int64), np.array(vectors, np.int64).reshape(len(ids), -1), more)
    for b in batches:
        more = b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows
        for i, v, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), more, strict=True):
            own = held.setdefault(len(v), ([], [], []))
            for part, value in zip(own, (i, v, x), strict=True):
                part.append(value)
            if len(own[0]) == size:
                yield out(*held.pop(len(v)))
    for own in held.values():
        yield out(*own)


def _approximated(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors, _ in _held(batches, size):
            shift, cells = cells_of(vectors)
            yield pa.RecordBatch.from_pylist([{"dim": vectors.shape[1], "n": len(ids), "shift": shift, "ids": ids.tobytes(), "cells": cells.tobytes()}], pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("shift", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary())]))

    return run


def _asked(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors, least in _held(batches, size):
            row = {"dim": vectors.shape[1], "q_n": len(ids), "q_ids": ids.tobytes(), "q_exact": vectors.tobytes(), "q_least": np.array(least, np.float64).tobytes()}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("dim", pa.int32()), ("q_n", pa.int32()), ("q_ids", pa.binary()), ("q_exact", pa.binary()), ("q_least", pa.binary())]))

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each pair of blocks: query ids, what each query's results must reach, vector ids, lower and upper bounds; no row meets its own id."""
    for b in batches:
        for i in range(b.num_rows):
            r = {name: b.column(name)[i].as_py() for name in b.schema.names}
            q_ids, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
            low, high = bounds(np.frombuffer(r["q_exact"], np.int64).reshape(r["q_n"], r["dim"]), r["shift"], np.frombuffer(r["cells"], np.int8).reshape(r["n"], r["dim"]))
            own = q_ids[:, None] == ids[None, :]
            low[own] = high[own] = -np.inf
            yield q_ids, np.frombuffer(r["q_least"], np.float64), ids, low, high


def _lower(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, _, _, low, _ in _pairs(batches):
            best = -np.partition(-low, min(k, low.shape[1]) - 1, axis=1)[:, :k]
            n, at = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[n]), pa.array(best[n, at])], names=["query_id", "low"])

    return run


def _reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for q_ids, least, ids, _, high in _pairs(batches):
        n, at = np.nonzero((high >= least[:, None]) & (high > -np.inf))
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[n]), pa.array(ids[at]), pa.array(high[n, at])], names=["query_id", "vec_id", "high"])


def _whole(df: DataFrame) -> DataFrame:
    """vec_id and the integers of rows that take part."""
    fit = F.expr("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    scaled = F.expr(f"transform(embedding, x -> cast(greatest(-{LARGEST}D, least({LARGEST}D, floor(least(1e15D, greatest(-1e15D, 1024 * double(x)))))) as long))")
    return df.select("vec_id", "embedding").where(fit).select("vec_id", scaled.alias("e"))


def _met(cells: DataFrame, queries: DataFrame) -> DataFrame:
    """Vector blocks with query blocks of the same length."""
    near = small(queries, 500)
    if near is not queries:
        return cells.join(near, "dim")
    buckets = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = queries.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return cells.withColumn("bucket", F.pmod(F.xxhash64("ids"), F.lit(buckets)).cast("int")).join(spread, ["bucket", "dim"]).drop("bucket")


def candidates(vectors: DataFrame, asked: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """query_id, vec_id, high: what may be among a query's k best by the cells; vectors and asked hold (vec_id, e)."""
    cells = materialise(vectors.mapInArrow(_approximated(block), _CELLS), "cells")
    first = materialise(asked.select("vec_id", "e", F.lit(float("-inf")).alias("least")).mapInArrow(_asked(block // 4), _QUERIES), "asked")
    low = _met(cells, first).mapInArrow(_lower(k), "query_id long, low double")
    place = low.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))).where(F.col("place") <= k)
    least = materialise(place.groupBy("query_id").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select(F.col("query_id").alias("vec_id"), "least"), "least")
    told = asked.join(least, "vec_id", "left").select("vec_id", "e", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    second = materialise(told.mapInArrow(_asked(block // 4), _QUERIES), "asked")
    found = materialise(_met(cells, second).mapInArrow(_reaching, "query_id long, vec_id long, high double"), "candidates")
    release(cells, first, least, second)
    return found


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score for queries and vectors of columns (vec_id, embedding)."""
    v = _whole(vectors)
    asked = materialise(_whole(queries).groupBy("vec_id").agg(F.min("e").alias("e")), "queries")
    found = materialise(candidates(v, asked, k, block).groupBy("query_id", "vec_id").agg(F.max("high").alias("high")), "found")
    order = Window.partitionBy("query_id").orderBy(F.desc("high"), "vec_id")
    top = materialise(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k), "top")

    def read(some: DataFrame, label: str) -> DataFrame:
        """Exact scores: only the vectors that are named, each row that has such an id."""
        pairs = v.join(small(some.select("query_id", "vec_id"), 200_000), "vec_id").join(small(asked.select(F.col("vec_id").alias("query_id"), F.col("e").alias("q")), 20_000), "query_id")
        score = F.expr("aggregate(zip_with(e, q, (x, y) -> x * y), 0L, (s, x) -> s + x)")
        return materialise(pairs.where(F.size("e") == F.size("q")).select("query_id", "vec_id", score.alias("score")), label)

    first = read(top, "first-reads")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    sure = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("sure"))
    rest = found.join(top.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti").join(sure, "query_id", "left").where(F.col("sure").isNull() | (F.col("high") >= F.col("sure")))
    all_ = first.unionByName(read(rest, "further-reads"))
    return all_.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 100 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
"""
