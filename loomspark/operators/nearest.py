"""Exact inner products of every query with every item, a block of each at a time, in numpy.

Items and queries are packed into blocks of bounded size. A task takes pairs of blocks: one matrix product gives all scores to
within a bound on rounding; what may be among a query's k best by it, given what the task has found so far, is summed anew in the order
of the components, as `vectors.dot` does. At most k hits of a query leave a pair of blocks, ties by the smaller doc_id, and only those that
reach the k-th score of the pairs before. What a task holds is two blocks, their products, and k scores a query.

Scores are null where a vector, a component or the weight is null, or lengths differ; such hits come after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, StringType, StructType

from ..functions import vectors as V
from ..session import importable
from .joins import meet

#: Rows and bytes of a block of items, and of queries.
ITEM_BLOCK, QUERY_BLOCK = (4096, 2 << 20), (1024, 512 << 10)


def _lengths(v: pa.Array) -> np.ndarray:
    """The number of components of each vector, -1 where it or one of them is null."""
    n = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = v.flatten()
    if flat.null_count:
        row = np.repeat(np.arange(len(n)), np.maximum(n, 0))
        n[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return n


def _packed(block: tuple[int, int]):
    """(row, key, v, weight) -> blocks of vectors of one length, sorted by key as Spark sorts it."""

    def size(dim: int) -> int:
        return max(1, min(block[0], block[1] // (8 * max(dim, 1))))

    def blocks(dim: int, scored: bool, parts: list[pa.RecordBatch], number: Iterator[int]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        t = t.take(pc.sort_indices(t["key"], null_placement="at_start"))
        for at in range(0, t.num_rows, size(dim)):
            rows, _, v, weight = (pa.concat_arrays(c.chunks) for c in t.slice(at, size(dim)).columns)
            n = len(rows)
            flat = v.flatten().to_numpy(zero_copy_only=False) if dim >= 0 else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{TaskContext.get().partitionId()}-{next(number)}"]), pa.array([n], pa.int32()), pa.array([dim], pa.int32()), pa.array([scored]), pa.ListArray.from_arrays([0, n], rows),
                 pa.array([flat.astype(np.float64).tobytes()]), pa.array([pc.fill_null(weight, 0.0).to_numpy(zero_copy_only=False).astype(np.float64).tobytes()])],
                names=["block", "n", "dim", "scored", "rows", "vectors", "weights"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[pa.RecordBatch]] = {}
        number = iter(range(1 << 62))
        for b in batches:
            dims, weighted = _lengths(b.column("v")), b.column("weight").is_valid().to_numpy(zero_copy_only=False)
            for dim, scored in sorted(set(zip(dims.tolist(), weighted.tolist(), strict=True))):
                own = held.setdefault((dim, scored), [])
                own.append(b.filter(pa.array((dims == dim) & (weighted == scored))))
                if sum(x.num_rows for x in own) >= size(dim):
                    yield from blocks(dim, scored and dim >= 0, held.pop((dim, scored)), number)
        for (dim, scored), own in held.items():
            yield from blocks(dim, scored and dim >= 0, own, number)

    return run


def exact(q: np.ndarray, v: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (rows, at), summed from 0 in the order of the components."""
    total = np.zeros(len(rows))
    for i in range(q.shape[1]):
        total += q[rows, i] * v[at, i]
    return total


def _first_k(scores: np.ndarray, k: int) -> np.ndarray:
    """Which k of each row stand first by descending score, not-a-number the greatest, then place."""
    s = np.where(np.isnan(scores), np.inf, scores)
    nan = np.isnan(scores)
    out = np.zeros(s.shape, bool)
    for i in range(len(s)):
        out[i, np.lexsort((-s[i], ~nan[i]))[:k]] = True
    return out


def candidates(q: np.ndarray, v: np.ndarray, w: np.ndarray, k: int, least: np.ndarray) -> np.ndarray:
    """Which pairs may be among the k best of their query (mask of queries by items), where least is what each must reach; beyond a few for each query they are settled exactly."""
    n, dim = v.shape
    close = q @ (v * w[:, None]).T
    largest = np.abs(v).max(initial=0) * np.abs(w).max(initial=0)
    # Twice what two sums of rounded products can differ by.
    slack = 8 * (dim + 4) * dim * 2.3e-16 * np.abs(q).max(1, initial=0) * largest + 1e-300
    mask = ~(close < (least - slack)[:, None])
    few = 4 * k + 64
    many = np.flatnonzero(np.count_nonzero(mask, 1) > few)
    if len(many) and n > k:
        part = close[many]
        mask[many] &= ~(part < (np.partition(part, n - k, 1)[:, n - k] - slack[many])[:, None])
        many = many[np.count_nonzero(mask[many], 1) > few]
        # So many are equal, or so nearly, that they are told apart by exact scores, some rows at a time.
        step = max(1, (1 << 20) // n)
        for at in range(0, len(many), step):
            own = many[at : at + step]
            total = np.zeros((len(own), n))
            for i in range(dim):
                total += q[own, i][:, None] * v[:, i][None, :]
            mask[own] = _first_k(total * w, k)
    return mask


def _best(k: int, types: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for i in range(b.num_rows):
                get = lambda name: b.column(name)[i]  # noqa: B023, E731
                array = lambda name: np.frombuffer(get(name).as_buffer(), np.float64)  # noqa: B023, E731
                n, dim, asked, q_dim = (get(c).as_py() for c in ("n", "dim", "q_n", "q_dim"))
                best, count = found.setdefault(get("q_block").as_py(), (np.full((asked, k), -np.inf), np.zeros(asked, np.int64)))
                met = dim == q_dim and dim >= 0
                q, v, w = (array("q_vectors").reshape(asked, dim), array("vectors").reshape(n, dim), array("weights")) if met else (None, None, None)
                with np.errstate(all="ignore"):
                    if met and get("scored").as_py():
                        rows, at = np.nonzero(candidates(q, v, w, k, best.min(1)))
                        raw = exact(q, v, rows, at)
                        score = raw * w[at]
                        order = np.lexsort((at, -score, ~np.isnan(score), rows))
                        rows, at, raw, score = rows[order], at[order], raw[order], score[order]
                        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                        keep = (place < k) & ~(score < best.min(1)[rows])
                        rows, at, raw, score, place = (x[keep] for x in (rows, at, raw, score, place))
                        new = np.full((asked, k), -np.inf)
                        new[rows, place] = np.where(np.isnan(score), np.inf, score)
                        best[:] = np.partition(np.concatenate([best, new], 1), k - 1, 1)[:, k:]
                        np.add.at(count, rows, 1)
                        told, known = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
                    else:
                        # No scores: the first ids stand for the block, for queries that have not k scores yet.
                        rows = np.repeat(np.flatnonzero(count < k), min(k, n))
                        at = np.tile(np.arange(min(k, n)), len(rows) // max(1, min(k, n)))
                        raw = exact(q, v, rows, at) if met else np.zeros(len(rows))
                        score, told, known = raw, np.full(len(rows), not met), np.ones(len(rows), bool)
                if len(rows):
                    taken = [get("q_rows").values.take(pa.array(rows)), get("rows").values.take(pa.array(at)), pa.array(raw, mask=told), pa.array(score, mask=known)]
                    yield pa.RecordBatch.from_arrays([x.cast(t.type) for x, t in zip(taken, types, strict=True)], schema=types)

    return run


def _blocks(df: DataFrame, key: str, vector: str, weight: str | None, block: tuple[int, int]) -> DataFrame:
    rest = [c for c in df.columns if c not in (vector, weight)]
    rows = df.select(F.struct(*rest).alias("row"), F.col(key).alias("key"), V.doubles(F.col(vector)).alias("v"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))
    types = StructType().add("block", StringType()).add("n", IntegerType()).add("dim", IntegerType()).add("scored", BooleanType()).add("rows", ArrayType(rows.schema["row"].dataType)).add("vectors", BinaryType()).add("weights", BinaryType())
    return rows.mapInArrow(_packed(block), types)


def nearest(items: DataFrame, queries: DataFrame, k: int, weight: str | None = None, item_block: tuple[int, int] = ITEM_BLOCK, query_block: tuple[int, int] = QUERY_BLOCK) -> DataFrame:
    """query_id, the columns of items but embedding and weight, raw (the inner product), score (times the weight): a few rows for each query that hold its k best, ties by doc_id.

    items (doc_id, embedding, further columns), queries (query_id, q_embedding). A query_id that stands twice is two queries here.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = items.sparkSession
    importable(spark)
    tasks = spark.sparkContext.defaultParallelism
    asked = _blocks(queries.select("query_id", "q_embedding").repartition("query_id"), "query_id", "q_embedding", None, query_block)
    asked = asked.select(F.col("block").alias("q_block"), F.col("n").alias("q_n"), F.col("dim").alias("q_dim"), F.col("rows").alias("q_rows"), F.col("vectors").alias("q_vectors"))
    met = meet(asked, _blocks(items, "doc_id", "embedding", weight, item_block).repartition(tasks), tasks)
    types = StructType().add("q", met.schema["q_rows"].dataType.elementType).add("row", met.schema["rows"].dataType.elementType).add("raw", DoubleType()).add("score", DoubleType())
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in types.fields])
    return met.mapInArrow(_best(k, arrow), types).select("q.query_id", "row.*", "raw", "score")
