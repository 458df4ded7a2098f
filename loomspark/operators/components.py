"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    joined = down.join(low, "a")
    moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of one orderable type -> (node, component): the smallest node reachable.

    Nulls and self-loops are ignored as edges; a node that stands in no edge with another node is absent.
    Each round costs two aggregations and two equi-joins and is written out; the number of rounds is
    logarithmic in the longest path. Nothing but one count and one checksum comes to the driver.
    """
    state = materialise(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            break
        seen, before = tuple(mark), state
        state = materialise(_small_star(_large_star(before)), "star")
        release(before)
    else:
        raise RuntimeError("components did not settle")
    out = state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
    out.scratch = state.scratch
    return out
