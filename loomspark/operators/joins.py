"""Joins of a query set with a large table, without a cross join and with broadcasts of checked size only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, NumericType, StringType, StructType


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row of df takes."""
    total = F.lit(8 * len(df.columns)).cast("long")
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, StringType | BinaryType):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(kind, ArrayType) and isinstance(kind.elementType, NumericType):
            total = total + F.greatest(F.size(c), F.lit(0)) * 8
        elif isinstance(kind, ArrayType | MapType | StructType):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return total


def small(df: DataFrame, rows: int = 10_000, megabytes: int = 32) -> DataFrame:
    """Marked for broadcast if it has at most that many rows and bytes; the check reads no more than rows + 1 of them."""
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= megabytes << 20 else df


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """rows with the columns of a large table by key, null where it has none (or not at all: inner); only the table's rows that are asked for are moved while the keys are few."""
    return rows.join(table.join(small(rows.select(key).distinct(), 100_000), key, "left_semi"), key, how)


def meet(queries: DataFrame, items: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every query with every item. A small query set is broadcast; a larger one is copied to each of a number of buckets of items."""
    near = small(queries)
    if near is not queries:
        return items.crossJoin(near)
    buckets = buckets or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = queries.withColumn("__bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    dealt = items.withColumn("__bucket", F.pmod(F.xxhash64(*[c for c, kind in items.dtypes if not kind.startswith("map")]), F.lit(buckets)).cast("int"))
    return dealt.join(spread, "__bucket").drop("__bucket")
