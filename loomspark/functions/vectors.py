"""Vector columns, in double precision."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(doubles(v), lambda x: x / norm)).otherwise(doubles(v))


def combined(query: Column, hypothetical: Column, query_weight: float = 0.4) -> Column:
    """Weighted sum of a query's and a hypothetical answer's vectors, scaled to length one."""
    return normalised(F.zip_with(doubles(query), doubles(hypothetical), lambda q, h: query_weight * q + (1 - query_weight) * h))


def hashed_embedding(text: Column, dim: int) -> Column:
    """A deterministic offline embedding: hashed word counts with signs, scaled to length one. It stands in for a model, in Arrow batches like one."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in _WORD.findall((t or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h >> 31 else -1.0
            n = np.linalg.norm(v)
            out.append(v / n if n else v)
        return pd.Series(out)

    return run(text)
