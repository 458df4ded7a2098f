"""Operator 2: against brute force and its SQL."""

import math

import duckdb
import numpy as np

from loomspark.llm import vafile


def brute(rows, k):
    fit = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fit:
        if q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fit if i != q and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def rows_of(n=700, dim=12):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=dim)]) for i in range(n)]
    rows[5] = (5, rows[4][1])
    rows[6] = (6, rows[4][1])
    rows[200] = (200, [0.0] * dim)  # ties with everything
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * (dim - 2)), (1100, [math.nan] * dim), (1002, [math.inf] + [0.0] * (dim - 1)), (None, [1.0] * dim), (1200, [1.0, 2.0]), (1201, [3.0, 4.0])]
    return rows


def test_exact_top_k(spark):
    rows = rows_of()
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<float>, bucket string, dim int").repartition(3)
    got = vafile.exact_top_k(df, df.where("vec_id % 100 = 0"), block=64)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, 10)
    con = duckdb.connect()
    table = df.select("vec_id", "embedding").where("vec_id is not null").toArrow()
    con.register("embeddings", table)
    assert sorted(con.execute(vafile.SQL).fetchall()) == brute(rows, 10)


def test_fewer_candidates_than_k_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.25, -0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vafile.exact_top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 1024 * 256 - 512 * 512)]
    assert vafile.exact_top_k(df.where("false"), df.where("false")).count() == 0


def test_repeated_queries_and_large_components(spark):
    rows = [(0, [3.0, 1.0]), (0, [-1.0, 2.0]), (1, [1.0, 1.0]), (2, [2.0, -1.0]), (2, [2.0, 5.0]), (100, [1e300, -1e9]), (3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in vafile.exact_top_k(df, df.where("vec_id % 100 = 0")).collect())
    cut = lambda x: max(-(1 << 28), min(1 << 28, math.floor(1024 * x)))
    want = []
    for q in (0, 100):
        a = min([cut(x) for x in v] for i, v in rows if i == q)
        scores = sorted((-sum(x * cut(y) for x, y in zip(a, v, strict=True)), i) for i, v in rows if i != q)
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert got == want


def test_few_exact_vectors_are_read(spark):
    """Of unit vectors the cells leave a small part to be read exactly."""
    r = np.random.default_rng(2)
    v = r.normal(size=(4000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    whole = vafile._whole(df)
    read = vafile.candidates(whole, whole.where("vec_id % 100 = 0"), 10, block=512).count()
    assert 400 <= read <= 0.05 * 40 * 4000


def test_bounds_hold_for_any_width():
    r = np.random.default_rng(3)
    for size in (1, 100, 5000, 1 << 28):
        x, q = (r.integers(-size, size + 1, (50, 7)) for _ in range(2))
        shift, cells = vafile.cells_of(x)
        low, high = vafile.bounds(q, shift, cells)
        exact = (q.astype(object) @ x.astype(object).T).astype(np.float64)
        assert (low <= exact).all() and (exact <= high).all()
        assert shift == 0 or np.abs(cells.astype(int)).max() > 63
