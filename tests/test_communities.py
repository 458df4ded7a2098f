"""communities_cc over small tables whose communities are written out by hand."""

import duckdb

from loomspark.plans import ORACLE_SQL, QUERIES

TABLES = {
    "region": ([(0, "NORTH"), (1, "SOUTH"), (2, "EMPTY")], "r_regionkey long, r_name string"),
    "nation": ([(0, "AA", 0), (1, "ZZ", 0), (2, "BB", 1)], "n_nationkey long, n_name string, n_regionkey long"),
    "supplier": ([(1, "S1", 0), (2, "S2", 2)], "s_suppkey long, s_name string, s_nationkey long"),
    "customer": ([(1, "C1", 1), (2, "C2", 2)], "c_custkey long, c_name string, c_nationkey long"),
    "part": ([(1,), (2,), (3,)], "p_partkey long"),
    # Both regions sell part 1, which must not join them; part 2 is sold in one region, part 3 nowhere.
    "lineitem": ([(1, 1, 50.0), (2, 1, 50.0), (1, 2, 1.0)], "l_suppkey long, l_partkey long, l_quantity double"),
}


def test_parts_join_no_communities(spark, tmp_path):
    con = duckdb.connect()
    for name, (rows, schema) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    north, south = dict.fromkeys(["NORTH", "AA", "ZZ", "S1", "C1"], "AA"), dict.fromkeys(["SOUTH", "BB", "S2", "C2"], "BB")
    alone = {name: name for name in ("EMPTY", "Part#1", "Part#2", "Part#3")}
    want = sorted({**north, **south, **alone}.items())
    assert sorted(map(tuple, QUERIES["communities_cc"](spark, str(tmp_path)).select("name", "community").collect())) == want
    assert sorted(con.execute(f"SELECT name, community FROM ({ORACLE_SQL['communities_cc']})").fetchall()) == want
