"""Windows of reviews: undated ones as the SQL has them, and equal ones against a plain union."""

from __future__ import annotations

import random

from murmurate import registry
from murmurate.operators.sets import merged_intervals
from tests.oracle import compare, connect

registry.load()


def test_undated_as_in_the_sql(spark, tmp_path):
    sf, days = "/root/testdata/sf0.001", ["2000-01-01", "2000-01-03", "2000-01-10", None, None]
    orders = spark.createDataFrame([(i, 1, d) for i, d in enumerate(days)] + [(10, 2, None), (11, 2, None), (12, 3, "2000-02-01")], "o_orderkey long, o_custkey long, day string")
    orders.selectExpr("o_orderkey", "o_custkey", "'F' AS o_orderstatus", "1.0D AS o_totalprice", "to_timestamp(day) AS o_orderdate", "'1-URGENT' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    for t in ("customer", "nation"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    con = connect(sf)
    for t in ("orders", "customer", "nation"):
        con.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    compare(spark, con, str(tmp_path), registry.QUERIES["fetch_windows"], registry.SQL["fetch_windows"])


def test_equal_windows(spark):
    rng = random.Random(3)
    rows = [(a, s, s + 4) for a in range(50) for s in (rng.randrange(150) for _ in range(12)) for _ in range(rng.randrange(1, 7))]
    want = []
    for a in range(50):
        made = []
        for s, e in sorted(r[1:] for r in rows if r[0] == a):
            if made and s <= made[-1][2]:
                made[-1][2:] = [max(e, made[-1][2]), made[-1][3] + 1]
            else:
                made.append([a, s, e, 1])
        want += map(tuple, made)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a long, s long, e long").repartition(7)
    assert sorted(map(tuple, merged_intervals(df, ["a"], "s", "e").select("a", "s", "e", "n").collect())) == want
