"""Marked texts and what they fit: odd ones as the SQL has them, and many equal ones."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from murmurate import registry
from tests.oracle import connect, plain

registry.load()
PART = "p_partkey long, p_name string, p_brand string"


def hits(spark, folder):
    return sorted((r["id"], r["matched"], r["hits"]) for r in registry.QUERIES["censored_match"](spark, folder).collect())


def test_odd_texts_as_the_sql(spark, tmp_path):
    names = ["hot pan", "hxt p\nn", "hyt pen", "♥xt pan", "", None, "a", "\n", "e", "♥", "[a.b]*", "[x.b]*", "[a-b]*", "aeiouae", "aeiouaexyz", "zzzzzzzxyz", "AEIOU", "a_%\\o", "b_%\\u", "b.%\\u", "großer", "groß♥r", "grösser"]
    rows = [(10 * i, n, "x") for i, n in enumerate(names)] + [(10 * i + 1, n, "x" if i % 2 else "y") for i, n in enumerate(names)] + [(500, "hot pan", None), (505, "hot pan", "y"), (510, "lone", "z"), (None, "lane", "z"), (515, "lane", "w"), (515, "lone", "w"), (-5, "oft", "v"), (3, "aft", "u")]
    rows = [r for r in rows if r[1] is None or r[1].isascii() or "ß" not in r[1] and "ö" not in r[1]]  # DuckDB's expressions can't escape these
    folder = str(tmp_path)
    spark.createDataFrame(rows, PART).write.parquet(f"{folder}/part.parquet")
    con = connect("/root/testdata/sf0.001")
    con.sql(f"CREATE OR REPLACE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    want = sorted((r[0], plain(r[1]), r[2]) for r in con.sql("SELECT id, matched, hits FROM (" + registry.SQL["censored_match"] + ")").fetchall())
    assert hits(spark, folder) == want


def test_equal_texts_meet_once(spark, tmp_path):
    n = 20_000
    spark.range(n).select(F.col("id").alias("p_partkey"), F.when(F.col("id") % 4 == 0, "hat stand").otherwise("hot stand").alias("p_name"), F.lit("x").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    start = time.perf_counter()
    assert set(r[1:] for r in hits(spark, str(tmp_path))) == {(None, n)}
    assert time.perf_counter() - start < 90  # 80 million pairs of rows, two texts


def test_heads_lose_nothing(spark):
    from murmurate.operators.upkeep import marked_hits

    texts = spark.sql("SELECT id, concat_ws('', transform(sequence(1, 3 + id % 7), k -> substr('aeibc', CAST(1 + pmod(hash(id, k), 5) AS INT), 1))) AS words, CAST(id % 2 AS STRING) AS brand FROM range(1500)")
    marked = texts.where("id % 5 = 0").select("brand", F.regexp_replace("words", "[aeiou]", "♥").alias("marked"))
    rows, want = texts.collect(), {}
    for m in set(map(tuple, marked.collect())):
        fit = [r["id"] for r in rows if r["brand"] == m[0] and len(r["words"]) == len(m[1]) and all(a in ("♥", b) for a, b in zip(m[1], r["words"]))]
        want[m] = (min(fit), len(fit))
    for head in (1, 6):
        assert {(r["brand"], r["marked"]): (r["first"], r["hits"]) for r in marked_hits(marked, texts, "brand", head).collect()} == want
