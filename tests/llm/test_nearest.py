"""Nearest neighbours against brute force: recall, scores, ties and edges."""

from __future__ import annotations

import numpy as np
import pytest

from murmurate.llm import nearest


def by_hundred(key):
    return key % 100 == 0


def test_perturbations_come_in_order():
    rng = np.random.default_rng(0)
    for _ in range(20):
        inside = rng.uniform(size=5)
        sets = nearest.perturbations(inside, 40)
        cost = [sum(inside[h] ** 2 if m < 0 else (1 - inside[h]) ** 2 for h, m in s) for s in sets]
        assert sets[0] == [] and cost == sorted(cost)
        assert len({tuple(sorted(s)) for s in sets}) == len(sets)


def test_recall_on_the_test_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in nearest.search(vectors, by_hundred).collect()}
    want = {(q, v): s for q, _, v, s in nearest.exact(vectors, by_hundred)}
    hit = set(got) & set(want)
    assert len(hit) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-12 for p in hit)
    assert len(got) == len(want)


@pytest.mark.parametrize(("size", "every"), [("sf0.001", 1), ("sf0.01", 1), ("sf0.1", 5)])
def test_recall_over_hundreds_of_queries(spark, size, every):
    vectors = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    got = {(r["query_id"], r["vec_id"]) for r in nearest.search(vectors, lambda key: key % every == 0).collect()}
    held = vectors.select("vec_id", "embedding").toPandas()
    ids, x = held["vec_id"].to_numpy(), np.stack(held["embedding"].to_numpy()).astype(float)
    want = set()
    for n in np.flatnonzero(ids % every == 0):
        far = np.linalg.norm(x - x[n], axis=1)
        far[n] = np.inf
        want |= {(ids[n], v) for v in ids[np.argsort(far)[:10]]}
    assert len(want) >= 4000
    recall = len(got & want) / len(want)
    assert recall >= 0.95


def test_crowded_buckets_are_cut(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    rows = [(i, (base + 1e-6 * rng.normal(size=8)).tolist()) for i in range(600)] + [(1000 + i, base.tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nearest.search(df, by_hundred, unit=32).collect())
    want = sorted(r[:3] for r in nearest.exact(df, by_hundred))
    assert got == want


def test_edges(spark):
    rows = [(0, [1.0, 0.0], "a"), (100, [0.0, 1.0], "a"), (1, [float("nan"), 1.0], "b"), (2, [0.0, 0.0], "b"), (3, None, "b"),
            (4, [None, 1.0], "b"), (5, [1.0, 0.0], "c"), (6, [1.0, 0.0], "c"), (7, [1.0, 2.0, 3.0], "d"), (None, [1.0, 1.0], "e"),
            (0, [1.0, 0.0], "a"), (8, [float("inf"), 1.0], "b"), (9, [], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in nearest.search(df, by_hundred).collect())
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 5), (0, 2, 6), (0, 3, 100), (100, 1, 0), (100, 2, 5), (100, 3, 6)]
    assert got[0][3] == 0.0 and abs(got[2][3] - 2**0.5) < 1e-15
    assert nearest.search(df.limit(0), by_hundred).collect() == []
