"""Connected components of a graph that no one machine holds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: Rounds after which the edges would long be stars; more means a fault.
MOST_ROUNDS = 60


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each node's smallest known fellow, itself at first) after the edges a-b; in memory, for one task."""
    while True:
        la, lb = labels[a], labels[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        if not (apart := low < high).any():
            return labels
        np.minimum.at(labels, high[apart], low[apart])
        while (up := labels[labels]).tobytes() != labels.tobytes():
            labels = up


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: long): root is the smallest node that it reaches.

    Alternating large-star and small-star rounds: every node hands its neighbours to the smallest of them until
    each component is a star. A round moves each edge a few times and keeps their number from growing. Minima are
    taken with map-side combining and written before they are joined, so that a hub with most of the edges can be split; each round's
    edges are written.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(MOST_ROUNDS):
        mark = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m")), "least")
        large = stored(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges-large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
