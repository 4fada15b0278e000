"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` tables cuts ``hashes`` random projections into slots of ``width`` times the vectors' median
length; a vector's slots name its bucket. A query visits its own bucket of each table and then those with single or
several slots moved to a neighbour, in order of the estimated chance of success (the squared distances to the slot
borders that are crossed), ``probes`` in all. Candidates of all tables are merged and ranked by exact distance in
double precision on the original vectors.

Scale: the index is one row a vector and table, dealt by bucket into blocks of about ``unit`` rows. A query sends the
names of the buckets it visits, and its vector once to each block that holds some of them; the block returns the
query's best few, so no row is made for a pair. Buckets over ``unit`` vectors are cut into parts, and blocks that over
``unit`` queries visit are searched by several tasks. Of equal vectors only the k + 1 smallest ids can be in a result, and only
those are indexed. Queries that found too few are answered exactly: blocks of them meet blocks of all vectors, in one job.

Defined cases: vectors that are null, empty, all zero, or hold null or non-finite numbers, and rows without an id, take
no part; of rows with one id the smallest vector counts; vectors meet only others of their dimension; ties go to
the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .scratch import stored

#: Chosen for a recall clearly above 0.9 also on small tables, whose neighbours lie farther away than those of large ones.
TABLES, HASHES, WIDTH, PROBES = 8, 8, 2.4, 80
UNIT = 8192
#: Distances held at once.
PAIRS = 1 << 18


def valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def functions(dimension: int, tables: int, hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The projections and offsets (in slots) of every table; the same wherever they are made."""
    rng = np.random.default_rng([seed, dimension])
    return rng.normal(size=(tables, hashes, dimension)), rng.uniform(size=(tables, hashes))


def bucket_of(slots: np.ndarray, dimension: int) -> np.ndarray:
    """One long for (dimension, table, slots), slots along the last axis and tables along the one before."""
    tables = np.arange(slots.shape[-2], dtype=np.uint64) + np.uint64(dimension << 16)
    out = np.broadcast_to(tables, slots.shape[:-1]).copy()
    for k in range(slots.shape[-1]):
        out = (out ^ slots[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def perturbations(inside: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """The sets of (hash, move) of least total squared distance to the borders crossed, the empty set first.

    inside has each projection's place in its slot, 0 to 1.
    """
    moves = sorted([(x * x, k, -1) for k, x in enumerate(inside.tolist())] + [((1 - x) ** 2, k, 1) for k, x in enumerate(inside.tolist())])
    found, heap = [[]], [(moves[0][0], (0,))]
    while heap and len(found) < probes:
        cost, chosen = heapq.heappop(heap)
        if len({moves[i][1] for i in chosen}) == len(chosen):
            found.append([moves[i][1:] for i in chosen])
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(heap, (cost + moves[last + 1][0], (*chosen, last + 1)))
            heapq.heappush(heap, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
    return found


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each query's k nearest of what was found, each candidate once."""
    if not found:
        return []
    q, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((v, s, q))
    q, v, s = q[order], v[order], s[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
    q, v, s = q[fresh], v[fresh], s[fresh]
    starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return [(q[place < k], v[place < k], s[place < k])]


def _nearest(queries: np.ndarray, q_ids: np.ndarray, vectors: np.ndarray, v_ids: np.ndarray, k: int):
    """(query, vector, distance) of each query's k nearest others, ties to the smaller id."""
    step = max(1, PAIRS // max(1, len(vectors)))
    for a in range(0, len(queries), step):
        part = queries[a : a + step]
        gap = part[:, None, :] - vectors[None, :, :]
        far = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
        far[q_ids[a : a + step, None] == v_ids[None, :]] = np.inf
        if far.shape[1] > k:
            edge = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
            who, which = np.nonzero((far <= edge) & np.isfinite(far))
        else:
            who, which = np.nonzero(np.isfinite(far))
        yield q_ids[a + who], v_ids[which], far[who, which]


def search(vectors: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, tables: int = TABLES,
           hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES, unit: int = UNIT, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row whose id passes ``is_query``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & valid(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))
    rows = stored(rows, "vectors")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    middle = rows.agg(F.percentile_approx(length, 0.5)).first()[0]
    if middle is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    slot = width * middle
    # Numbers travel in the width they came in; all arithmetic is in double precision.
    kind = "<f4" if isinstance(vectors.schema[embedding].dataType.elementType, FloatType) else "<f8"
    # Copies beyond the k + 1 smallest ids are never among the nearest k.
    copies = F.row_number().over(W.partitionBy("v").orderBy("id"))
    index = rows.withColumn("copy", copies).where(F.col("copy") <= k + 1).select("id", "v")

    def hashed(batches):
        for b in batches:
            for ids, x, raw in _alike(b, kind):
                project, offset = functions(x.shape[1], tables, hashes, seed)
                named = bucket_of(np.floor(np.einsum("nd,thd->nth", x, project) / slot + offset), x.shape[1])
                for t in range(tables):
                    yield pd.DataFrame({"bucket": named[:, t], "id": ids, "raw": raw})

    def probing(batches):
        for b in batches:
            for ids, x, _ in _alike(b, kind):
                project, offset = functions(x.shape[1], tables, hashes, seed)
                at = np.einsum("nd,thd->nth", x, project) / slot + offset
                slots = np.floor(at)
                for n in range(len(x)):
                    moved = np.zeros((probes, tables, hashes))
                    for t in range(tables):
                        moved[:, t] = slots[n, t]
                        for r, chosen in enumerate(perturbations(at[n, t] - slots[n, t], probes)):
                            for h, step in chosen:
                                moved[r, t, h] += step
                    yield pd.DataFrame({"bucket": np.unique(bucket_of(moved, x.shape[1])), "id": ids[n]})

    held = index.mapInPandas(hashed, "bucket long, id long, raw binary")
    crowded = stored(held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > unit).select(
        "bucket", F.ceil(F.col("n") / F.lit(max(1, unit // 2))).cast("int").alias("parts")), "crowded-buckets")
    blocks = max(1, -(-index.count() * tables // unit))
    parts = F.coalesce("parts", F.lit(1))
    place = lambda key, part: F.pmod(F.xxhash64(key, part), F.lit(blocks))
    held = held.join(crowded, "bucket", "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).select(
        place("bucket", "part").alias("block"), F.array("bucket").alias("buckets"), "id", "raw")
    asked = rows.where(is_query(F.col("id")))
    probed = asked.mapInPandas(probing, "bucket long, id long").join(crowded, "bucket", "left")
    probed = probed.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(place("bucket", "part").alias("block"), "bucket", "id")
    probed = stored(probed.groupBy("id", "block").agg(F.collect_set("bucket").alias("buckets")), "vector-probes")
    raw_of = lambda df: df.mapInPandas(_raw(kind), "id long, raw binary")
    probed = probed.join(raw_of(asked), "id").select("block", "buckets", "id", "raw")

    best = stored(_top(_met(held, probed, unit, k, kind), k), "nearest")
    full = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = stored(asked.join(full, F.col("id") == F.col("query_id"), "left_anti").select("id", "v"), "short-queries")
    if short.count():
        # Dimensions apart, each cut into blocks that every short query of the dimension meets.
        sizes = stored(index.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / F.lit(unit)).cast("int").alias("chunks")), "dimensions")
        named = lambda df: df.join(sizes, F.size("v") == F.col("dim"))
        chunk = lambda n: F.xxhash64("dim", n)
        whole = named(index).select(chunk(F.pmod(F.xxhash64("id"), "chunks").cast("int")).alias("block"), F.array(F.lit(0).cast("long")).alias("buckets"), "id", "v")
        asks = named(short).withColumn("n", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
            chunk(F.col("n")).alias("block"), F.array(F.lit(0).cast("long")).alias("buckets"), "id", "v")
        pack = lambda df: df.mapInPandas(_raw(kind, "block", "buckets"), "block long, buckets array<long>, id long, raw binary")
        best = _top(best.select("query_id", "vec_id", "score").unionByName(_met(pack(whole), pack(asks), unit, k, kind)), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _alike(batch: pd.DataFrame, kind: str):
    """(ids, vectors, their bytes) of each dimension in a batch."""
    sizes = np.array([len(v) for v in batch["v"]])
    for dim in np.unique(sizes).tolist():
        part = batch[sizes == dim]
        x = np.stack(part["v"].to_numpy()).astype(float)
        yield part["id"].to_numpy(), x, [v.tobytes() for v in x.astype(kind)]


def _raw(kind: str, *keep: str):
    """Vectors (column v) as bytes beside the id and the columns of keep."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({**{c: b[c] for c in keep}, "id": b["id"], "raw": [np.asarray(v, float).astype(kind).tobytes() for v in b["v"]]})

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    ranked = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def _met(held: DataFrame, asks: DataFrame, unit: int, k: int, kind: str) -> DataFrame:
    """(query_id, vec_id, score): of each block, the k nearest that each query finds in the buckets it names.

    held and asks: block, buckets, id, raw. A block's vectors, about ``unit``, are held by a task; its queries pass by.
    """
    spark = held.sparkSession
    busy = stored(asks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > unit).select(
        "block", F.ceil(F.col("n") / F.lit(max(1, unit // 2))).cast("int").alias("lanes")), "busy-blocks")
    lanes = F.coalesce("lanes", F.lit(1))
    held = held.join(busy, "block", "left").withColumn("lane", F.explode(F.sequence(F.lit(0), lanes - 1))).withColumn("asks", F.lit(0))
    asks = asks.join(busy, "block", "left").withColumn("lane", F.pmod(F.xxhash64("id"), lanes).cast("int")).withColumn("asks", F.lit(1))
    columns = ["block", "lane", "asks", "id", "buckets", "raw"]
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = held.select(columns).unionByName(asks.select(columns)).repartition(max(2 * shuffles, 16), "block", "lane").sortWithinPartitions("block", "lane", "asks")

    def run(batches):
        now, vectors, index, found = None, [], None, []
        for b in batches:
            for block, lane, asking, key, buckets, raw in zip(*(b[c] for c in columns), strict=True):
                if (block, lane) != now:
                    now, vectors, index = (block, lane), [], None
                if not asking:
                    vectors.append((buckets[0], key, raw))
                    continue
                if index is None:
                    index = _Block(vectors, kind)
                found.extend(index.nearest(key, buckets, raw, k))
                if len(found) > 4096:
                    found = _best(found, k)
                    if len(found[0][0]) > PAIRS // 2:
                        yield _frame(found)
                        found = []
        for f in _best(found, k):
            yield _frame([f])

    return met.mapInPandas(run, "query_id long, vec_id long, score double")


def _frame(found) -> pd.DataFrame:
    q, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})


class _Block:
    """The vectors of a block by bucket."""

    def __init__(self, vectors: list[tuple[int, int, bytes]], kind: str):
        self.kind = kind
        buckets = np.array([b for b, *_ in vectors], np.int64)
        order = np.argsort(buckets, kind="stable")
        self.buckets, self.ids = buckets[order], np.array([key for _, key, _ in vectors], np.int64)[order]
        # A table a dimension, and each vector's row in its own.
        self.sizes = np.array([len(raw) for *_, raw in vectors], np.int64)[order]
        self.tables, self.row = {}, np.zeros(len(order), np.int64)
        for size in np.unique(self.sizes).tolist():
            mine = np.flatnonzero(self.sizes == size)
            self.tables[size] = np.frombuffer(b"".join([vectors[n][2] for n in order[mine].tolist()]), kind).reshape(len(mine), -1)
            self.row[mine] = np.arange(len(mine))

    def nearest(self, key: int, buckets, raw: bytes, k: int):
        """The query's nearest among the vectors of the buckets, in bounded steps."""
        asked = np.sort(np.asarray(buckets, np.int64))
        first, last = np.searchsorted(self.buckets, asked, "left"), np.searchsorted(self.buckets, asked, "right")
        widths = last - first
        at = np.repeat(first - np.cumsum(widths) + widths, widths) + np.arange(widths.sum())
        at = at[self.sizes[at] == len(raw)]
        at = at[np.unique(self.ids[at], return_index=True)[1]]
        query = np.frombuffer(raw, self.kind).astype(float)[None, :]
        for a in range(0, len(at), UNIT):
            part = at[a : a + UNIT]
            yield from _nearest(query, np.array([key]), self.tables[len(raw)][self.row[part]].astype(float), self.ids[part], k)


def exact(vectors: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10) -> list[tuple[int, int, int, float]]:
    """Brute force on the driver, for tests and for measuring recall on small tables."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & valid(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))
    asked = {r["id"] for r in rows.where(is_query(F.col("id"))).select("id").collect()}
    held = rows.collect()
    out = []
    for q in held:
        if q["id"] in asked:
            a = np.array(q["v"])
            far = sorted((float(np.sqrt(((a - np.array(r["v"])) ** 2).sum())), r["id"]) for r in held if r["id"] != q["id"] and len(r["v"]) == len(a))
            out.extend((q["id"], n + 1, v, s) for n, (s, v) in enumerate(far[:k]))
    return out
