"""Vectors: centroids, exact nearest, margins, themes and diverse samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurate.functions.stats import cosine, dot, quantised
from murmurate.plans import adapters as A  # noqa: F401  the package's views
from murmurate.registry import register
from murmurate.session import table

ALIKE, MERGED, LEAST_MEMBERS, SAMPLE, POOL = 0.75, 0.9, 3, 3000, 4096


def as_double(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def mean_vector(df: DataFrame, vector: str, *by: str) -> DataFrame:
    """The mean of the vectors of each group, by position, summed in double precision on the map side."""
    cells = df.select(*by, F.posexplode(vector).alias("at", "x"))
    return cells.groupBy(*by, "at").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda c: c["m"]).alias("mean"))


_MEANS = "m AS (SELECT label, list(v ORDER BY i) AS mean FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY label)"
_COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


@register("centroid", "SELECT i - 1 AS at, round(avg(embedding[i]::DOUBLE), 9) AS mean FROM (SELECT DISTINCT embedding FROM embeddings), (SELECT unnest(range(1, 65)) AS i) GROUP BY i")
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of all distinct vectors, position by position."""
    v = table(spark, sf_dir, "embeddings").select("embedding").distinct()
    return v.select(F.posexplode("embedding").alias("at", "x")).groupBy("at").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("mean"))


@register("exact_nearest", f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT v AS q FROM v WHERE vec_id = 7)
SELECT vec_id, round({_COS.format(a='v', b='q')}, 9) AS similarity FROM v, q WHERE vec_id <> 7 AND vec_id % 10 <> 3 ORDER BY similarity DESC, vec_id LIMIT 30""")
def exact_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty nearest to one query, leaving out what a word search found already; a top-k, no sort of all."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", as_double(F.col("embedding")).alias("v"))
    q = v.where("vec_id = 7").select(F.col("v").alias("q")).limit(1)
    found = v.where("vec_id % 10 = 3").select("vec_id")
    rest = v.where("vec_id <> 7").join(found, "vec_id", "left_anti")
    scored = rest.join(F.broadcast(q)).select("vec_id", F.round(cosine(F.col("v"), F.col("q")), 9).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "vec_id").limit(30)


@register("quantised_vectors", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT vec_id, v, 127 / list_max(list_transform(v, lambda x: abs(x))) AS scale FROM v)
SELECT vec_id, round(scale, 6) AS scale, CAST(list_sum(list_transform(v, lambda x: CAST(sign(x) * floor(abs(x * scale) + 0.5) AS BIGINT))) AS BIGINT) AS cell_sum FROM s""")
def quantised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as one byte a cell with a scale; the sum of cells stands for them here."""
    scale, cells = quantised(F.col("embedding"))
    v = table(spark, sf_dir, "embeddings").select("vec_id", scale.alias("scale"), cells.alias("cells"))
    return v.select("vec_id", F.round("scale", 6).alias("scale"), F.aggregate("cells", F.lit(0).cast("long"), lambda s, x: s + x).alias("cell_sum"))


@register("nearest_theme", f"""
WITH {_MEANS}, v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT vec_id, v.label, m.label AS theme, {_COS.format(a='v', b='mean')} AS c FROM v, m),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, theme) AS place FROM s)
SELECT vec_id, theme, round(c, 9) AS closeness, c >= 0.2::DOUBLE AS kept FROM b WHERE place = 1""")
def nearest_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's closest centre (a label's mean), kept if close enough. Centres are a few rows."""
    v = table(spark, sf_dir, "embeddings")
    centres = mean_vector(v, "embedding", "label")
    both = v.select("vec_id", as_double(F.col("embedding")).alias("v")).join(F.broadcast(centres))
    best = both.groupBy("vec_id").agg(F.max(F.struct(cosine(F.col("v"), F.col("mean")).alias("c"), (-F.col("label")).alias("o"))).alias("b"))
    return best.select("vec_id", (-F.col("b.o")).alias("theme"), F.round("b.c", 9).alias("closeness"), (F.col("b.c") >= 0.2).alias("kept"))


@register("rare_margins", f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT vec_id AS qid, label AS ql, v AS q FROM v WHERE vec_id % 25 = 0),
s AS (SELECT vec_id, max({_COS.format(a='v', b='q')}) FILTER (ql < 2) AS rare, max({_COS.format(a='v', b='q')}) FILTER (ql >= 2) AS common FROM v, q WHERE vec_id % 25 <> 0 GROUP BY vec_id)
SELECT vec_id, round(rare - common, 9) AS margin, CAST(trunc((2 - greatest(-2.0::DOUBLE, least(2.0::DOUBLE, round(rare - common, 9)))) * 1000) AS BIGINT) AS key FROM s""")
def rare_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much closer each vector is to its nearest labelled query of a rare subject than to one of a common one."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") < 2).alias("rare"), as_double(F.col("embedding")).alias("v"))
    s = best_by_kind(v.where("vec_id % 25 <> 0"), v.where("vec_id % 25 = 0"))
    df = s.where("of_rare IS NOT NULL AND of_common IS NOT NULL").withColumn("margin", F.round(F.col("of_rare") - F.col("of_common"), 9))
    key = ((2 - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("margin")))) * 1000).cast("long")
    return df.select("vec_id", "margin", key.alias("key"))


#: Vectors and queries that a task holds at once.
ROWS_BLOCK, ASKS_BLOCK = 8192, 2048


def best_by_kind(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(vec_id, of_rare, of_common): each vector's greatest cosine with the queries of either kind.

    Blocks of vectors meet blocks of queries, a product of two bounded tables a task; nothing is broadcast, and a row a
    vector and block of queries comes out.
    """
    many, asks = (max(1, -(-df.count() // size)) for df, size in ((vectors, ROWS_BLOCK), (queries, ASKS_BLOCK)))
    spread = lambda df, own, of, other, over: df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(of)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(over - 1))))
    left, right = spread(vectors, "row_block", many, "ask_block", asks), spread(queries, "ask_block", asks, "row_block", many)

    def product(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"vec_id": [], "of_rare": [], "of_common": []}).astype({"vec_id": "int64", "of_rare": float, "of_common": float})
        near = _units(mine["v"]) @ _units(theirs["v"]).T
        rare = theirs["rare"].to_numpy(bool)
        best = lambda mask: near[:, mask].max(axis=1) if mask.any() else np.full(len(mine), np.nan)
        return pd.DataFrame({"vec_id": mine["vec_id"], "of_rare": best(rare), "of_common": best(~rare)})

    key = ["row_block", "ask_block"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(product, "vec_id long, of_rare double, of_common double")
    top = lambda c: F.max(F.when(~F.isnan(c), F.col(c))).alias(c)
    return met.groupBy("vec_id").agg(top("of_rare"), top("of_common"))


@register("nearest_centroid_baseline", f"""
WITH t AS (SELECT label, list(v ORDER BY i) AS mean FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE vec_id % 4 <> 0 GROUP BY ALL) GROUP BY label),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id % 4 = 0),
s AS (SELECT vec_id, v.label AS truth, t.label AS guess, {_COS.format(a='v', b='mean')} AS c FROM v, t),
p AS (SELECT *, exp(20 * c) / sum(exp(20 * c)) OVER (PARTITION BY vec_id) AS prob, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, guess) AS place FROM s)
SELECT truth, count(*) AS held, count(*) FILTER (truth = guess) AS hit, round(avg(prob), 6) AS confidence FROM p WHERE place = 1 GROUP BY truth""")
def nearest_centroid_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline that picks the closest class centre, with a softmax of sharpness twenty for its confidence."""
    v = table(spark, sf_dir, "embeddings")
    centres = mean_vector(v.where("vec_id % 4 <> 0"), "embedding", "label").select(F.col("label").alias("guess"), "mean")
    s = v.where("vec_id % 4 = 0").select("vec_id", F.col("label").alias("truth"), as_double(F.col("embedding")).alias("v")).join(F.broadcast(centres))
    s = s.select("vec_id", "truth", "guess", cosine(F.col("v"), F.col("mean")).alias("c"))
    best = s.groupBy("vec_id", "truth").agg(F.max(F.struct("c", (-F.col("guess")).alias("o"))).alias("b"), F.sum(F.exp(20 * F.col("c"))).alias("z"))
    best = best.select("truth", (-F.col("b.o")).alias("guess"), (F.exp(20 * F.col("b.c")) / F.col("z")).alias("p"))
    return best.groupBy("truth").agg(F.count(F.lit(1)).alias("held"), F.count_if(F.col("truth") == F.col("guess")).alias("hit"), F.round(F.avg("p"), 6).alias("confidence"))


@register("theme_links", f"""
WITH {_MEANS}
SELECT a.label AS theme, b.label AS other, round({_COS.format(a='a.mean', b='b.mean')}, 9) AS closeness FROM m a JOIN m b ON a.label < b.label WHERE {_COS.format(a='a.mean', b='b.mean')} >= 0.0::DOUBLE""")
def theme_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of themes whose centres are close; themes are a few rows."""
    m = mean_vector(table(spark, sf_dir, "embeddings"), "embedding", "label")
    o = m.select(F.col("label").alias("other"), F.col("mean").alias("theirs"))
    c = cosine(F.col("mean"), F.col("theirs"))
    return m.join(F.broadcast(o), F.col("label") < F.col("other")).where(c >= 0).select(F.col("label").alias("theme"), "other", F.round(c, 9).alias("closeness"))


def _units(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def communities(units: np.ndarray, alike: float = ALIKE, merged: float = MERGED, least: int = LEAST_MEMBERS) -> list[list[int]]:
    """Greedy groups: seeds by most close neighbours, each taking those not taken yet; then groups of near centres join, the closest pair first."""
    near = units @ units.T >= alike
    free, groups = np.ones(len(units), bool), []
    for seed in np.lexsort((np.arange(len(units)), -near.sum(axis=1))):
        if free[seed]:
            members = np.flatnonzero(near[seed] & free)
            if len(members) >= least:
                free[members] = False
                groups.append(members.tolist())
    centre = [_centre(units, g) for g in groups]
    while len(groups) > 1:
        close = np.array(centre) @ np.array(centre).T
        close[np.tril_indices(len(groups))] = -2
        a, b = divmod(int(np.argmax(close)), len(groups))
        if close[a, b] < merged:
            break
        groups[a] = groups[a] + groups[b]
        centre[a] = _centre(units, groups[a])
        del groups[b], centre[b]
    return groups


def _centre(units: np.ndarray, members: list[int]) -> np.ndarray:
    total = units[members].sum(axis=0)
    return total / max(float(np.linalg.norm(total)), 1e-300)


def themes(df: DataFrame, by: list[str], key: str, vector: str, alike: float = ALIKE, sample: int = SAMPLE) -> DataFrame:
    """Themes of each group over the ``sample`` keys of smallest hash: (by, theme, key, closeness)."""
    order = F.row_number().over(W.partitionBy(*by).orderBy(F.sha2(F.col(key).cast("string"), 256), key))
    few = df.select(*by, key, vector).withColumn("place", order).where(F.col("place") <= sample)
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"{b} {kinds[b]}" for b in by], "theme int", f"{key} {kinds[key]}", "closeness double"])

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place").reset_index(drop=True)
        units = _units(rows[vector])
        out = []
        for n, members in enumerate(communities(units, alike)):
            centre = _centre(units, members)
            out += [(*[rows[b].iloc[0] for b in by], n, rows[key].iloc[m], float(units[m] @ centre)) for m in members]
        return pd.DataFrame(out, columns=[*by, "theme", key, "closeness"])

    return few.groupBy(*by).applyInPandas(find, schema)


@register("themes_of_vectors")
def themes_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of alike vectors within each label."""
    return themes(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding", alike=0.25)


def farthest_first(df: DataFrame, key: str, vector: str, wanted: int, pool: int = POOL, seed: int = 1) -> DataFrame:
    """The most diverse few of a bounded pool by hash rank: each next one is the farthest from all picked."""
    from murmurate.operators.sampling import hash_rank

    few = df.select(key, vector).withColumn("rank", hash_rank(seed, "distinct", F.col(key))).orderBy("rank").limit(pool)
    kind = dict(df.dtypes)[key]

    def pick(batches):
        rows = pd.concat(list(batches), ignore_index=True).sort_values("rank").reset_index(drop=True)
        if not len(rows):
            return
        units = _units(rows[vector])
        near = np.full(len(rows), -2.0)
        picked, novelty, at = [], [], 0
        for _ in range(min(wanted, len(rows))):
            picked.append(at)
            novelty.append(1.0 if near[at] == -2 else 1.0 - near[at])
            near = np.maximum(near, units @ units[at])
            near[picked] = 2
            at = int(np.argmin(near))
        yield pd.DataFrame({"place": np.arange(1, len(picked) + 1), key: rows[key].to_numpy()[picked], "novelty": novelty})

    return few.repartition(1).mapInPandas(pick, f"place int, {key} {kind}, novelty double")


@register("diverse_sample")
def diverse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty vectors far from each other."""
    return farthest_first(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 40)


@register("vectors_held", "SELECT label, count(*) AS vectors, CAST(sum(len(embedding)) * 4 AS BIGINT) AS bytes, round(avg(sqrt(list_dot_product(v, v))), 6) AS mean_length FROM (SELECT *, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) GROUP BY label")
def vectors_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors each label has, and their size."""
    v = table(spark, sf_dir, "embeddings")
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), (F.sum(F.size("embedding")) * 4).alias("bytes"), F.round(F.avg(F.sqrt(dot(F.col("embedding"), F.col("embedding")))), 6).alias("mean_length"))
