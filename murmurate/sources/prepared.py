"""Prepared data beside a capture: vectors of claims and reviews, reports that hold while what they came from does, training rows, fold logits.

Vectors are made by any function of texts (``embed``) and written under the pins of the encoder that made them; only
parts with the pins in hand are read. Preparing again makes what is missing, by key, and nothing twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurate.functions.stats import quantised

#: embed(texts) -> one vector a text.
Embed = Callable[[list[str]], list[list[float]]]
#: Texts that are sorted by length before they are cut into batches.
WINDOW = 16_384
TRAINING = ("text string, review string, review_offset long, headset_only boolean, subject string, polarity string, confidence string, ambiguous boolean, ironic boolean, split_wrong boolean, "
            "also array<struct<subject:string,polarity:string>>, produced_by string, language string, app_id long, review_id string, claim_index int, subset string")
#: What a training row has where its file says nothing; fixed values.
DEFAULTS = {"polarity": "neutral", "confidence": "medium", "subset": "stratified", "ambiguous": False, "ironic": False, "split_wrong": False}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, target, fs = _fs(spark, path)
    return fs.exists(target)


def pins_of(pins: dict[str, str]) -> Column:
    """What names an encoder, as one text."""
    return F.lit(json.dumps(pins, sort_keys=True))


def embedded(df: DataFrame, text: str, embed: Embed, name: str = "vector", batch: int = 256) -> DataFrame:
    """df with the vector of each text, by Arrow batches; a batch's texts go to the model in order of length, so that padding wastes little."""
    schema = ", ".join([*[f"`{c}` {k}" for c, k in df.dtypes], f"{name} array<float>"])

    def run(batches):
        for b in batches:
            order = np.argsort(b[text].str.len().to_numpy(), kind="stable")
            found: list = [None] * len(b)
            for a in range(0, len(order), batch):
                part = order[a : a + batch]
                for at, vector in zip(part.tolist(), embed(b[text].iloc[part].tolist()), strict=True):
                    found[at] = [float(x) for x in vector]
            yield b.assign(**{name: found})

    return df.mapInPandas(run, schema)


def pooled(hidden: np.ndarray, mask: np.ndarray, first: bool = False) -> np.ndarray:
    """Unit vectors from a model's last states (rows, tokens, cells): the mean over unmasked tokens, or the first token's."""
    out = hidden[:, 0] if first else (hidden * mask[:, :, None]).sum(axis=1) / np.maximum(1, mask.sum(axis=1))[:, None]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def claim_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def write_claim_vectors(claims: DataFrame, folder: str, embed: Embed, pins: dict[str, str]) -> int:
    """Adds int8 vectors of claims whose text has none under these pins; returns how many. claims: recommendationid, start, end, claim, subject, polarity, confidence."""
    spark = claims.sparkSession
    df = claims.withColumn("key", claim_key(F.col("claim")))
    if exists(spark, folder):
        df = df.join(claim_vectors(spark, folder, pins).select("key", "recommendationid", "start"), ["key", "recommendationid", "start"], "left_anti")
    once = embedded(df.select("key", "claim").dropDuplicates(["key"]), "claim", embed).drop("claim")
    scale, cells = quantised(F.col("vector"))
    once = once.select("key", scale.cast("float").alias("scale"), cells.alias("vector"))
    before = claim_vectors(spark, folder, pins).count() if exists(spark, folder) else 0
    out = df.join(once, "key").select("key", "recommendationid", "start", "end", "subject", "polarity", "confidence", "scale", "vector", pins_of(pins).alias("pins"))
    out.write.mode("append").parquet(folder)
    return claim_vectors(spark, folder, pins).count() - before


def claim_vectors(spark: SparkSession, folder: str, pins: dict[str, str]) -> DataFrame:
    """Claim vectors that the encoder in hand made."""
    return spark.read.parquet(folder).where(F.col("pins") == pins_of(pins)).drop("pins")


def preparation(claims: DataFrame, folder: str, pins: dict[str, str]) -> str:
    """``none``, ``stale`` (another encoder's only), ``partial`` or ``ready``."""
    spark = claims.sparkSession
    if not exists(spark, folder):
        return "none"
    held = claim_vectors(spark, folder, pins).select("key").distinct()
    if not held.limit(1).count():
        return "stale"
    missing = claims.select(claim_key(F.col("claim")).alias("key")).join(held, "key", "left_anti")
    return "partial" if missing.limit(1).count() else "ready"


def write_review_vectors(reviews: DataFrame, path: str, embed: Embed, app_id: int, model: str) -> None:
    """One vector a distinct text, with how many reviews have it. reviews: text."""
    texts = reviews.where(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n_reviews"))
    out = embedded(texts, "text", embed, "embedding").drop("text")
    out.select("text_sha256", F.lit(app_id).cast("long").alias("appid"), "n_reviews", F.lit(model).alias("model"), "embedding").write.mode("overwrite").parquet(path)


def review_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("text_sha256", "n_reviews", "embedding")


def vectors_for(reviews: DataFrame, vectors: DataFrame, ids: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, embedding) of some reviews, by way of their text's hash; reviews of one text share a vector."""
    named = reviews.join(ids, key, "left_semi").select(key, F.sha2(text, 256).alias("text_sha256"))
    return named.join(vectors, "text_sha256").select(key, "embedding")


def write_report(df: DataFrame, path: str, pins: dict[str, str]) -> None:
    """A report's rows as JSON, with what they were made from."""
    df.withColumn("pins", pins_of(pins)).write.mode("overwrite").json(path)


def current_report(spark: SparkSession, path: str, schema: str, pins: dict[str, str], source: str | None = None) -> DataFrame | None:
    """A report's rows, or None where there is none, it has other pins, or files of ``source`` are newer than it."""
    if not exists(spark, path):
        return None
    files = spark.read.schema(f"{schema}, pins string").json(path)
    if source is not None:
        newest = lambda df: df.agg(F.max("_metadata.file_modification_time").alias("t"))
        made, since = newest(files).first()["t"], newest(spark.read.format("binaryFile").load(source)).first()["t"]
        if made is None or (since is not None and since > made):
            return None
    if files.where(F.col("pins") != pins_of(pins)).limit(1).count():
        return None
    return files.drop("pins")


def newer_than(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Files of a source that changed after the newest file of an export; their contents are not read."""
    at = lambda p: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select("path", "modificationTime")
    made = at(path).agg(F.max("modificationTime").alias("made"))
    return at(source).join(F.broadcast(made)).where(F.col("modificationTime") > F.col("made")).select("path")


def storage_totals(spark: SparkSession, root: str) -> DataFrame:
    """Files and bytes below a library by game and kind of file; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    game = F.regexp_extract("path", r"appid=(\d+)", 1)
    kind = F.regexp_extract(F.regexp_extract("path", r"([^/]+)$", 1), r"^([a-z]+)", 1)
    return files.groupBy(game.alias("game"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def write_training(rows: DataFrame, path: str) -> None:
    """Labelled claims as lines of JSON; rows that say nothing, were cut wrong or have no text are held back."""
    kept = rows.where(F.col("text").isNotNull() & (F.trim("text") != "") & ~F.coalesce(F.col("split_wrong"), F.lit(False)))
    kept.write.mode("overwrite").json(path)


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    """Labelled claims with defaults where a file says nothing."""
    df = spark.read.schema(TRAINING).json(path)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()})


def pooled_folds(logits: DataFrame, width: int) -> DataFrame:
    """Held-out logits of all folds (fold, app_id, review_id, claim_index, truth, logits) as one table; refused where a game is in two folds or widths differ."""
    twice = logits.groupBy("app_id").agg(F.countDistinct("fold").alias("folds")).where("folds > 1").limit(1).collect()
    if twice:
        raise ValueError(f"game {twice[0]['app_id']} is in {twice[0]['folds']} folds")
    if logits.where(F.size("logits") != width).limit(1).count():
        raise ValueError(f"logits of another width than {width}")
    return logits.withColumn("predicted", F.array_position("logits", F.array_max("logits")) - 1)


def length_batches(df: DataFrame, text: str, number: Column, batch: int = 256, window: int = WINDOW) -> DataFrame:
    """df with ``batch``: rows of each window of ``number`` (a running number from 0) in order of length, a size at a time."""
    from pyspark.sql import Window as W

    at = F.floor(number / window)
    place = F.row_number().over(W.partitionBy("window").orderBy(F.length(text), number)) - 1
    return df.withColumn("window", at).withColumn("batch", F.floor(place / batch))
