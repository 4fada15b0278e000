"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features of a text are its words, its pairs of neighbouring words, and the same of word shapes (letters in upper
or lower case, digits and each mark, runs as one), all hashed into ``buckets`` weights; a feature's value is its
share of the n-grams of its kind. A text's score is the logistic of a sparse dot product.

Training takes at most ``sample`` labelled documents (a documented bound), the smallest by a hash of the id, so it
costs the same at any size. Their hashed features are written once, in short pieces; one task then reads them in a fixed mixed order,
epoch after epoch, as Spark sorts and spills them, and holds one example and the model. Scoring is one pass over the
whole texts with no shuffle; each task's memory holds one batch, the weights and a bounded cache of hashes of short words.

Defined cases: null and empty texts get the score of the bias alone; labels that are null or of unlabelled
documents are left out; repeated labels of a document each count; without any label every score is 0.5; columns
other than the named ones are ignored by the scores.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .memo import Memo
from .scratch import stored

BUCKETS = 1 << 18
SAMPLE = 6000
EPOCHS = 4
#: Entries in each generation of a worker's memo of word hashes.
CACHE_ENTRIES = 120_000
#: Longer words are hashed each time, so that the memo's bytes are bounded too.
CACHED_WORD = 64
#: Buckets of an example in a row of the training table.
PIECE = 1024
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.0005, 0.001
#: The bias where all labels are alike.
CONFIDENT = 1.0

_SPLIT = re.compile(r"[\x20\x09-\x0D]+")
_RUNS = re.compile(r"(.)\1+")
PRIME = 0x9E3779B97F4A7C15
_PRIME = np.uint64(PRIME)


def shape(word: str) -> str:
    """A word's outline: A for capitals, a for other letters, 0 for digits, marks as they are; runs as one."""
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUNS.sub(r"\1", out)


def _hashes(word: str) -> int:
    """A word's hash and its shape's hash in one number."""
    data, outline = word.encode("utf-8", "surrogatepass"), shape(word).encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 32 | zlib.crc32(b"#" + outline)


_HASHES = Memo(_hashes, CACHE_ENTRIES)


def features(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value) of every n-gram of a text, repeats included."""
    words = [w for w in _SPLIT.split(text) if w] if text else []
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    both = np.fromiter((_HASHES[w] if len(w) <= CACHED_WORD else _hashes(w) for w in words), np.uint64, len(words))
    parts = []
    for salt, one in enumerate((both >> np.uint64(32), both & np.uint64(0xFFFFFFFF))):
        one = one + np.uint64(salt << 33)
        parts.append(one * _PRIME)
        parts.append((one[:-1] * _PRIME ^ (one[1:] + np.uint64(1 << 40))) * _PRIME)
    at = np.concatenate(parts) >> np.uint64(64 - (buckets - 1).bit_length())
    value = np.concatenate([np.full(len(p), 1.0 / max(1, len(p))) for p in parts])
    return at.astype(np.int64), value


def merged(at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket once, with the sum of its values."""
    kinds, where = np.unique(at, return_inverse=True)
    return kinds, np.bincount(where, weights=value, minlength=len(kinds))


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss; the last weight is the bias."""

    def __init__(self, buckets: int = BUCKETS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(buckets + 1), np.zeros(buckets + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, value: np.ndarray, label: int, importance: float = 1.0) -> None:
        at, value = np.append(at, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        g = (logistic(float(w @ value)) - label) * importance * value
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def one_sided(counts: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """The weights where a label is missing: the bias says which; 0 where both are."""
    weights = np.zeros(buckets + 1)
    if any(counts.values()):
        weights[-1] = CONFIDENT if counts.get(1) else -CONFIDENT
    return weights


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        learn=None, buckets: int = BUCKETS, sample: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learned from the labelled rows whose id passes ``learn`` (a function of the id column)."""
    marked = labels.select(F.col(doc_id).alias("l_id"), F.col(label).cast("int").alias("y")).where("y IN (0, 1) AND l_id IS NOT NULL")
    if learn is not None:
        marked = marked.where(learn(F.col("l_id")))
    # A balanced draw: up to half the sample of either label. Ranks are cut on the map side before the shuffle.
    draw = F.md5(F.concat(F.lit("fit:"), F.col("l_id").cast("string")))
    halves = [marked.where(F.col("y") == y).orderBy(draw, "l_id").limit(sample // 2) for y in (0, 1)]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    chosen = rows.join(halves[0].unionByName(halves[1]), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "y")

    chosen = chosen.select(F.col("doc_id").cast("string").alias("key"), "text", "y", F.monotonically_increasing_id().alias("row"))

    def hashed(batches):
        for b in batches:
            for key, text_, y, row in zip(b["key"], b["text"], b["y"], b["row"], strict=True):
                at, value = merged(*features(text_, buckets))
                pieces = range(0, max(1, len(at)), PIECE)
                yield pd.DataFrame({"key": key, "y": y, "row": row, "crc": zlib.crc32(at.astype("<i4").tobytes()), "part": range(len(pieces)), "parts": len(pieces),
                                    "at": [at[k : k + PIECE].astype("<i4").tobytes() for k in pieces], "value": [value[k : k + PIECE].astype("<f4").tobytes() for k in pieces]})

    found = stored(chosen.mapInPandas(hashed, "key string, y int, row long, crc long, part int, parts int, at binary, value binary"), "training-examples")
    counts = {r["y"]: r["n"] for r in found.where("part = 0").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    if len(counts) < 2:
        return one_sided(counts, buckets)
    # Both labels weigh alike in sum.
    importance = {y: sum(counts.values()) / (2.0 * n) for y, n in counts.items()}

    def learned(batches):
        model, held = Ftrl(buckets), []
        for b in batches:
            for y, part, parts, at, value in zip(b["y"], b["part"], b["parts"], b["at"], b["value"], strict=True):
                held.append((np.frombuffer(at, "<i4"), np.frombuffer(value, "<f4")))
                if part == parts - 1:
                    model.update(np.concatenate([a for a, _ in held]), np.concatenate([v for _, v in held]), int(y), importance[int(y)])
                    held = []
        yield pd.DataFrame({"weights": [model.weights().astype("<f8").tobytes()]})

    mixed = found.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn(
        "draw", F.md5(F.concat_ws(":", "epoch", "key", "y", "crc")))
    mixed = mixed.repartition(1).sortWithinPartitions("epoch", "draw", "row", "part").select("y", "part", "parts", "at", "value")
    rows = mixed.mapInPandas(learned, "weights binary").collect()  # one row, of the model's size
    return np.frombuffer(bytes(rows[0]["weights"]), "<f8").copy()


def scorer(weights: np.ndarray):
    """text -> score, with the weights bound."""
    bias, table, buckets = float(weights[-1]), weights[:-1], len(weights) - 1

    def score(text: str | None) -> float:
        at, value = features(text, buckets)
        return float(logistic(float(table[at] @ value) + bias))

    return score


def score_of(spark: SparkSession, weights: np.ndarray, text: Column) -> Column:
    """The score of a text column."""
    sent = spark.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        score = scorer(sent.value.astype(np.float64))
        return pd.Series([score(t) for t in texts], dtype=float)

    return scores(text)


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score", least: float | None = None) -> DataFrame:
    """docs with a score column; with ``least`` given, only rows that reach it and no new column."""
    if least is None:
        return docs.withColumn(name, score_of(docs.sparkSession, weights, F.col(text)))
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("boolean")
    def reaches(texts: pd.Series) -> pd.Series:
        score = scorer(sent.value.astype(np.float64))
        return pd.Series([score(t) >= least for t in texts], dtype=bool)

    return docs.where(reaches(F.col(text)))


def learnable(remainder: int, modulus: int):
    """Ids whose crc32, as text, leaves another remainder than the held-out one."""
    return lambda key: F.crc32(key.cast("string")) % modulus != remainder


def held_out(key, remainder: int, modulus: int):
    """Whether an id is held out; null ids are not."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == remainder, F.lit(False))
