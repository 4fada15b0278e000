"""Best-fit packing of tokenised documents into sequences under several capacities at once.

A document's tokens are its ids and one end id. Longer documents than a sequence are cut into full pieces, the
first being the shorter one. Pieces are packed by vector best fit: a bin has residual tokens, documents and
attention cost (the sum of squared piece lengths); a piece goes to the bin that it fits in under every capacity
and that scores best, by the weighted dot product of demand and residual or by the norm of what would be left.

Scale: a piece's demand depends on its length alone, so the packing is planned on the histogram of lengths, at
most ``capacity`` numbers however many documents there are, and alike bins are planned together. The plan is a
list of runs (length, first rank, bin, offset); pieces are ranked within their length by counts of blocks of
documents, summed in two levels, and looked up in the plan. Equal pieces are ranked as one row with a count. No bin is a group that some task has to hold, and copies of one length are
spread over all tasks. The plan's size depends on the capacities, not on the number of rows.

Tokens come from the byte-level BPE vocabulary, whole texts at a time: by its ranks, which is faster, or by the
tokenizer file itself where a text holds the string of a special token, which the file reads as that token.

Defined cases: null text is empty, one piece of the end id alone; repeated rows and null ids are packed like any
other row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import sys
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import stored

CAPACITY = 1024
END_ID = 2
#: Pieces of one length in a block that is ranked together; a busy length has as many blocks as it needs.
BLOCK_ROWS = 500
#: Blocks whose counts are summed together.
SPAN = 4096


def as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class Encoder:
    """Token ids of whole texts as little-endian bytes, alike to the tokenizer file's own encoding."""

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return as_bytes(self.whole.encode(text, add_special_tokens=False).ids)
        return as_bytes(self.bpe.encode_ordinary(text))


@lru_cache(maxsize=2)
def encoder(tokenizer: str, ranks: str, pattern: str) -> Encoder:
    return Encoder(tokenizer, ranks, pattern)


def public_encoder_files() -> tuple[str, str, str]:
    """The default vocabulary: tokenizer file, the same merges as ranks, and the splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: full ones, preceded by the shorter rest."""
    first = length % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, length, capacity)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, n_tokens long"


def pieces_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
              end_id: int = END_ID, files: tuple[str, str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every document; with_ids adds their ids as an array."""
    files = files or public_encoder_files()
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches):
        enc = encoder(*files)
        for batch in batches:
            out = defaultdict(list)
            for key, body in zip(batch["doc_id"], batch["text"], strict=True):
                ids = (enc.encode(body) if body else b"") + end
                n = len(ids) // 4
                for k, (start, length) in enumerate(cuts(n, capacity)):
                    held = ids[4 * start : 4 * (start + length)]
                    for name, value in (("doc_id", key), ("piece", k), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(held)), ("n_tokens", n)):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(np.frombuffer(held, dtype="<u4").astype(np.int32))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids)
            yield frame.astype({"doc_id": "Int64", "piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64", "n_tokens": "int64"})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(pieces, PIECES + (", ids array<int>" if with_ids else ""))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, documents: int | None = None, attention: int | None = None,
         weights: tuple[float, float, float] = (1.0, 0.001, 0.001), score: str = "dot") -> list[tuple[int, int, int, int, int]]:
    """Packs ``histogram`` (length to count): runs (length, first rank, first bin, offset, count).

    Longest first. Alike bins (same residuals) are held as runs of bin numbers and filled together. Among the bins
    that a piece fits in, the best has, for score "dot", the smallest weighted dot product of the piece's demand and
    what the bin has left after it; for "norm", the smallest weighted norm of what is left. All in shares of the
    whole capacities; ties go to the bin with fewer tokens left.
    """
    documents = capacity if documents is None else documents
    attention = capacity * capacity if attention is None else attention
    if documents < 1 or any(n and (k > capacity or k * k > attention) for k, n in histogram.items()):
        raise ValueError("a piece fits in no sequence")
    w = np.array(weights, dtype=float)
    whole = np.array([capacity, documents, attention], dtype=float)
    kinds: dict[tuple[int, int, int], list[list[int]]] = {}  # residuals to runs [first bin, count, offset]
    runs, bins = [], 0
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0
        demand = np.array([length, 1, length * length], dtype=float)
        while left:
            fits = [k for k in kinds if k[0] >= length and k[1] >= 1 and k[2] >= length * length]
            if fits:
                table = np.array(fits, dtype=float)
                after = (table - demand) / whole
                if score == "norm":
                    value = np.sqrt((w * after * after).sum(axis=1))
                else:
                    value = (w * (demand / whole) * after).sum(axis=1)
                kind = fits[int(np.lexsort((table[:, 0], value))[0])]
                found = kinds[kind]
            else:
                kind, found = (capacity, documents, attention), [[bins, left, 0]]
                # New bins: as many as these pieces need, each to be filled with as many of them as fit.
                each = min(capacity // length, documents, attention // (length * length))
                need = -(-left // each)
                found = kinds.setdefault(kind, [])
                found.append([bins, need, 0])
                bins += need
            rest = (kind[0] - length, kind[1] - 1, kind[2] - length * length)
            while found and left:
                first, count, offset = found[-1]
                take = min(count, left)
                runs.append((length, rank, first, offset, take))
                target = kinds.setdefault(rest, [])
                target.append([first, take, offset + length])
                rank, left = rank + take, left - take
                if take == count:
                    found.pop()
                else:
                    found[-1] = [first + take, count - take, offset]
            if not found:
                kinds.pop(kind, None)
    return runs


def pack(docs: DataFrame, capacity: int = CAPACITY, documents: int | None = None, attention: int | None = None,
         score: str = "dot", block_rows: int = BLOCK_ROWS, **named) -> DataFrame:
    """The pieces with sequence_id and offset."""
    held = stored(pieces_of(docs, capacity=capacity, **named), "pieces")
    spark = docs.sparkSession
    lengths = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs = plan(lengths, capacity, documents, attention, score=score)
    blocks = F.lit([max(1, -(-lengths.get(k + 1, 0) // block_rows)) for k in range(capacity)])

    # Rank within a length: pieces of earlier blocks, then the place in the block. Equal pieces of equal rows are one row with a count.
    held = held.groupBy("doc_id", "piece", "start", "length", "ids_crc32", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    held = held.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(blocks, F.col("length").cast("int") - 1)))
    counts = stored(held.groupBy("length", "block").agg(F.sum("n").alias("n")).withColumn("span", F.floor(F.col("block") / SPAN)), "piece-counts")
    above = lambda *key: W.partitionBy("length", *key).rowsBetween(W.unboundedPreceding, -1)
    spans = counts.groupBy("length", "span").agg(F.sum("n").alias("n"))
    spans = spans.select(F.col("length").alias("s_length"), F.col("span").alias("s_span"), F.coalesce(F.sum("n").over(above().orderBy("span")), F.lit(0)).alias("base"))
    counts = counts.join(spans, (F.col("length") == F.col("s_length")) & (F.col("span") == F.col("s_span")))
    carry = F.col("base") + F.coalesce(F.sum("n").over(above("span").orderBy("block")), F.lit(0))
    counts = counts.select(F.col("length").alias("c_length"), F.col("block").alias("c_block"), carry.alias("carry"))
    place = F.coalesce(F.sum("n").over(above("block").orderBy("doc_id", "piece", "ids_crc32", "start")), F.lit(0))
    ranked = held.withColumn("place", place).join(
        counts, (F.col("length") == F.col("c_length")) & (F.col("block") == F.col("c_block")))
    ranked = ranked.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("rank", F.col("carry") + F.col("place") + F.col("copy"))

    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(table)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, n_tokens long"

    def look_up(batches):
        t = sent.value
        starts = t[:, 0] * (1 << 44) + t[:, 1]
        for b in batches:
            at = np.searchsorted(starts, b["length"].to_numpy() * (1 << 44) + b["rank"].to_numpy(), side="right") - 1
            b["sequence_id"] = t[at, 2] + b["rank"].to_numpy() - t[at, 1]
            b["offset"] = t[at, 3]
            b["doc_id"] = b["doc_id"].astype("Int64")
            yield b[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "n_tokens"]]

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "n_tokens", "rank").mapInPandas(look_up, schema)
