"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint has a bit set if over half of the text's shingle hashes have it. Fingerprints that differ in at most
``distance`` bits link, and documents of linked fingerprints form a component.

The index: the 64 bits are cut into ``blocks`` blocks, and fingerprints are grouped by the masked pattern of every
choice of blocks - distance blocks; two fingerprints within the distance agree on at least one choice whole, so no
link is lost. These patterns are the upper nodes of the index. Within a group fingerprints are sorted by Gray
rank, runs of neighbours share the bits on which they agree, factored into nodes above them, and so on up to the
group's node. A search adds the differences on each node's newly shared bits on its way down and drops a whole
group of fingerprints once they pass the distance.

Scale: equal fingerprints are one entry, so exact copies cost nothing. ``blocks`` grows with the number of
distinct fingerprints, which keeps groups small (5 choices of 12 bits, 15 of 21, 35 of 27, 70 of 32); results are
the same for each. A group over ``unit`` entries is cut into parts and searched a pair of parts at a time, so that
no task holds an unbounded group. A task returns a spanning forest of the links it finds, never all pairs.
Components are joined by rounds of stars, with each round written to the shared folder.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle make
one shingle; repeated rows fall into one component; a null id is ignored as a component's name unless it has no
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, joined
from .scratch import stored
from .words import md5_long, own_name, text_or_empty

SHINGLE = 4
SEED = 42
DISTANCE = 4
FANOUT = 16
UNIT = 4096
#: Distinct fingerprints a group may hold on average before more blocks are used.
CROWD = 256
#: Rows of a search's frontier held at once.
FRONTIER = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        one = xxhash.xxh64_intdigest
        hashes = [one(line[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    h = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 16384):
        counts += np.unpackbits(h[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, *also) -> DataFrame:
    """(doc_id, fp, also): fingerprints as signed longs, one row a row of docs."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(doc_id).alias("doc_id"), fp(F.col(text)).alias("fp"), *also)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the reflected Gray sequence."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayIndex:
    """The hierarchical index over fingerprints of many groups at once.

    codes must be sorted by group and Gray rank; first has the start of each group. Each level has, for every
    node, its pattern, the bits it newly shares, and its first child and number of children on the level below.
    """

    def __init__(self, codes: np.ndarray, first: np.ndarray, fanout: int = FANOUT):
        self.codes = codes
        bounds = np.append(first, len(codes))
        pattern, shared = codes, np.full(len(codes), ~np.uint64(0))
        self.levels = []  # from the leaves up: (pattern, shared bits, first child, children)
        self.levels.append([pattern, shared, None, None])
        while len(pattern) > len(first):
            sizes = np.diff(bounds)
            nodes = -(-sizes // fanout)
            starts = np.concatenate([np.arange(n) * fanout + b for n, b in zip(nodes.tolist(), bounds[:-1].tolist(), strict=True)]) if len(nodes) < 64 else self._starts(bounds, nodes, fanout)
            above = pattern[starts]
            widths = np.diff(np.append(starts, len(pattern)))
            differ = np.bitwise_or.reduceat((pattern ^ np.repeat(above, widths)) | ~shared, starts)
            pattern, shared = above, ~differ
            self.levels.append([pattern, shared, starts, widths])
            bounds = np.concatenate(([0], np.cumsum(nodes)))
        # Bits that a node above shares already are not counted again below.
        for upper, lower in zip(self.levels[:0:-1], self.levels[-2::-1], strict=True):
            lower.append(lower[1] & ~np.repeat(upper[1], upper[3]))
        self.levels[-1].append(self.levels[-1][1])

    @staticmethod
    def _starts(bounds: np.ndarray, nodes: np.ndarray, fanout: int) -> np.ndarray:
        group = np.repeat(np.arange(len(nodes)), nodes)
        within = np.arange(nodes.sum()) - np.repeat(np.cumsum(nodes) - nodes, nodes)
        return bounds[:-1][group] + within * fanout

    def search(self, queries: np.ndarray, roots: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(query's place in queries, leaf) of all codes within the distance, each query below its root."""
        who, node = np.arange(len(queries)), roots
        spent = np.zeros(len(queries), np.uint8)
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, _, first, width, fresh = self.levels[depth]
            spent = spent + np.bitwise_count((queries[who] ^ pattern[node]) & fresh[node])
            near = spent <= distance
            who, node, spent = who[near], node[near], spent[near]
            if depth:
                times = width[node]
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                who, spent, node = np.repeat(who, times), np.repeat(spent, times), np.repeat(first[node], times) + step
        return who, node


def forest(codes: np.ndarray, groups: np.ndarray, distance: int = DISTANCE, fanout: int = FANOUT) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, within each group, all codes connected by steps of at most the distance: (code, code)."""
    order = np.lexsort((gray_rank(codes), groups))
    codes, groups = codes[order], groups[order]
    first = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    sizes = np.diff(np.append(first, len(codes)))
    index = GrayIndex(codes, first, fanout)
    root = np.repeat(np.arange(len(first)), sizes)
    labels, cost = np.arange(len(codes)), np.cumsum(np.repeat(sizes, sizes))
    at = 0
    while at < len(codes):
        upto = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + FRONTIER, side="right")))
        who, leaf = index.search(codes[at:upto], root[at:upto], distance)
        later = leaf > who + at
        labels = joined(labels, who[later] + at, leaf[later])
        at = upto
    apart = labels != np.arange(len(codes))
    return codes[apart], codes[labels[apart]]


def block_masks(blocks: int, distance: int) -> list[int]:
    """The masks of every choice of blocks - distance blocks, as signed 64-bit numbers."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - distance):
        mask = sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def blocks_for(count: int, distance: int, crowd: int = CROWD) -> int:
    """The fewest blocks that keep groups of random fingerprints at ``crowd`` on average; twice the distance at most."""
    for blocks in range(distance + 1, 2 * distance + 1):
        if count >> (64 * (blocks - distance) // blocks) <= crowd:
            return blocks
    return max(distance + 1, 2 * distance)


def links(unique: DataFrame, count: int, distance: int = DISTANCE, unit: int = UNIT, blocks: int | None = None) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp) that connect all within the distance."""
    masks = block_masks(blocks or blocks_for(count, distance), distance)
    keyed = unique.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "pattern"))
    crowded = keyed.groupBy("choice", "pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > unit)
    crowded = crowded.select(F.col("choice").alias("c"), F.col("pattern").alias("p"), F.ceil(F.col("n") / F.lit(unit // 2)).cast("int").alias("parts"))
    dealt = keyed.join(crowded, (F.col("choice") == F.col("c")) & (F.col("pattern") == F.col("p")), "left")
    parts = F.coalesce("parts", F.lit(1))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    key = ["choice", "pattern", "low", "high"]
    dealt = dealt.select("fp", "choice", "pattern", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    size = int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(max(size, count * len(masks) // 200_000), *key).sortWithinPartitions(*key)

    def found(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held) < 20_000:
                continue
            last = (held[key] == held[key].iloc[-1]).all(axis=1).to_numpy()
            if not last.all():
                yield from linked(held[~last])
                held = held[last].reset_index(drop=True)
        if held is not None and len(held):
            yield from linked(held)

    def linked(rows):
        fresh = np.ones(len(rows), bool)
        if len(rows) > 1:
            fresh[1:] = (rows[key].to_numpy()[1:] != rows[key].to_numpy()[:-1]).any(axis=1)
        a, b = forest(rows["fp"].to_numpy(np.int64).view(np.uint64), np.cumsum(fresh), distance)
        if len(a):
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.mapInPandas(found, "a long, b long")


def _rooted(fps: DataFrame, least, distance: int, unit: int) -> DataFrame:
    """(fp, root, least): each distinct fingerprint with its component's root and the least of its documents."""
    unique = stored(fps.groupBy("fp").agg(least.alias("least")), "fingerprints-distinct")
    count = unique.count()
    roots = components(links(unique, count, distance, unit))
    return unique.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def components_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                  seed: int = SEED, distance: int = DISTANCE, unit: int = UNIT) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id among the documents of linked fingerprints."""
    fps = stored(fingerprints(docs, doc_id, text, shingle, seed), "fingerprints")
    named = _rooted(fps, F.min("doc_id"), distance, unit)
    # Written, so that a component with most of the fingerprints can be split when it is joined.
    least = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "component-names")
    named = named.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                 seed: int = SEED, distance: int = DISTANCE, unit: int = UNIT) -> DataFrame:
    """One document of each component, with the columns of docs.

    A document is an id and a text: the one of smallest id is kept and, of several texts of that id, the one of smallest
    hash. Rows without an id are kept only if their component has no id at all. Of rows that repeat both id and text one stays.
    """
    at, hashed = own_name(docs.columns, "dedup_id"), own_name(docs.columns, "dedup_hash")
    mine = own_name(docs.columns, "dedup_own")
    fps = stored(fingerprints(docs, doc_id, text, shingle, seed, md5_long(text_or_empty(F.col(text))).alias("text_hash")), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    named = _rooted(fps, F.min(first), distance, unit)
    least = stored(named.groupBy("root").agg(F.min("least").alias("kept")), "component-kept")
    named = named.join(least, "root").select("fp", "kept")
    other = ~(F.col("doc_id").eqNullSafe(F.col("kept.id")) & (F.col("text_hash") == F.col("kept.hash")))
    gone = fps.join(named, "fp").where(other).select(F.col("doc_id").alias(at), F.col("text_hash").alias(hashed)).distinct()
    own = docs.withColumn(mine, md5_long(text_or_empty(F.col(text))))
    same = F.col(doc_id).eqNullSafe(F.col(at)) & (F.col(mine) == F.col(hashed))
    # Only rows that occur again are brought together; the rest keep their places.
    again = stored(fps.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("doc_id").alias(at), F.col("text_hash").alias(hashed)), "documents-again")
    own = own.join(again, same, "left_anti").unionByName(own.join(again, same, "left_semi").dropDuplicates([doc_id, mine]))
    return own.join(gone, same, "left_anti").select(*docs.columns)
