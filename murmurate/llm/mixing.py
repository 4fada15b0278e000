"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Each document draws a uniform number from its id; its key is ``-ln(u) / quality``, so better documents tend to
come first. A source's target is met by whole epochs of all its documents and then by the documents of smallest
key, as far as the rest of the target reaches; the document at the edge is taken if that comes nearer. Quality is a
column of the caller's; without one it is one over one plus a text's markup symbols a word.

Scale: a source may hold any share of all rows. Equal rows are one entry with a count, made on the map side. Keys are
dealt into ranges by their logarithm, as many to an octave as the number of rows asks for, so that a range holds about
``range_rows`` entries whatever the weights are. Sums of whole ranges are prefix-summed on the small table of
(source, range), and only entries within one range are ordered together. The text is read once.

Defined cases: null text has size 0 and takes nothing; a null source is a source of its own and sorts last; a
row without an id draws by its content; a quality that is null, not a number or not above 0 counts as ``LEAST_QUALITY``;
repeated rows count as often as they occur; an empty table gives an empty result; columns other than the named ones only
tell rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from .scratch import stored
from .words import own_name, text_or_empty, word_count

WEIGHTS = (1, 2, 3)
CAP = 3
RANGE_ROWS = 20_000
#: Ranges an octave of keys has at least.
LEAST_RANGES = 64
LEAST_QUALITY = 1e-9
#: Copies of one row that are made together.
CHUNK = 1000
SEED = "mix-1"


def quality_weight(text: Column, size: Column) -> Column:
    """A document's weight in (0, 1]: one over one plus its markup symbols a word."""
    symbols = F.regexp_count(text_or_empty(text), F.lit(r"[#*$%&|<>]"))
    return (size + 1) / (size + 1 + symbols)


def uniform(name: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the name and the seed only."""
    digest = F.md5(F.concat(F.lit(seed + ":"), name))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 48))


def row_mark(docs: DataFrame) -> Column:
    """A hash of all columns; equal rows have equal marks."""
    plain = [F.col(f"`{f.name}`") if not isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f"`{f.name}`").cast("string") for f in docs.schema.fields]
    return F.xxhash64(*plain, *[c.isNull() for c in plain])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size): weights repeat over the sorted sources.

    Targets that would pass ``cap`` times their source are cut there and the excess is reshared by weight.
    In order of cap / weight a source is cut exactly if its cap lies below what a share would be once all before
    it are cut, so one ordered pass over the sources settles it. That table has a row a source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    shares = by_source.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    everything = W.partitionBy(F.lit(0))
    ordered = W.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    shares = shares.withColumn("rate", left / left_weight)
    shares = shares.withColumn("cut", F.col("most") / F.col("weight") < F.col("rate"))
    rate = F.max(F.when(~F.col("cut"), F.col("rate"))).over(everything)
    target = F.when(F.col("cut"), F.col("most").cast("double")).otherwise(
        F.least(rate * F.col("weight"), F.col("most").cast("double")))
    return shares.select("source", "source_size", target.alias("target"))


def _entries(docs: DataFrame, doc_id: str, text: str, source: str, weights: tuple[int, ...], cap: int, seed: str, range_rows: int, quality: str | Column | None) -> DataFrame:
    """One row for all equal rows of docs: doc_id, source, size, mark, rows, more (how many of them are taken once more), epochs, target, source_size, key."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), row_mark(docs).alias("mark"), F.col(text).alias("text"),
                     (F.lit(None) if quality is None else F.col(quality) if isinstance(quality, str) else quality).cast("double").alias("given"))
    good = (F.col("given") > 0) & ~F.isnan("given")
    better = quality_weight(F.col("text"), F.col("size")) if quality is None else F.when(good, F.greatest("given", F.lit(LEAST_QUALITY))).otherwise(LEAST_QUALITY)
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("mark").cast("string")))
    df = df.select("doc_id", "source", "size", "mark", (-F.ln(uniform(name, seed)) / better).alias("key"))
    rows = stored(df.groupBy("doc_id", "source", "size", "mark", "key").agg(F.count(F.lit(1)).alias("rows")), "mix-sizes")
    # An octave of keys holds at most 0.4 of a source's entries, whatever their weights.
    octave = max(LEAST_RANGES, -(-rows.count() * 2 // (5 * range_rows)))
    rows = rows.withColumn("range", F.floor(F.log2("key") * octave))

    targets = source_targets(rows.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, cap)
    target, whole = F.col("target"), F.col("source_size")
    targets = targets.withColumn("epochs", F.when(whole > 0, F.floor(target / whole)).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("rest", target - F.col("epochs") * whole)
    ranges = rows.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("rows")).alias("range_size"))
    earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("carry", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    same_source = ranges["source"].eqNullSafe(targets["source"])
    ranges = stored(ranges.join(targets, same_source).select(
        ranges["source"].alias("r_source"), F.col("range").alias("r_range"), "carry", "source_size", "target", "epochs", "rest"), "mix-ranges")

    found = rows.join(ranges, rows["source"].eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
    within = W.partitionBy("source", "range").orderBy("key", "doc_id", "size", "mark").rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumn("before", F.col("carry") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(within), F.lit(0)))
    # The n-th equal row, from 0, is taken once more if 2 * (before + n * size) + size <= 2 * rest.
    size, before, rest, n = F.col("size"), F.col("before"), F.col("rest"), F.col("rows")
    guess = F.when(size > 0, F.floor((2 * rest - size - 2 * before) / (2 * size)) + 1).otherwise(F.when(before <= rest, n).otherwise(0)).cast("long")
    over = (size > 0) & (2 * (before + (guess - 1) * size) + size > 2 * rest)  # the quotient was rounded up
    more = F.least(F.greatest(guess - over.cast("long"), F.lit(0).cast("long")), n)
    return found.select("doc_id", "source", "size", "mark", "rows", more.alias("more"), "epochs", "target", "source_size", "key")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
        cap: int = CAP, seed: str = SEED, range_rows: int = RANGE_ROWS, quality: str | Column | None = None) -> DataFrame:
    """What the mix takes: doc_id, size, source_size, target, taken, epochs, and the sampling key; quality is a column of weights or an expression."""
    found = _entries(docs, doc_id, text, source, weights, cap, seed, range_rows, quality)
    found = found.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    copies = F.col("epochs") + (F.col("n") <= F.col("more")).cast("long")
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"),
                        copies.alias("copies"), "epochs", "key")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
                    cap: int = CAP, seed: str = SEED, range_rows: int = RANGE_ROWS, quality: str | Column | None = None) -> DataFrame:
    """The documents as often as ``mix`` says, row by row, with the columns of docs but a named one of weights. Sizeless documents go.

    Rows are told apart by all their columns. Of equal rows some may be taken once more than others; all copies of
    those, at most one kind of row a source, are made from one of them.
    """
    taken = _entries(docs, doc_id, text, source, weights, cap, seed, range_rows, quality)
    taken = stored(taken.where("size > 0 AND (epochs > 0 OR more > 0)").select("mark", F.col("doc_id").alias("id"), "rows", "more", "epochs"), "mix-taken")
    mark, at, copies, step = (own_name(docs.columns, n) for n in ("mix_mark", "mix_id", "mix_copies", "mix_step"))
    marked = docs.withColumn(mark, row_mark(docs))
    columns = [c for c in docs.columns if not (isinstance(quality, str) and c == quality)]
    joined = lambda part: marked.join(part, (F.col(mark) == F.col(f"{mark}_")) & F.col(doc_id).eqNullSafe(F.col(at)))
    named = lambda df, n: df.select(F.col("mark").alias(f"{mark}_"), F.col("id").alias(at), n.alias(copies))
    alike = joined(named(taken.where("more = 0 OR more = rows"), F.col("epochs") + (F.col("more") > 0).cast("long")))
    alike = alike.withColumn(step, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int"))))
    edge = joined(named(taken.where("more > 0 AND more < rows"), F.col("epochs") * F.col("rows") + F.col("more"))).dropDuplicates([mark, doc_id])
    edge = edge.withColumn(step, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / CHUNK)))).repartition(mark, step)
    edge = edge.withColumn(step, F.explode(F.array_repeat(F.lit(0), F.least(F.lit(CHUNK), F.col(copies) - F.col(step) * CHUNK).cast("int"))))
    return alike.select(*columns).unionByName(edge.select(*columns))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS symbols FROM d),
k AS (SELECT doc_id, source, size, -ln((CAST('0x' || substr(md5('mix-1:' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE)
             / (CAST(size + 1 AS DOUBLE) / CAST(size + 1 + symbols AS DOUBLE)) AS key FROM s),
b AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, [1, 2, 3][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, 3 * source_size AS most FROM b),
r AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER o, 0) AS DOUBLE)
             / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS rate
      FROM w WINDOW o AS (ORDER BY CAST(most AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CAST(most AS DOUBLE) / weight < rate AS cut FROM r),
t AS (SELECT source, source_size, CASE WHEN cut THEN CAST(most AS DOUBLE)
             ELSE least(max(CASE WHEN NOT cut THEN rate END) OVER () * weight, CAST(most AS DOUBLE)) END AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p
"""
