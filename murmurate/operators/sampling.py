"""Reproducible draws and ordered cuts: hash ranks, strata, round robin, shortlists and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurate.operators.rollups import most_helpful
from murmurate.plans import adapters as A
from murmurate.registry import register


def hash_rank(seed: int, purpose: str, key: Column) -> Column:
    """The SHA-256 of the seed (eight bytes, little-endian), the purpose and the key, in hex: its order is a fixed shuffle."""
    start = F.lit(seed.to_bytes(8, "little") + purpose.encode())
    return F.sha2(F.concat(start, F.encode(key.cast("string"), "UTF-8")), 256)


def hash_rank_sql(seed: int, purpose: str, key: str) -> str:
    blob = "".join(f"\\x{b:02X}" for b in seed.to_bytes(8, "little") + purpose.encode())
    return f"sha256('{blob}'::BLOB || encode(CAST({key} AS VARCHAR)))"


def smallest(df: DataFrame, k: int, *order) -> DataFrame:
    """The k first rows by an order; Spark keeps k a task and k at the end."""
    return df.orderBy(*order).limit(k)


def placed(df: DataFrame, by: list[str], *order) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def numbered(df: DataFrame, cell: Column, *order, name: str = "place") -> DataFrame:
    """df with the place of each row in an order, from 1, though no task sees all rows.

    ``cell`` must rise with the order, such as the first digits of a hash or an id's thousands: cells are counted and
    summed up on a small table, and rows are ordered within their cell.
    """
    cut = df.withColumn("cell_of", cell)
    before = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("cell_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = cut.groupBy("cell_of").agg(F.count(F.lit(1)).alias("n")).select("cell_of", before.alias("before_cell"))
    within = F.row_number().over(W.partitionBy("cell_of").orderBy(*order))
    return cut.withColumn("within", within).join(sums, "cell_of").withColumn(name, F.col("before_cell") + F.col("within")).drop("cell_of", "before_cell", "within")


@register("hash_sample", A.with_views("reviews", body=f"SELECT review FROM reviews ORDER BY {hash_rank_sql(1, 'claims', 'review')} LIMIT 200"))
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 200 reviews that depends on ids alone."""
    return smallest(A.reviews(spark, sf_dir).select("review"), 200, hash_rank(1, "claims", F.col("review")))


@register("stratified_draw", A.with_views("reviews", "verdicts", body=f"""--and
r AS (SELECT review, language IN ('NATION_0', 'NATION_1', 'NATION_2') AS own FROM reviews JOIN verdicts USING (review)),
p AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY {hash_rank_sql(1, 'claims', 'review')}) AS place FROM r)
SELECT review, own FROM p WHERE place <= CASE WHEN own THEN 60 ELSE 40 END ORDER BY review"""))
def stratified_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred reviews with claims, 60 of them in some languages, by hash rank, in the order of ids."""
    r = A.reviews(spark, sf_dir).join(A.claims(spark, sf_dir).select("review").distinct(), "review", "left_semi")
    r = r.select("review", F.col("language").isin("NATION_0", "NATION_1", "NATION_2").alias("own"))
    p = placed(r, ["own"], hash_rank(1, "claims", F.col("review")))
    return p.where(F.col("place") <= F.when(F.col("own"), 60).otherwise(40)).select("review", "own").orderBy("review")


@register("second_opinion_draw", A.with_views("docs", "twice", body=f"""
SELECT doc_id FROM twice QUALIFY row_number() OVER (ORDER BY {hash_rank_sql(1, 'second-opinion', 'doc_id')}) <= round(0.1::DOUBLE * count(*) OVER ())"""))
def second_opinion_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the labelled items, for a second labeller."""
    rank = hash_rank(1, "second-opinion", F.col("doc_id"))
    t = A.labelled_twice(spark, sf_dir).select("doc_id")
    p = numbered(t, F.substring(rank, 1, 3), rank)
    return p.join(F.broadcast(t.agg(F.count(F.lit(1)).alias("n")))).where(F.col("place") <= F.round(0.1 * F.col("n"))).select("doc_id")


@register("declined_draw", A.with_views("reviews", "claims", body=f"""--and
drawn AS (SELECT review FROM reviews ORDER BY {hash_rank_sql(1, 'claims', 'review')} LIMIT 200)
SELECT review, ord FROM claims WHERE subject IS NULL AND review NOT IN (SELECT review FROM drawn) ORDER BY {hash_rank_sql(1, 'declined', "review || ':' || ord")}, review, ord LIMIT 100"""))
def declined_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred declined claims of reviews that no earlier draw took."""
    drawn = hash_sample(spark, sf_dir)
    key = F.concat_ws(":", F.col("review").cast("string"), F.col("ord").cast("string"))
    free = A.claims(spark, sf_dir).where(F.col("subject").isNull()).join(F.broadcast(drawn), "review", "left_anti")
    return smallest(free.select("review", "ord"), 100, hash_rank(1, "declined", key), "review", "ord")


def round_robin(df: DataFrame, lists: str, wanted: int, *order) -> DataFrame:
    """One of each list in turn until enough: by place in its list, then by list."""
    return placed(df, [lists], *order).orderBy("place", lists).limit(wanted)


@register("round_robin_draw", A.with_views("claims", body=f"""--and
p AS (SELECT review, ord, subject, row_number() OVER (PARTITION BY subject ORDER BY {hash_rank_sql(1, 'keyword', "review || ':' || ord")}, review, ord) AS place FROM claims WHERE subject IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#34'))
SELECT * FROM p ORDER BY place, subject LIMIT 50"""))
def round_robin_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty claims of four rare subjects, taken in turn."""
    key = F.concat_ws(":", F.col("review").cast("string"), F.col("ord").cast("string"))
    rare = A.claims(spark, sf_dir).where(F.col("subject").isin("Brand#11", "Brand#12", "Brand#23", "Brand#34")).select("review", "ord", "subject")
    return round_robin(rare, "subject", 50, hash_rank(1, "keyword", key), "review", "ord")


@register("shortlist", A.with_views("claims", body=f"""--and
p AS (SELECT subject, polarity, review, ord, row_number() OVER (PARTITION BY subject, polarity ORDER BY {hash_rank_sql(1, 'report', "review || ':' || ord || ':' || subject")}, review, ord) AS place FROM claims WHERE subject IS NOT NULL)
SELECT subject, polarity, review, ord, row_number() OVER (PARTITION BY subject ORDER BY place, CASE polarity WHEN 'praise' THEN 0 WHEN 'complaint' THEN 1 ELSE 2 END) AS turn FROM p WHERE place <= 4"""))
def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four claims of each subject and side by hash rank, the sides taken in turn."""
    key = F.concat_ws(":", F.col("review").cast("string"), F.col("ord").cast("string"), F.col("subject"))
    c = A.claims(spark, sf_dir).where(F.col("subject").isNotNull()).select("subject", "polarity", "review", "ord")
    p = placed(c, ["subject", "polarity"], hash_rank(1, "report", key), "review", "ord").where("place <= 4")
    side = F.when(F.col("polarity") == "praise", 0).when(F.col("polarity") == "complaint", 1).otherwise(2)
    return p.select("subject", "polarity", "review", "ord", F.row_number().over(W.partitionBy("subject").orderBy("place", side)).alias("turn"))


@register("quotes", A.with_views("reviews", "claims", body=f"""--and
top AS (SELECT review, row_number() OVER (ORDER BY helpfulness DESC, review) AS pile FROM reviews ORDER BY pile LIMIT 50),
c AS (SELECT claims.*, pile FROM claims LEFT JOIN top USING (review) WHERE subject IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY subject, review ORDER BY confidence DESC, ord) AS of_review FROM c),
f AS (SELECT *, CASE WHEN pile IS NOT NULL THEN row_number() OVER (PARTITION BY subject, pile IS NULL ORDER BY pile, ord) END AS from_top FROM o WHERE of_review = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN from_top <= 2 THEN 0 ELSE 1 END, CASE WHEN from_top <= 2 THEN from_top END, {hash_rank_sql(1, 'report', "review || ':' || ord")}, review) AS turn FROM f)
SELECT subject, review, ord, turn, coalesce(from_top <= 2, false) AS helpful FROM q WHERE turn <= 8"""))
def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight quotes a subject, one a review: two from the most helpful reviews, the rest by hash rank."""
    reviews = A.reviews(spark, sf_dir)
    top = most_helpful(reviews).select("review", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("helpfulness"), "review")).alias("pile"))  # 50 rows
    c = A.claims(spark, sf_dir).where(F.col("subject").isNotNull()).join(F.broadcast(top), "review", "left")
    one = c.withColumn("of_review", F.row_number().over(W.partitionBy("subject", "review").orderBy(F.desc("confidence"), "ord"))).where("of_review = 1")
    key = F.concat_ws(":", F.col("review").cast("string"), F.col("ord").cast("string"))
    helped = one.where(F.col("pile").isNotNull()).withColumn("from_top", F.row_number().over(W.partitionBy("subject").orderBy("pile", "ord")))
    both = helped.unionByName(one.where(F.col("pile").isNull()).withColumn("from_top", F.lit(None).cast("int")))
    first = F.coalesce(F.col("from_top") <= 2, F.lit(False))
    turn = F.row_number().over(W.partitionBy("subject").orderBy(F.when(first, 0).otherwise(1), F.when(first, F.col("from_top")), hash_rank(1, "report", key), "review"))
    return both.withColumn("turn", turn).where("turn <= 8").select("subject", "review", "ord", "turn", first.alias("helpful"))


@register("one_claim_per_review", A.with_views("reviews", "claims", body="""--and
r AS (SELECT *, row_number() OVER (PARTITION BY review ORDER BY confidence DESC, ord, polarity) AS place FROM claims JOIN (SELECT review, helpfulness FROM reviews) USING (review) WHERE subject = 'Brand#12')
SELECT review, ord, polarity, confidence FROM r WHERE place = 1 ORDER BY helpfulness DESC, review LIMIT 100"""))
def one_claim_per_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest claim on one subject of each review, most helpful reviews first."""
    c = A.claims(spark, sf_dir).where(F.col("subject") == "Brand#12").join(A.reviews(spark, sf_dir).select("review", "helpfulness"), "review")
    one = placed(c, ["review"], F.desc("confidence"), "ord", "polarity").where("place = 1")
    return one.orderBy(F.desc("helpfulness"), "review").limit(100).select("review", "ord", "polarity", "confidence")


def page(df: DataFrame, start: int, count: int, *order) -> DataFrame:
    """A page of an ordered table."""
    return df.orderBy(*order).offset(start).limit(count)


@register("claims_behind", A.with_views("reviews", "claims", body="""--and
c AS (SELECT review, ord, CASE WHEN subject = 'Brand#12' THEN polarity ELSE also_polarity END AS polarity FROM claims WHERE subject = 'Brand#12' OR (also_subject = 'Brand#12' AND subject <> 'Brand#12')),
n AS (SELECT c.*, count(*) OVER () AS total FROM c JOIN reviews USING (review) WHERE polarity = 'complaint' AND deck)
SELECT review, ord, polarity, total FROM n ORDER BY review, ord LIMIT 25 OFFSET 50"""))
def claims_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 25 claims behind a figure: one subject, one side, one kind of reviewer, with the total."""
    c = A.claims(spark, sf_dir)
    side = F.when(F.col("subject") == "Brand#12", F.col("polarity")).when(F.col("also_subject") == "Brand#12", F.col("also_polarity"))
    deck = A.reviews(spark, sf_dir).where("deck").select("review")
    found = c.select("review", "ord", side.alias("polarity")).where(F.col("polarity") == "complaint").join(deck, "review", "left_semi")
    return page(found, 50, 25, "review", "ord").join(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))


ROLE_SQL = "CAST(('0x' || substr(sha256('1:' || {k}), 1, 13)) AS BIGINT) / 4503599627370496::DOUBLE"


def role(key: Column, seed: int = 1, held_out: float = 0.2, validation: float = 0.15) -> Column:
    """held-out, validation or train by the first bytes of a hash of seed and key."""
    part = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return F.when(part < held_out, "held-out").when(part < held_out + validation, "validation").otherwise("train")


@register("roles", A.with_views("reviews", body=f"""--and
a AS (SELECT DISTINCT author FROM reviews), s AS (SELECT author, {ROLE_SQL.format(k='author')} AS part FROM a)
SELECT author, CASE WHEN part < 0.2::DOUBLE THEN 'held-out' WHEN part < 0.35::DOUBLE THEN 'validation' ELSE 'train' END AS role FROM s"""))
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors dealt into training, validation and held-out parts."""
    return A.reviews(spark, sf_dir).select("author").distinct().select("author", role(F.col("author")).alias("role"))


@register("folds", A.with_views("reviews", body="""--and
g AS (SELECT DISTINCT game FROM reviews) SELECT game, (row_number() OVER (ORDER BY sha256('fold:1:' || game)) - 1) % 3 AS fold FROM g"""))
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games dealt into three folds by the order of a hash."""
    g = A.reviews(spark, sf_dir).select("game").distinct()
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.sha2(F.concat(F.lit("fold:1:"), "game"), 256))) - 1
    return g.select("game", (place % 3).alias("fold"))


@register("capped_groups", A.with_views("claims", body="""--and
p AS (SELECT subject, polarity, review, ord, row_number() OVER (PARTITION BY subject, polarity ORDER BY sha256(review || ':' || ord), review, ord) AS place FROM claims WHERE subject IS NOT NULL)
SELECT subject, polarity, count(*) AS kept, CAST(sum(review) AS BIGINT) AS id_sum FROM p WHERE place <= 300 GROUP BY ALL"""))
def capped_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample that themes are found in: the 300 smallest claim hashes of each subject and side."""
    c = A.claims(spark, sf_dir).where(F.col("subject").isNotNull()).select("subject", "polarity", "review", "ord")
    p = placed(c, ["subject", "polarity"], F.sha2(F.concat_ws(":", F.col("review").cast("string"), F.col("ord").cast("string")), 256), "review", "ord")
    return p.where("place <= 300").groupBy("subject", "polarity").agg(F.count(F.lit(1)).alias("kept"), F.sum("review").alias("id_sum"))


@register("label_batches", A.with_views("docs", "twice", body="SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 25) AS BIGINT) AS batch FROM twice WHERE NOT only_first"))
def label_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items handed out in batches of 25, in the order of ids."""
    t = A.labelled_twice(spark, sf_dir).where("NOT only_first")
    return numbered(t.select("doc_id"), F.floor(F.col("doc_id") / 4096), "doc_id").select("doc_id", F.floor((F.col("place") - 1) / 25).alias("batch"))


@register("gold_draw", A.with_views("docs", "twice", body=f"""--and
b AS (SELECT doc_id FROM twice ORDER BY {hash_rank_sql(1, 'gold-blind', 'doc_id')} LIMIT 40),
q AS (SELECT doc_id, CASE WHEN first <> second AND NOT doubt_first THEN 0 WHEN doc_id IN (SELECT doc_id FROM b) THEN 1 WHEN first <> second THEN 2 END AS priority FROM twice)
SELECT doc_id, priority FROM q WHERE priority IS NOT NULL ORDER BY priority, doc_id LIMIT 120"""))
def gold_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions for a judge: sharp disagreements first, then a blind sample, then doubtful ones."""
    t = A.labelled_twice(spark, sf_dir)
    blind = smallest(t.select("doc_id"), 40, hash_rank(1, "gold-blind", F.col("doc_id"))).withColumn("blind", F.lit(True))
    apart = F.col("first") != F.col("second")
    q = t.join(F.broadcast(blind), "doc_id", "left").withColumn("priority", F.when(apart & ~F.col("doubt_first"), 0).when(F.col("blind"), 1).when(apart, 2))
    return q.where(F.col("priority").isNotNull()).select("doc_id", "priority").orderBy("priority", "doc_id").limit(120)


@register("rejudge_draw", A.with_views("docs", "twice", body="SELECT doc_id, first, second, row_number() OVER (ORDER BY language, doc_id) AS question FROM twice WHERE first <> second AND NOT only_second"))
def rejudge_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose two answers differ, numbered by language and id."""
    t = A.labelled_twice(spark, sf_dir).where("first <> second AND NOT only_second")
    cell = F.struct("language", F.floor(F.col("doc_id") / 4096).alias("thousands"))
    return numbered(t.select("doc_id", "first", "second", "language"), cell, "language", "doc_id", name="question").drop("language")


@register("asked_one_in", A.with_views("claims", body="""
SELECT review, ord, subject FROM claims WHERE subject IN ('Brand#13', 'Brand#44') AND CAST(('0x' || substr(s, 7, 2) || substr(s, 5, 2) || substr(s, 3, 2) || substr(s, 1, 2)) AS BIGINT) % 5 = 0""".replace("FROM claims WHERE", "FROM (SELECT *, sha256(review || '/' || ord) AS s FROM claims) WHERE")))
def asked_one_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question asked of some subjects' claims, one in five by the first four bytes of a hash, little-endian."""
    digest = F.sha2(F.concat_ws("/", F.col("review").cast("string"), F.col("ord").cast("string")), 256)
    number = F.conv(F.concat(*[F.substring(digest, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
    return A.claims(spark, sf_dir).where(F.col("subject").isin("Brand#13", "Brand#44") & (number % 5 == 0)).select("review", "ord", "subject")


@register("hash_strata", A.with_views("scored", body="SELECT truth, item FROM scored QUALIFY row_number() OVER (PARTITION BY truth ORDER BY sha256('frontier:' || item)) <= 7"))
def hash_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven items of every class by hash rank."""
    p = placed(A.scored(spark, sf_dir).select("truth", "item"), ["truth"], F.sha2(F.concat(F.lit("frontier:"), F.col("item").cast("string")), 256))
    return p.where("place <= 7").select("truth", "item")
