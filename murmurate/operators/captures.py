"""Newest copies, reads as of a time, and evidence, over a capture made from orders.

The crawl holds all orders, some of them in two shards; three sweeps hold later copies of some, one a copy older than
the crawl's, and some ids of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurate.plans import adapters as A
from murmurate.registry import register
from murmurate.session import table
from murmurate.sources import capture

SWEEPS = (100, 200, 300)
CTE = """copies AS (
  SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT AS updated, 0 AS sweep, o_totalprice AS price FROM orders
  UNION ALL SELECT o_orderkey, epoch(o_orderdate)::BIGINT, 0, o_totalprice FROM orders WHERE o_orderkey % 50 = 0
  UNION ALL SELECT o_orderkey, epoch(o_orderdate)::BIGINT + 86400, 100, o_totalprice + 1 FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT o_orderkey, epoch(o_orderdate)::BIGINT + CASE WHEN o_orderkey % 28 = 0 THEN -86400 ELSE 172800 END, 200, o_totalprice + 2 FROM orders WHERE o_orderkey % 14 = 0 OR o_orderkey % 10 = 1
  UNION ALL SELECT CASE WHEN o_orderkey % 97 = 0 THEN -o_orderkey ELSE o_orderkey END, NULL, 300, o_totalprice + 3 FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 101 = 0),
best AS (SELECT id, max((coalesce(updated, 0), sweep)) AS b FROM copies WHERE sweep > 0 AND sweep <= {upto} GROUP BY id),
kept AS (SELECT c.* FROM copies c LEFT JOIN best USING (id) WHERE sweep <= {upto} AND (b IS NULL OR (sweep > 0 AND (coalesce(updated, 0), sweep) = b)))"""


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.unix_timestamp("o_orderdate").alias("updated"), F.col("o_totalprice").alias("price"))

    def copy(where: str, sweep: int, later, key=F.col("id")) -> DataFrame:
        return o.where(where).select(key.alias("id"), later.cast("long").alias("updated"), F.lit(sweep).alias("sweep"), (F.col("price") + sweep / 100).alias("price"))

    u = F.col("updated")
    own = F.when(F.col("id") % 97 == 0, -F.col("id")).otherwise(F.col("id"))
    parts = [copy("true", 0, u), copy("id % 50 = 0", 0, u), copy("id % 7 = 0", 100, u + 86400),
             copy("id % 14 = 0 OR id % 10 = 1", 200, u + F.when(F.col("id") % 28 == 0, -86400).otherwise(172800)), copy("id % 97 = 0 OR id % 101 = 0", 300, F.lit(None), own)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("newest_copies", "WITH " + CTE.format(upto=300) + " SELECT id, updated, sweep, price FROM kept")
def newest_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture as it stands now."""
    return capture.newest(copies(spark, sf_dir), "id", "updated")


@register("as_of_copies", "WITH " + CTE.format(upto=200) + " SELECT id, updated, sweep, price FROM kept")
def as_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture as an earlier reading saw it."""
    return capture.newest(copies(spark, sf_dir), "id", "updated", as_of=200)


@register("only_in_sweeps", "WITH " + CTE.format(upto=300) + " SELECT DISTINCT id FROM copies WHERE sweep > 0 AND id NOT IN (SELECT id FROM copies WHERE sweep = 0) AND id NOT IN (SELECT id FROM copies WHERE sweep = 300 AND id % 2 = 0)")
def only_in_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that only sweeps hold and nothing counted yet."""
    c = copies(spark, sf_dir)
    return capture.only_swept(c, c.where("sweep = 300 AND id % 2 = 0"), 300, "id")


@register("new_or_edited", "WITH " + CTE.format(upto=300) + """, w AS (SELECT max(updated) - 86400 * 200 AS mark FROM copies WHERE sweep = 0)
SELECT sweep, count(*) AS copies, count(*) FILTER (coalesce(updated, 0) >= mark) AS past_mark, count(DISTINCT id) FILTER (id < 0) AS fresh FROM copies, w WHERE sweep > 0 GROUP BY sweep""")
def new_or_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sweep brought: copies, those past the watermark, and ids that were not known."""
    c = copies(spark, sf_dir)
    mark = c.where("sweep = 0").agg((F.max("updated") - 86400 * 200).alias("mark"))
    return c.where("sweep > 0").join(F.broadcast(mark)).groupBy("sweep").agg(
        F.count(F.lit(1)).alias("copies"), F.count_if(F.coalesce("updated", F.lit(0)) >= F.col("mark")).alias("past_mark"), F.countDistinct(F.when(F.col("id") < 0, F.col("id"))).alias("fresh"))


@register("counting_texts", "SELECT lang, count(*) AS reviews, count(*) FILTER (text IS NOT NULL) AS bodies, count(*) FILTER (text IS NOT NULL AND NOT regexp_full_match(text, '[\\s\\pZ]*')) AS counted FROM documents GROUP BY lang")
def counting_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are read and those that are counted: blank ones are read but not counted."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("reviews"), F.count("text").alias("bodies"), F.count_if(~capture.blank(F.col("text"))).alias("counted"))


@register("publishable_facts", "SELECT doc_id, sha256(text) AS text_sha256, octet_length(encode(text)) AS text_bytes, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def publishable_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of named reviews: a semi-join, and the text only as its hash and size."""
    ids = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    d = table(spark, sf_dir, "documents").join(ids, "doc_id", "left_semi")
    return d.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").alias("text_bytes"), "lang")


@register("fingerprint_check", """
WITH k AS (SELECT doc_id, sha256(CASE WHEN doc_id % 12 = 5 THEN text || ' ' ELSE text END) AS key FROM documents WHERE text IS NOT NULL)
SELECT l.doc_id, l.quality, coalesce(sha256(text) = key, false) AS agrees FROM (SELECT DISTINCT ON (doc_id) * FROM labels) l LEFT JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN k ON k.doc_id = l.doc_id""")
def fingerprint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels beside the text that was fetched again: usable only where its fingerprint agrees."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    k = d.select("doc_id", (F.sha2(F.when(F.col("doc_id") % 12 == 5, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256) == F.sha2("text", 256)).alias("same"))
    return table(spark, sf_dir, "labels").dropDuplicates(["doc_id"]).join(k, "doc_id", "left").select("doc_id", "quality", F.coalesce("same", F.lit(False)).alias("agrees"))


@register("points", A.with_views("reviews", "claims", "named", body="""--and
n AS (SELECT review, ord, count(*) AS filed FROM named GROUP BY ALL)
SELECT c.review, c.ord, m.subject, m.polarity, r.language, c.subject IS NOT DISTINCT FROM m.subject AS first_subject, strftime(make_timestamp(created * 1000000), '%Y-%m-%d') AS day
FROM claims c LEFT JOIN named m ON m.review = c.review AND m.ord = c.ord JOIN reviews r ON r.review = c.review WHERE deck"""))
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points export: a row a claim and subject filed, one with no subject for a declined claim."""
    c = A.claims(spark, sf_dir)
    pairs = F.filter(F.array(F.struct(F.col("subject").alias("s"), F.col("polarity").alias("p")), F.struct(F.col("also_subject").alias("s"), F.col("also_polarity").alias("p"))), lambda x: x["s"].isNotNull())
    filed = c.select("review", "ord", F.col("subject").alias("own"), F.explode_outer(pairs).alias("x"))
    r = A.reviews(spark, sf_dir).where("deck").select("review", "language", F.date_format(F.timestamp_seconds("created"), "yyyy-MM-dd").alias("day"))
    return filed.join(r, "review").select("review", "ord", F.col("x.s").alias("subject"), F.col("x.p").alias("polarity"), "language", F.col("own").eqNullSafe(F.col("x.s")).alias("first_subject"), "day")


@register("evidence", A.with_views("reviews", "claims", body="""--and
p AS (SELECT review, ord, polarity, row_number() OVER (ORDER BY review, ord) AS ordinal FROM claims WHERE subject = 'Brand#21' AND polarity = 'praise' ORDER BY ordinal LIMIT 20)
SELECT ordinal, p.review, p.ord, language, helpfulness, 'https://reviews.example/' || author || '/' || p.review AS url FROM p JOIN reviews USING (review)"""))
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of claims with their whole reviews, in the page's order: the text is fetched for the page alone."""
    from pyspark.sql import Window as W

    p = A.claims(spark, sf_dir).where("subject = 'Brand#21' AND polarity = 'praise'").select("review", "ord").orderBy("review", "ord").limit(20)
    p = p.withColumn("ordinal", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("review", "ord")))  # 20 rows
    r = A.reviews(spark, sf_dir)
    url = F.concat(F.lit("https://reviews.example/"), F.col("author").cast("string"), F.lit("/"), F.col("review").cast("string"))
    return r.join(F.broadcast(p), "review").select("ordinal", "review", "ord", "language", "helpfulness", url.alias("url"))
