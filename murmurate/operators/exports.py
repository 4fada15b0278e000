"""Tables as they are handed out: subject rows, month rows, claims of texts and terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurate.functions import splitter, terms
from murmurate.functions.stats import log_odds
from murmurate.operators import rollups as R
from murmurate.plans import adapters as A
from murmurate.registry import register
from murmurate.session import table


@register("subject_rows", A.with_views("reviews", "sides", body="--and\n" + R.KINDS_SQL + """,
e AS (SELECT 'everyone' AS split, 'everyone' AS kind, subject, count(*) AS raised, count(*) FILTER (praise AND NOT complaint) AS praised, count(*) FILTER (complaint AND NOT praise) AS criticised,
             count(*) FILTER (praise AND complaint) AS mixed FROM sides JOIN reviews USING (review) GROUP BY subject),
u AS (SELECT * FROM e UNION ALL SELECT split, kind, subject, raised, praised, criticised, mixed FROM seg),
h AS (SELECT 'everyone' AS kind, count(*) AS reviews FROM reviews UNION ALL SELECT kind, reviews FROM heads)
SELECT split, u.kind, subject, reviews, CASE WHEN reviews >= 1000 THEN raised END AS raised, CASE WHEN reviews >= 1000 THEN praised END AS praised, CASE WHEN reviews >= 1000 THEN criticised END AS criticised,
       CASE WHEN reviews >= 1000 THEN mixed END AS mixed, CASE WHEN reviews >= 1000 THEN round(raised / reviews, 6) END AS rate, CASE WHEN reviews < 1000 THEN 'fewer than 1000 reviews' END AS withheld FROM u JOIN h ON u.kind = h.kind"""))
def subject_rows(spark: SparkSession, sf_dir: str, least: int = 1000) -> DataFrame:
    """Everyone and then each segment by subject; figures of small segments are withheld, with the reason."""
    reviews, sides = A.reviews(spark, sf_dir), A.sides(A.claims(spark, sf_dir))
    every = R.per_subject(sides, reviews.select("review", "voted_up")).select(F.lit("everyone").alias("split"), F.lit("everyone").alias("kind"), "subject", F.col("mention_reviews").alias("raised"), "praised", "criticised", "mixed")
    parts = R.segment_subjects(reviews, sides).select("split", "kind", "subject", "raised", "praised", "criticised", "mixed")
    heads = reviews.agg(F.count(F.lit(1)).alias("reviews")).select(F.lit("everyone").alias("kind"), "reviews").unionByName(R.segment_heads(reviews).select("kind", "reviews"))
    df = every.unionByName(parts).join(F.broadcast(heads), "kind")  # a row a segment
    enough = F.col("reviews") >= least
    return df.select("split", "kind", "subject", "reviews", *[F.when(enough, F.col(n)).alias(n) for n in ("raised", "praised", "criticised", "mixed")],
                     F.when(enough, F.round(F.col("raised") / F.col("reviews"), 6)).alias("rate"), F.when(~enough, f"fewer than {least} reviews").alias("withheld"))


_WIDE = ("Brand#11", "Brand#12", "Brand#13", "RETURNS")


@register("month_rows", "WITH m AS (" + R.MONTHLY + ") SELECT month, max(reviews) AS reviews, max(positive) AS positive, " + ", ".join(
    f"coalesce(max({c}) FILTER (subject = '{s}'), 0) AS \"{s}_{c}\"" for s in _WIDE for c in ("raising", "praising", "complaining")) + " FROM m GROUP BY month")
def month_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months in wide form, three columns a subject, the subjects being given."""
    m = R.monthly(A.reviews(spark, sf_dir), A.sides(A.claims(spark, sf_dir)))
    cells = [F.coalesce(F.max(F.when(F.col("subject") == s, F.col(c))), F.lit(0)).alias(f"{s}_{c}") for s in _WIDE for c in ("raising", "praising", "complaining")]
    return m.groupBy("month").agg(F.max("reviews").alias("reviews"), F.max("positive").alias("positive"), *cells)


@register("claims_of_texts")
def claims_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut into its claims."""
    return splitter.exploded(table(spark, sf_dir, "documents"), "text", "doc_id", "lang")


@register("claim_counts")
def claim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many claims texts make, by language, at both depths."""
    d = table(spark, sf_dir, "documents")
    deep = splitter.exploded(d, "text", "doc_id", "lang").groupBy("lang").agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("doc_id").alias("texts"))
    shallow = splitter.exploded(d, "text", "doc_id", "lang", deep=False).groupBy("lang").agg(F.count(F.lit(1)).alias("whole_texts"))
    return deep.join(shallow, "lang", "full_outer")


@register("terms_shown")
def terms_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most telling terms of good and of poor texts, merged where they say the same."""
    d = A.documents(spark, sf_dir).where(F.col("quality").isNotNull() & F.col("text").isNotNull()).select("doc_id", "quality", "text")
    used = d.select("quality", F.explode(terms.terms_column(F.col("text"))).alias("term"))
    sizes = d.groupBy("quality").agg(F.count(F.lit(1)).alias("of")).withColumn("all", F.sum("of").over(R.W.partitionBy(F.lit(0))))
    counts = used.groupBy("quality", "term").agg(F.count(F.lit(1)).alias("reviews")).withColumn("everywhere", F.sum("reviews").over(R.W.partitionBy("term")))
    df = counts.where(F.col("reviews") >= terms.LEAST_REVIEWS).join(F.broadcast(sizes), "quality")
    delta, v = log_odds(F.col("reviews"), F.col("of"), F.col("everywhere") - F.col("reviews"), F.col("all") - F.col("of"))
    df = df.withColumn("z", delta / F.sqrt(v)).where((delta >= F.log(F.lit(2.0))) & (F.col("z") >= 2))
    return terms.merged_terms(df.select("quality", "term", "reviews", "z"), ["quality"])
