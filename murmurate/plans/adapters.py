"""The engine's logical tables over the test tables: reviews, claims, readings and the rest.

Each view is a DataFrame builder here and a common table expression in ``CTE`` that says the same in SQL.

reviews: one order is a review; its market segment is the game, its customer's nation the language.
claims: one line of an order is a claim; the part's brand is its subject, none where it was declined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurate.session import table

#: What orders the claims of a review, since line numbers repeat.
CLAIM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
#: The end of the capture: the first instant after the newest review of any size of the test tables.
CAPTURED = "2001-08-02"
#: The month that trailing windows end with, the newest full one.
ANCHOR_MONTH = "2001-07"
#: Updates of every game: (name, day posted).
UPDATES = (
    ("first light", "1996-03-10"), ("long night", "1997-06-01"), ("small fix", "1997-06-15"), ("new ground", "1998-09-20"),
    ("open sea", "2000-02-02"), ("last call", "2001-07-20"),
)
MONTH = 30


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review, created (Unix seconds), game, language, voted_up, helpfulness, played (minutes or null), and flags."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    df = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return df.select(
        F.col("o_orderkey").alias("review"), F.unix_timestamp("o_orderdate").alias("created"), F.col("c_mktsegment").alias("game"),
        F.col("n_name").alias("language"), (F.col("o_orderstatus") == "F").alias("voted_up"), F.col("o_totalprice").alias("helpfulness"),
        F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 1.5)).cast("long").alias("played"),
        F.col("o_orderpriority").startswith("1").alias("deck"), F.col("o_orderpriority").startswith("2").alias("early"),
        F.col("o_orderpriority").startswith("3").alias("free"), F.col("c_custkey").alias("author"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review, ord, subject (null: declined), polarity, confidence, also_subject, also_polarity, line (a byte offset stand-in)."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    df = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*CLAIM_ORDER)) - 1
    return df.select(
        F.col("l_orderkey").alias("review"), place.alias("ord"),
        F.when(F.col("l_quantity") >= 5, F.col("p_brand")).alias("subject"),
        F.when(F.col("l_discount") >= 0.07, "praise").when(F.col("l_tax") >= 0.06, "complaint").otherwise("neutral").alias("polarity"),
        (F.col("l_quantity") / 50).alias("confidence"),
        F.when(F.col("l_returnflag") == "R", "RETURNS").when(F.col("l_returnflag") == "A", "RETURNS").alias("also_subject"),
        F.when(F.col("l_returnflag") == "R", "complaint").when(F.col("l_returnflag") == "A", "praise").alias("also_polarity"),
        F.col("l_partkey").alias("part"), F.col("l_quantity").alias("weight"))


def updates(spark: SparkSession) -> DataFrame:
    """name and posted (Unix seconds)."""
    df = spark.createDataFrame(list(UPDATES), "name string, day string")
    return df.select("name", F.unix_timestamp(F.to_timestamp("day")).alias("posted"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as reviews: id, text, language, source, and the labels some have."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels.dropDuplicates(["doc_id"]), "doc_id", "left").select("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")


def labelled_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labellings of the same documents: the label's own and a rule on the length, with a flag for doubt."""
    df = documents(spark, sf_dir).where(F.col("quality").isNotNull())
    size = F.col("n_chars")
    first = F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "rude").otherwise("good")
    second = F.when(size < 600, "poor").when(size % 9 == 0, "rude").otherwise("good")
    return df.select("doc_id", F.col("lang").alias("language"), first.alias("first"), second.alias("second"),
                     (size % 5 == 0).alias("doubt_first"), (size % 7 == 0).alias("doubt_second"), (F.col("doc_id") % 11 == 0).alias("only_first"),
                     (F.col("doc_id") % 13 == 0).alias("only_second"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions: item, truth, predicted, confidence (with ties), correct, game, fold."""
    v = table(spark, sf_dir, "embeddings")
    cell = lambda k: F.element_at("embedding", k).cast("double")
    sure = F.floor((F.abs(cell(1)) + F.abs(cell(2)) + F.abs(cell(3))) * 150) / 100
    df = v.select(F.col("vec_id").alias("item"), F.col("label").alias("truth"), F.least(F.lit(0.99), F.greatest(F.lit(0.02), sure)).alias("confidence"),
                  F.when(cell(4) > -0.05, F.col("label")).otherwise((F.col("label") + 3) % 10).cast("int").alias("predicted"), (F.col("vec_id") % 10).cast("int").alias("game"),
                  F.transform("embedding", lambda x: F.round(x.cast("double") * 8, 6)).alias("wide"))
    return df.select("item", "truth", "predicted", "confidence", (F.col("truth") == F.col("predicted")).alias("correct"), "game",
                     F.slice("wide", 1, 10).alias("logits"))


CTE = {
    "reviews": """reviews AS (
  SELECT o_orderkey AS review, CAST(epoch(o_orderdate) AS BIGINT) AS created, c_mktsegment AS game, n_name AS language, o_orderstatus = 'F' AS voted_up,
         o_totalprice AS helpfulness, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 1.5::DOUBLE) AS BIGINT) END AS played,
         o_orderpriority LIKE '1%' AS deck, o_orderpriority LIKE '2%' AS early, o_orderpriority LIKE '3%' AS free, c_custkey AS author
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "claims": """claims AS (
  SELECT l_orderkey AS review, row_number() OVER (PARTITION BY l_orderkey ORDER BY """ + ", ".join(CLAIM_ORDER) + """) - 1 AS ord,
         CASE WHEN l_quantity >= 5 THEN p_brand END AS subject,
         CASE WHEN l_discount >= 0.07::DOUBLE THEN 'praise' WHEN l_tax >= 0.06::DOUBLE THEN 'complaint' ELSE 'neutral' END AS polarity,
         l_quantity / 50 AS confidence,
         CASE WHEN l_returnflag IN ('R', 'A') THEN 'RETURNS' END AS also_subject,
         CASE WHEN l_returnflag = 'R' THEN 'complaint' WHEN l_returnflag = 'A' THEN 'praise' END AS also_polarity, l_partkey AS part, l_quantity AS weight
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "named": """named AS (
  SELECT review, ord, subject, polarity FROM claims WHERE subject IS NOT NULL
  UNION ALL SELECT review, ord, also_subject, also_polarity FROM claims WHERE also_subject IS NOT NULL)""",
    "sides": """sides AS (
  SELECT review, subject, bool_or(polarity = 'praise') AS praise, bool_or(polarity = 'complaint') AS complaint, count(*) AS n_claims FROM named GROUP BY review, subject)""",
    "verdicts": """verdicts AS (
  SELECT review, count(*) AS n_claims, count(*) FILTER (subject IS NULL) AS declined, bool_and(subject IS NULL AND also_subject IS NULL) AS silent,
         first(subject ORDER BY confidence DESC, ord) FILTER (subject IS NOT NULL) AS primary_subject
  FROM claims GROUP BY review)""",
    "updates": "updates AS (SELECT name, CAST(epoch(CAST(day AS TIMESTAMP)) AS BIGINT) AS posted FROM (VALUES "
               + ", ".join(f"('{n}', '{d}')" for n, d in UPDATES) + ") u(name, day))",
    "docs": "docs AS (SELECT d.doc_id, text, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN (SELECT DISTINCT ON (doc_id) * FROM labels) l ON d.doc_id = l.doc_id)",
    "twice": """twice AS (
  SELECT doc_id, lang AS language, CASE WHEN quality = 0 THEN 'poor' WHEN toxic = 1 THEN 'rude' ELSE 'good' END AS first,
         CASE WHEN n_chars < 600 THEN 'poor' WHEN n_chars % 9 = 0 THEN 'rude' ELSE 'good' END AS second,
         n_chars % 5 = 0 AS doubt_first, n_chars % 7 = 0 AS doubt_second, doc_id % 11 = 0 AS only_first, doc_id % 13 = 0 AS only_second
  FROM docs WHERE quality IS NOT NULL)""",
    "scored": """scored AS (
  SELECT item, truth, CASE WHEN c4 > -0.05::DOUBLE THEN truth ELSE (truth + 3) % 10 END AS predicted,
         least(0.99::DOUBLE, greatest(0.02::DOUBLE, floor((abs(c1) + abs(c2) + abs(c3)) * 150) / 100)) AS confidence,
         CASE WHEN c4 > -0.05::DOUBLE THEN truth ELSE (truth + 3) % 10 END = truth AS correct, CAST(item % 10 AS INT) AS game, logits
  FROM (SELECT vec_id AS item, label AS truth, embedding[1]::DOUBLE AS c1, embedding[2]::DOUBLE AS c2, embedding[3]::DOUBLE AS c3, embedding[4]::DOUBLE AS c4,
               list_transform(embedding[1:10], lambda x: round(x::DOUBLE * 8, 6)) AS logits FROM embeddings))""",
}
_NEEDS = {"named": ("claims",), "sides": ("claims", "named"), "verdicts": ("claims",), "twice": ("docs",)}


def with_views(*names: str, body: str) -> str:
    """A SQL statement with the named views before it."""
    wanted: list[str] = []
    for n in names:
        for x in (*_NEEDS.get(n, ()), n):
            if x not in wanted:
                wanted.append(x)
    return "WITH " + ",\n".join(CTE[n] for n in wanted) + ("," if body.lstrip().startswith("--and") else "") + "\n" + body.replace("--and", "", 1)


def exploded(claims_df: DataFrame) -> DataFrame:
    """Every (claim, named subject): the first subject and the one beside it."""
    pairs = F.array(F.struct(F.col("subject").alias("s"), F.col("polarity").alias("p")), F.struct(F.col("also_subject").alias("s"), F.col("also_polarity").alias("p")))
    named = claims_df.select("review", "ord", F.explode(F.filter(pairs, lambda x: x["s"].isNotNull())).alias("x"))
    return named.select("review", "ord", F.col("x.s").alias("subject"), F.col("x.p").alias("polarity"))


def sides(claims_df: DataFrame) -> DataFrame:
    """One row a review and subject raised: whether praised, whether complained of, and in how many claims."""
    return exploded(claims_df).groupBy("review", "subject").agg(
        F.bool_or(F.col("polarity") == "praise").alias("praise"), F.bool_or(F.col("polarity") == "complaint").alias("complaint"),
        F.count(F.lit(1)).alias("n_claims"))


def verdicts(claims_df: DataFrame) -> DataFrame:
    """One row a review with claims: claims, declined ones, whether silent, and the subject of its surest answered claim."""
    surest = F.max_by(F.col("subject"), F.when(F.col("subject").isNotNull(), F.struct(F.col("confidence"), (-F.col("ord")).alias("o"))))
    return claims_df.groupBy("review").agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("subject").isNull()).alias("declined"),
        F.bool_and(F.col("subject").isNull() & F.col("also_subject").isNull()).alias("silent"), surest.alias("primary_subject"))


def month_of(created: Column) -> Column:
    return F.date_format(F.timestamp_seconds(created), "yyyy-MM")
