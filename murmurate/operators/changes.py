"""What changed: trailing months against the year before, before and after updates, and since a last look."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurate.functions.stats import errors_apart, errors_apart_sql
from murmurate.operators.rollups import monthly
from murmurate.plans import adapters as A
from murmurate.registry import register

RECENT, BEFORE = 3, 12
RECENT_FLOOR, BEFORE_FLOOR = 100, 300
BAR, LEAST_GAP = 3, 0.02
WINDOW = 28 * 86_400
SIDE_FLOOR = 100
DAY = 86_400


def month_index(label: Column) -> Column:
    """YYYY-MM as a running number of months; null for anything else."""
    year, month = F.substring(label, 1, 4).try_cast("int"), F.substring(label, 6, 2).try_cast("int")
    return F.when(label.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), year * 12 + month - 1)


def month_label(index: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(index / 12), index % 12 + 1)


def clear(z: Column, gap: Column, bar: float = BAR, least: float = LEAST_GAP) -> Column:
    return (F.abs(z) >= bar) & (F.abs(gap) >= least)


_AT = (int(A.ANCHOR_MONTH[:4]) * 12 + int(A.ANCHOR_MONTH[5:]) - 1)
_MONTH_SQL = "CAST(year(make_timestamp(created * 1000000)) * 12 + month(make_timestamp(created * 1000000)) - 1 AS INT)"


@register("recent_moves", A.with_views("reviews", "sides", body=f"""--and
w AS (SELECT *, CASE WHEN {_MONTH_SQL} BETWEEN {_AT - 2} AND {_AT} THEN 1 WHEN {_MONTH_SQL} BETWEEN {_AT - 14} AND {_AT - 3} THEN 0 END AS side FROM reviews),
t AS (SELECT game, count(*) FILTER (side = 1) AS of_recent, count(*) FILTER (side = 0) AS of_before FROM w GROUP BY game),
s AS (SELECT game, subject, count(*) FILTER (side = 1 AND praise) AS p1, count(*) FILTER (side = 0 AND praise) AS p0, count(*) FILTER (side = 1 AND complaint) AS c1, count(*) FILTER (side = 0 AND complaint) AS c0
      FROM sides JOIN w USING (review) WHERE side IS NOT NULL GROUP BY game, subject),
l AS (SELECT game, subject, 'praise' AS what, p1 AS hit_recent, p0 AS hit_before FROM s UNION ALL SELECT game, subject, 'complaint', c1, c0 FROM s)
SELECT game, subject, what, hit_recent, of_recent, hit_before, of_before, of_recent >= 100 AND of_before >= 300 AS enough,
       round({errors_apart_sql('hit_before', 'of_before', 'hit_recent', 'of_recent')}, 6) AS z FROM l JOIN t USING (game)"""))
def recent_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three months, ending with the anchor month, against the twelve before, by game, subject and side."""
    reviews = A.reviews(spark, sf_dir)
    at = month_index(A.month_of(F.col("created")))
    side = F.when(at.between(_AT - RECENT + 1, _AT), 1).when(at.between(_AT - RECENT - BEFORE + 1, _AT - RECENT), 0)
    dated = reviews.select("review", "game", side.alias("side"))
    totals = dated.groupBy("game").agg(F.count_if(F.col("side") == 1).alias("of_recent"), F.count_if(F.col("side") == 0).alias("of_before"))
    both = F.explode(F.array(F.struct(F.lit("praise").alias("what"), F.col("praise").alias("hit")), F.struct(F.lit("complaint").alias("what"), F.col("complaint").alias("hit"))))
    found = A.sides(A.claims(spark, sf_dir)).join(dated.where(F.col("side").isNotNull()), "review").select("game", "subject", "side", both.alias("x")).groupBy("game", "subject", F.col("x.what").alias("what")).agg(
        F.count_if((F.col("side") == 1) & F.col("x.hit")).alias("hit_recent"), F.count_if((F.col("side") == 0) & F.col("x.hit")).alias("hit_before"))
    z = errors_apart(F.col("hit_before"), F.col("of_before"), F.col("hit_recent"), F.col("of_recent"))
    return found.join(totals, "game").select("game", "subject", "what", "hit_recent", "of_recent", "hit_before", "of_before",
                                             ((F.col("of_recent") >= RECENT_FLOOR) & (F.col("of_before") >= BEFORE_FLOOR)).alias("enough"), F.round(z, 6).alias("z"))


def around(reviews: DataFrame, updates: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each review beside the updates it was written within a window of: before, or at and after.

    A range join by day: an update opens the days of its window, a review meets the updates that opened its day.
    """
    first, last = F.floor((F.col("posted") - window) / DAY), F.floor((F.col("posted") + window - 1) / DAY)
    opened = updates.withColumn("day", F.explode(F.sequence(first, last)))
    near = (F.col("created") >= F.col("posted") - window) & (F.col("created") < F.col("posted") + window)
    met = reviews.withColumn("day", F.floor(F.col("created") / DAY)).join(opened, "day").where(near)
    return met.withColumn("after", F.col("created") >= F.col("posted")).drop("day")


@register("before_after", A.with_views("reviews", "sides", "updates", body=f"""--and
m AS (SELECT name, posted, review, created >= posted AS after, voted_up FROM reviews JOIN updates ON created >= posted - {WINDOW} AND created < posted + {WINDOW}),
t AS (SELECT name, posted, count(*) FILTER (NOT after) AS of_before, count(*) FILTER (after) AS of_after, count(*) FILTER (NOT after AND voted_up) AS up_before, count(*) FILTER (after AND voted_up) AS up_after FROM m GROUP BY name, posted),
s AS (SELECT name, subject, count(*) FILTER (NOT after AND praise) AS praise_before, count(*) FILTER (after AND praise) AS praise_after,
             count(*) FILTER (NOT after AND complaint) AS complaint_before, count(*) FILTER (after AND complaint) AS complaint_after FROM m JOIN sides USING (review) GROUP BY name, subject)
SELECT name, subject, of_before, of_after, up_before, up_after, praise_before, praise_after, complaint_before, complaint_after, of_before >= 100 AND of_after >= 100 AS enough,
       round({errors_apart_sql('praise_before', 'of_before', 'praise_after', 'of_after')}, 6) AS z_praise, round({errors_apart_sql('complaint_before', 'of_before', 'complaint_after', 'of_after')}, 6) AS z_complaint,
       posted + {WINDOW} <= (SELECT max(created) + 1 FROM reviews) AS after_whole FROM s JOIN t USING (name)"""))
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects in the 28 days before and after each update; whether the capture holds the whole time after."""
    reviews = A.reviews(spark, sf_dir)
    met = around(reviews.select("review", "created", "voted_up"), A.updates(spark))
    after = F.col("after")
    totals = met.groupBy("name", "posted").agg(F.count_if(~after).alias("of_before"), F.count_if(after).alias("of_after"), F.count_if(~after & F.col("voted_up")).alias("up_before"), F.count_if(after & F.col("voted_up")).alias("up_after"))
    counts = [F.count_if((after if when == "after" else ~after) & F.col(side)).alias(f"{side}_{when}") for side in ("praise", "complaint") for when in ("before", "after")]
    # Only claims of reviews within a window are summed up.
    near = A.claims(spark, sf_dir).join(met.select("review").distinct(), "review", "left_semi")
    found = met.join(A.sides(near), "review").groupBy("name", "subject").agg(*counts)
    held = reviews.agg((F.max("created") + 1).alias("held_until"))
    df = found.join(totals, "name").join(F.broadcast(held))
    z = {s: errors_apart(F.col(f"{s}_before"), F.col("of_before"), F.col(f"{s}_after"), F.col("of_after")) for s in ("praise", "complaint")}
    return df.select("name", "subject", "of_before", "of_after", "up_before", "up_after", "praise_before", "praise_after", "complaint_before", "complaint_after",
                     ((F.col("of_before") >= SIDE_FLOOR) & (F.col("of_after") >= SIDE_FLOOR)).alias("enough"), F.round(z["praise"], 6).alias("z_praise"), F.round(z["complaint"], 6).alias("z_complaint"),
                     (F.col("posted") + WINDOW <= F.col("held_until")).alias("after_whole"))


@register("nearby_updates", A.with_views("updates", body=f"SELECT a.name, b.name AS other, b.posted - a.posted AS seconds FROM updates a JOIN updates b ON a.name <> b.name AND b.posted >= a.posted - {WINDOW} AND b.posted < a.posted + {WINDOW}"))
def nearby_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other updates within the window of each."""
    u = A.updates(spark)
    b = u.select(F.col("name").alias("other"), F.col("posted").alias("at"))
    near = (F.col("name") != F.col("other")) & (F.col("at") >= F.col("posted") - WINDOW) & (F.col("at") < F.col("posted") + WINDOW)
    return u.join(F.broadcast(b), near).select("name", "other", (F.col("at") - F.col("posted")).alias("seconds"))


def spaced(df: DataFrame, rank: str, at: str, most: int, apart: int, by: str) -> DataFrame:
    """Within each ``by``, the highest ranked rows that lie ``apart`` from every higher kept one, oldest first.

    Greedy, so one group is one call; a group is the updates of one game, some dozens of rows.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in rows.sort_values([rank, at], ascending=[False, True], kind="stable").itertuples(index=False):
            if len(kept) < most and all(abs(getattr(r, at) - getattr(k, at)) >= apart for k in kept):
                kept.append(r)
        return pd.DataFrame(kept, columns=rows.columns).sort_values(at)

    return df.groupBy(by).applyInPandas(pick, df.schema)


@register("biggest_updates", A.with_views("reviews", "updates", body=f"""--and
m AS (SELECT game, name, posted, count(*) AS reviews FROM reviews JOIN updates ON created >= posted AND created < posted + {WINDOW} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY reviews DESC, posted) AS place FROM m),
k(game, place, kept) AS (
  SELECT DISTINCT game, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM r
  UNION ALL SELECT k.game, k.place + 1, CASE WHEN len(kept) < 4 AND len(list_filter(kept, lambda p: abs(p - r.posted) < {WINDOW})) = 0 THEN list_append(kept, r.posted) ELSE kept END FROM k JOIN r ON r.game = k.game AND r.place = k.place + 1)
SELECT r.game, name, posted, reviews FROM r JOIN (SELECT game, arg_max(kept, place) AS kept FROM k GROUP BY game) USING (game) WHERE list_contains(kept, posted)""").replace("WITH ", "WITH RECURSIVE ", 1))
def biggest_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each game's four updates with the most reviews after them, 28 days from each other."""
    met = around(A.reviews(spark, sf_dir).select("review", "created", "game"), A.updates(spark)).where("after")
    return spaced(met.groupBy("game", "name", "posted").agg(F.count(F.lit(1)).alias("reviews")), "reviews", "posted", 4, WINDOW, "game")


@register("timeline", A.with_views("reviews", "updates", body="""--and
m AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS col FROM (SELECT DISTINCT strftime(make_timestamp(created * 1000000), '%Y-%m') AS month FROM reviews)),
u AS (SELECT name, posted, make_timestamp(posted * 1000000) AS t FROM updates)
SELECT name, month, round(col + (posted - epoch(date_trunc('month', t))) / (day(last_day(t)) * 86400.0::DOUBLE), 9) AS position FROM u LEFT JOIN m ON m.month = strftime(t, '%Y-%m')"""))
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each update stands on a chart of the months: its column and how far through the month; null outside."""
    months = A.reviews(spark, sf_dir).select(A.month_of(F.col("created")).alias("month")).distinct()
    months = months.withColumn("col", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("month")) - 1)
    t = F.timestamp_seconds("posted")
    through = (F.col("posted") - F.unix_timestamp(F.date_trunc("month", t))) / (F.dayofmonth(F.last_day(t)) * 86400.0)
    u = A.updates(spark).withColumn("month_of", A.month_of(F.col("posted"))).withColumn("through", through)
    return u.join(months, F.col("month_of") == F.col("month"), "left").select("name", "month", F.round(F.col("col") + F.col("through"), 9).alias("position"))


SEEN = "2000-12"
_SEEN_AT = 2000 * 12 + 11


@register("since_last_look", A.with_views("reviews", "sides", body=f"""--and
w AS (SELECT *, CASE WHEN {_MONTH_SQL} > {_SEEN_AT} THEN 1 WHEN {_MONTH_SQL} BETWEEN {_SEEN_AT - 12} AND {_SEEN_AT - 1} THEN 0 END AS side FROM reviews),
t AS (SELECT game, count(*) FILTER (side = 1) AS new_reviews, count(*) FILTER (side = 0) AS year_reviews, count(*) FILTER (side = 1 AND voted_up) AS new_up, count(*) FILTER (side = 0 AND voted_up) AS year_up FROM w GROUP BY game),
s AS (SELECT game, subject, count(*) FILTER (side = 1 AND complaint) AS new_complaints, count(*) FILTER (side = 0 AND complaint) AS year_complaints FROM sides JOIN w USING (review) WHERE side IS NOT NULL GROUP BY game, subject)
SELECT game, subject, new_reviews, year_reviews, new_complaints, year_complaints, round({errors_apart_sql('year_complaints', 'year_reviews', 'new_complaints', 'new_reviews')}, 6) AS z,
       CASE WHEN new_reviews = 0 THEN 'nothing new' WHEN new_reviews < 100 THEN 'too few new' WHEN year_reviews < 300 THEN 'too few before'
            WHEN abs({errors_apart_sql('year_up', 'year_reviews', 'new_up', 'new_reviews')}) >= 4 THEN 'moved' ELSE 'no clear change' END AS standing
FROM s JOIN t USING (game)"""))
def since_last_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews since a look against the twelve months before the month looked in, which itself is left out."""
    at = month_index(A.month_of(F.col("created")))
    side = F.when(at > _SEEN_AT, 1).when(at.between(_SEEN_AT - 12, _SEEN_AT - 1), 0)
    dated = A.reviews(spark, sf_dir).select("review", "game", "voted_up", side.alias("side"))
    new, year = F.col("side") == 1, F.col("side") == 0
    totals = dated.groupBy("game").agg(F.count_if(new).alias("new_reviews"), F.count_if(year).alias("year_reviews"), F.count_if(new & F.col("voted_up")).alias("new_up"), F.count_if(year & F.col("voted_up")).alias("year_up"))
    found = A.sides(A.claims(spark, sf_dir)).join(dated.where(F.col("side").isNotNull()), "review").groupBy("game", "subject").agg(
        F.count_if(new & F.col("complaint")).alias("new_complaints"), F.count_if(year & F.col("complaint")).alias("year_complaints"))
    df = found.join(totals, "game")
    moved = F.abs(errors_apart(F.col("year_up"), F.col("year_reviews"), F.col("new_up"), F.col("new_reviews"))) >= 4
    standing = F.when(F.col("new_reviews") == 0, "nothing new").when(F.col("new_reviews") < RECENT_FLOOR, "too few new").when(F.col("year_reviews") < BEFORE_FLOOR, "too few before").when(moved, "moved").otherwise("no clear change")
    z = errors_apart(F.col("year_complaints"), F.col("year_reviews"), F.col("new_complaints"), F.col("new_reviews"))
    return df.select("game", "subject", "new_reviews", "year_reviews", "new_complaints", "year_complaints", F.round(z, 6).alias("z"), standing.alias("standing"))


@register("moved_first", A.with_views("reviews", body=f"""--and
t AS (SELECT game, count(*) FILTER ({_MONTH_SQL} > {_SEEN_AT}) AS new_reviews, count(*) FILTER ({_MONTH_SQL} BETWEEN {_SEEN_AT - 12} AND {_SEEN_AT - 1}) AS year_reviews,
             count(*) FILTER (voted_up AND {_MONTH_SQL} > {_SEEN_AT}) AS new_up, count(*) FILTER (voted_up AND {_MONTH_SQL} BETWEEN {_SEEN_AT - 12} AND {_SEEN_AT - 1}) AS year_up FROM reviews GROUP BY game),
z AS (SELECT *, {errors_apart_sql('year_up', 'year_reviews', 'new_up', 'new_reviews')} AS z FROM t)
SELECT game, new_reviews, round(z, 6) AS z, row_number() OVER (ORDER BY abs(z) >= 1 DESC, new_reviews DESC, game) AS place, new_reviews > 0 AND new_reviews >= year_reviews / 100.0::DOUBLE AS due FROM z"""))
def moved_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games whose share of recommendations moved come first, then those with the most new reviews; due at a hundredth of the old."""
    at = month_index(A.month_of(F.col("created")))
    new, year, up = at > _SEEN_AT, at.between(_SEEN_AT - 12, _SEEN_AT - 1), F.col("voted_up")
    df = A.reviews(spark, sf_dir).groupBy("game").agg(F.count_if(new).alias("new_reviews"), F.count_if(year).alias("year_reviews"), F.count_if(new & up).alias("new_up"), F.count_if(year & up).alias("year_up"))
    df = df.withColumn("zz", errors_apart(F.col("year_up"), F.col("year_reviews"), F.col("new_up"), F.col("new_reviews")))
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("zz") >= 1), F.desc("new_reviews"), "game"))
    return df.select("game", "new_reviews", F.round("zz", 6).alias("z"), place.alias("place"), ((F.col("new_reviews") > 0) & (F.col("new_reviews") >= F.col("year_reviews") / 100.0)).alias("due"))


@register("month_running", A.with_views("reviews", "sides", body="""--and
r AS (SELECT review, game, strftime(make_timestamp(created * 1000000), '%Y-%m') AS month FROM reviews),
m AS (SELECT game, month, count(DISTINCT review) AS raising FROM sides JOIN r USING (review) WHERE complaint GROUP BY game, month)
SELECT game, month, raising, CAST(sum(raising) OVER (PARTITION BY game ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS so_far, lag(raising) OVER (PARTITION BY game ORDER BY month) AS month_before FROM m"""))
def month_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with a complaint by game and month, running and beside the month before."""
    dated = A.reviews(spark, sf_dir).select("review", "game", A.month_of(F.col("created")).alias("month"))
    df = A.sides(A.claims(spark, sf_dir)).where("complaint").join(dated, "review").groupBy("game", "month").agg(F.countDistinct("review").alias("raising"))
    w = W.partitionBy("game").orderBy("month")
    return df.select("game", "month", "raising", F.sum("raising").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("so_far"), F.lag("raising").over(w).alias("month_before"))


@register("since_totals", A.with_views("reviews", "sides", body=f"""
SELECT subject, CAST(count(*) - count(*) FILTER (strftime(make_timestamp(created * 1000000), '%Y-%m') <= '{SEEN}') AS BIGINT) AS new FROM sides JOIN reviews USING (review) GROUP BY subject"""))
def since_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference of two snapshots of the monthly rollup, never under zero, as a page that was seen before shows it."""
    now = monthly(A.reviews(spark, sf_dir), A.sides(A.claims(spark, sf_dir))).groupBy("subject").agg(F.sum("raising").alias("now"))
    seen = monthly(A.reviews(spark, sf_dir).where(A.month_of(F.col("created")) <= SEEN), A.sides(A.claims(spark, sf_dir))).groupBy("subject").agg(F.sum("raising").alias("seen"))
    return now.join(seen, "subject", "left").select("subject", F.greatest(F.lit(0).cast("long"), F.col("now") - F.coalesce("seen", F.lit(0))).alias("new"))
