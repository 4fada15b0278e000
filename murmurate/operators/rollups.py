"""How often subjects are raised, praised and criticised: over the corpus, by month, by segment and by product."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurate.functions.stats import errors_apart, errors_apart_sql, ratio, wilson, wilson_sql
from murmurate.plans import adapters as A
from murmurate.registry import register

#: Segments: (split, kind, least and most minutes played) and the flags.
PLAYED = (("under-2-hours", 0, 120), ("2-to-10-hours", 120, 600), ("10-to-30-hours", 600, 1800), ("30-to-100-hours", 1800, 6000), ("100-hours-or-more", 6000, None))
FLAGS = (("deck", "steam-deck", "elsewhere"), ("early", "early-access", "after-release"), ("free", "got-it-free", "paid-for-it"))
SPLIT_OF = {k: "played" for k, *_ in PLAYED} | {k: f for f, a, b in FLAGS for k in (a, b)}
TOP = 50
MONTH_FLOOR, SEGMENT_FLOOR = 30, 100
_LOW, _HIGH = wilson_sql("mention_reviews", "reviews")


def per_subject(sides: DataFrame, reviews: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each subject over reviews (a review counts once), optionally within the columns ``by`` of reviews.

    praised, criticised and mixed exclude each other; a review that only names a subject is in none of them.
    """
    facts = sides.join(reviews, "review")
    p, c = F.col("praise"), F.col("complaint")
    return facts.groupBy(*by, "subject").agg(
        F.count(F.lit(1)).alias("mention_reviews"), F.count_if(p & ~c).alias("praised"), F.count_if(c & ~p).alias("criticised"),
        F.count_if(p & c).alias("mixed"), F.sum("n_claims").alias("claims"), F.count_if(F.col("voted_up")).alias("positive_mentions"))


@register("mention_rate", A.with_views("reviews", "sides", body=f"""--and
c AS (SELECT subject, count(*) AS mention_reviews, count(*) FILTER (praise AND NOT complaint) AS praised, count(*) FILTER (complaint AND NOT praise) AS criticised,
             count(*) FILTER (praise AND complaint) AS mixed, CAST(sum(n_claims) AS BIGINT) AS claims, count(*) FILTER (voted_up) AS positive_mentions
      FROM sides JOIN reviews USING (review) GROUP BY subject),
n AS (SELECT count(*) AS reviews FROM reviews)
SELECT subject, mention_reviews, praised, criticised, mixed, claims, positive_mentions, round(mention_reviews / reviews, 9) AS rate,
       round(positive_mentions / mention_reviews, 9) AS positive_share, round({_LOW}, 9) AS low, round({_HIGH}, 9) AS high FROM c, n"""))
def mention_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every subject's figures over all reviews."""
    reviews = A.reviews(spark, sf_dir)
    counts = per_subject(A.sides(A.claims(spark, sf_dir)), reviews.select("review", "voted_up"))
    total = reviews.select(F.count(F.lit(1)).alias("reviews"))  # one row
    df = counts.join(F.broadcast(total))
    low, high = wilson(F.col("mention_reviews"), F.col("reviews"))
    return df.select("subject", "mention_reviews", "praised", "criticised", "mixed", "claims", "positive_mentions",
                     F.round(ratio(F.col("mention_reviews"), F.col("reviews")), 9).alias("rate"),
                     F.round(ratio(F.col("positive_mentions"), F.col("mention_reviews")), 9).alias("positive_share"),
                     F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@register("corpus_totals", A.with_views("reviews", "verdicts", body="""
SELECT count(*) AS reviews, count(*) FILTER (voted_up) AS positive, CAST(coalesce(sum(n_claims), 0) AS BIGINT) AS claims, CAST(coalesce(sum(declined), 0) AS BIGINT) AS unclassified,
       count(*) FILTER (coalesce(silent, true)) AS silent, count(*) FILTER (n_claims IS NULL) AS claimless,
       round(CAST(sum(declined) AS DOUBLE) / sum(n_claims), 9) AS unclassified_share
FROM reviews LEFT JOIN verdicts USING (review)"""))
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the corpus: reviews without a subject are silent, those without a claim claimless as well."""
    df = A.reviews(spark, sf_dir).join(A.verdicts(A.claims(spark, sf_dir)), "review", "left")
    return df.agg(
        F.count(F.lit(1)).alias("reviews"), F.count_if("voted_up").alias("positive"), F.coalesce(F.sum("n_claims"), F.lit(0)).alias("claims"),
        F.coalesce(F.sum("declined"), F.lit(0)).alias("unclassified"), F.count_if(F.coalesce("silent", F.lit(True))).alias("silent"),
        F.count_if(F.col("n_claims").isNull()).alias("claimless"), F.round(F.sum("declined") / F.sum("n_claims"), 9).alias("unclassified_share"))


@register("declined_by_game", A.with_views("reviews", "verdicts", body="""--and
g AS (SELECT game, CAST(sum(n_claims) AS BIGINT) AS claims, CAST(sum(declined) AS BIGINT) AS declined FROM reviews JOIN verdicts USING (review) GROUP BY game),
t AS (SELECT *, declined / claims AS share, sum(declined) OVER () / sum(claims) OVER () AS usual FROM g)
SELECT game, claims, declined, round(share, 9) AS share, round(share / usual, 9) AS times_usual, share >= 1.2::DOUBLE * usual AND share - usual >= 0.05::DOUBLE AS unusual FROM t"""))
def declined_by_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each game's share of declined claims beside the usual one; unusual at 1.2 times and 5 points more."""
    df = A.reviews(spark, sf_dir).join(A.verdicts(A.claims(spark, sf_dir)), "review").groupBy("game").agg(
        F.sum("n_claims").alias("claims"), F.sum("declined").alias("declined"))
    all_games = W.partitionBy(F.lit(0))
    df = df.withColumn("s", F.col("declined") / F.col("claims")).withColumn("usual", F.sum("declined").over(all_games) / F.sum("claims").over(all_games))
    return df.select("game", "claims", "declined", F.round("s", 9).alias("share"), F.round(F.col("s") / F.col("usual"), 9).alias("times_usual"),
                     ((F.col("s") >= 1.2 * F.col("usual")) & (F.col("s") - F.col("usual") >= 0.05)).alias("unusual"))


@register("primary_subjects", A.with_views("verdicts", body="SELECT primary_subject, count(*) AS reviews FROM verdicts GROUP BY primary_subject"))
def primary_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews by the subject of their surest answered claim, the first of equals; null where none was answered."""
    return A.verdicts(A.claims(spark, sf_dir)).groupBy("primary_subject").agg(F.count(F.lit(1)).alias("reviews"))


def most_helpful(reviews: DataFrame, top: int = TOP, *by: str) -> DataFrame:
    """The reviews at the top of the pile: helpfulness descending, ties in the order of ids.

    Scores are compared by their bits, as the pile is kept: scores under zero come before all others.
    """
    order = [F.when(F.col("helpfulness") < 0, 0).otherwise(1), F.when(F.col("helpfulness") < 0, F.col("helpfulness")).otherwise(-F.col("helpfulness")), F.col("review")]
    if not by:
        return reviews.orderBy(*order).limit(top)
    return reviews.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= top).drop("place")


@register("helpfulness_bias", A.with_views("reviews", "sides", body="""--and
top AS (SELECT review FROM reviews ORDER BY helpfulness DESC, review LIMIT 50),
m AS (SELECT subject, count(*) AS mentions, count(*) FILTER (review IN (SELECT review FROM top)) AS top_mentions FROM sides GROUP BY subject),
r AS (SELECT *, (SELECT count(*) FROM reviews) AS n FROM m)
SELECT subject, mentions, top_mentions, round((top_mentions / least(50, n)) / (mentions / n), 9) AS bias,
       top_mentions >= greatest(CAST(ceil(least(50, n) / 10) AS BIGINT), 2) AS counted FROM r"""))
def helpfulness_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more often the most helpful reviews raise a subject; counted from a tenth of them, two at least."""
    reviews = A.reviews(spark, sf_dir)
    top = most_helpful(reviews).select("review", F.lit(True).alias("top"))  # 50 rows
    df = A.sides(A.claims(spark, sf_dir)).join(F.broadcast(top), "review", "left").groupBy("subject").agg(
        F.count(F.lit(1)).alias("mentions"), F.count_if(F.col("top")).alias("top_mentions"))
    df = df.join(F.broadcast(reviews.select(F.count(F.lit(1)).alias("n"))))
    pile = F.least(F.lit(TOP), F.col("n"))
    bias = (F.col("top_mentions") / pile) / (F.col("mentions") / F.col("n"))
    return df.select("subject", "mentions", "top_mentions", F.round(bias, 9).alias("bias"),
                     (F.col("top_mentions") >= F.greatest(F.ceil(pile / 10), F.lit(2))).alias("counted"))


@register("language_histogram", A.with_views("reviews", body="SELECT language, count(*) AS reviews, count(*) FILTER (voted_up) AS positive FROM reviews GROUP BY language ORDER BY reviews DESC, language"))
def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews by language, most first, names in order; counted before any language is chosen."""
    return A.reviews(spark, sf_dir).groupBy("language").agg(F.count(F.lit(1)).alias("reviews"), F.count_if("voted_up").alias("positive")).orderBy(F.desc("reviews"), "language")


@register("one_language", A.with_views("reviews", "sides", body="""--and
k AS (SELECT review FROM reviews WHERE language = 'NATION_7')
SELECT subject, count(*) AS mention_reviews, (SELECT count(*) FROM reviews) AS corpus_reviews, (SELECT count(*) FROM k) AS reviews FROM sides JOIN k USING (review) GROUP BY subject"""))
def one_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects in one language beside the size of the whole corpus, which is counted before the choice."""
    reviews = A.reviews(spark, sf_dir)
    totals = reviews.agg(F.count(F.lit(1)).alias("corpus_reviews"), F.count_if(F.col("language") == "NATION_7").alias("reviews"))
    chosen = A.sides(A.claims(spark, sf_dir)).join(reviews.where(F.col("language") == "NATION_7").select("review"), "review", "left_semi")
    return chosen.groupBy("subject").agg(F.count(F.lit(1)).alias("mention_reviews")).join(F.broadcast(totals)).select("subject", "mention_reviews", "corpus_reviews", "reviews")


MONTHLY = A.with_views("reviews", "sides", body="""--and
r AS (SELECT *, strftime(make_timestamp(created * 1000000), '%Y-%m') AS month FROM reviews),
t AS (SELECT month, count(*) AS reviews, count(*) FILTER (voted_up) AS positive FROM r GROUP BY month),
s AS (SELECT month, subject, count(*) AS raising, count(*) FILTER (praise) AS praising, count(*) FILTER (complaint) AS complaining FROM sides JOIN r USING (review) GROUP BY month, subject)
SELECT month, subject, reviews, positive, raising, praising, complaining FROM s JOIN t USING (month)""")


def monthly(reviews: DataFrame, sides: DataFrame, *by: str) -> DataFrame:
    """Per month and subject: reviews that raise, praise and complain of it (mixed ones in both), beside the month's totals."""
    dated = reviews.withColumn("month", A.month_of(F.col("created")))
    totals = dated.groupBy(*by, "month").agg(F.count(F.lit(1)).alias("reviews"), F.count_if("voted_up").alias("positive"))
    found = sides.join(dated.select(*by, "review", "month"), "review").groupBy(*by, "month", "subject").agg(
        F.count(F.lit(1)).alias("raising"), F.count_if("praise").alias("praising"), F.count_if("complaint").alias("complaining"))
    return found.join(totals, [*by, "month"])


@register("monthly_subjects", MONTHLY)
def monthly_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month's figures by subject, long form."""
    return monthly(A.reviews(spark, sf_dir), A.sides(A.claims(spark, sf_dir))).select("month", "subject", "reviews", "positive", "raising", "praising", "complaining")


@register("month_shares", A.with_views("reviews", body="""--and
t AS (SELECT strftime(make_timestamp(created * 1000000), '%Y-%m') AS month, count(*) AS reviews, count(*) FILTER (voted_up) AS positive FROM reviews GROUP BY 1),
s AS (SELECT *, CASE WHEN reviews >= 30 THEN positive / reviews END AS share FROM t)
SELECT month, reviews, positive, round(share, 9) AS share, month = (SELECT month FROM s WHERE share IS NOT NULL ORDER BY share, month LIMIT 1) AS worst,
       month = (SELECT month FROM s ORDER BY reviews DESC, month LIMIT 1) AS busiest FROM s"""))
def month_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months with their share of positive reviews, null under 30 reviews; the worst and the busiest are marked."""
    df = A.reviews(spark, sf_dir).groupBy(A.month_of(F.col("created")).alias("month")).agg(F.count(F.lit(1)).alias("reviews"), F.count_if("voted_up").alias("positive"))
    df = df.withColumn("s", F.when(F.col("reviews") >= MONTH_FLOOR, F.col("positive") / F.col("reviews")))
    whole = W.partitionBy(F.lit(0))
    worst = F.min_by("month", F.when(F.col("s").isNotNull(), F.struct("s", "month"))).over(whole)
    busiest = F.min_by("month", F.struct(-F.col("reviews"), F.col("month"))).over(whole)
    return df.select("month", "reviews", "positive", F.round("s", 9).alias("share"), (F.col("month") == worst).alias("worst"), (F.col("month") == busiest).alias("busiest"))


def kinds_of():
    """The segments a reviewer belongs to, one of each split but none of the played one without minutes."""
    found = [F.when((F.col("played") >= a) & (F.lit(True) if b is None else F.col("played") < b), F.lit(k)) for k, a, b in PLAYED]
    found += [F.when(F.coalesce(F.col(flag), F.lit(False)), F.lit(yes)).otherwise(F.lit(no)) for flag, yes, no in FLAGS]
    return F.array_compact(F.array(*found))


def by_kind(reviews: DataFrame) -> DataFrame:
    """A row a review and segment, with the split of the segment."""
    df = reviews.withColumn("kind", F.explode(kinds_of()))
    split = F.element_at(F.create_map(*[F.lit(x) for k, s in SPLIT_OF.items() for x in (k, s)]), F.col("kind"))
    return df.withColumn("split", split)


KINDS_SQL = """kinds AS (
  SELECT review, voted_up, created, 'played' AS split, CASE WHEN played < 120 THEN 'under-2-hours' WHEN played < 600 THEN '2-to-10-hours' WHEN played < 1800 THEN '10-to-30-hours'
         WHEN played < 6000 THEN '30-to-100-hours' ELSE '100-hours-or-more' END AS kind FROM reviews WHERE played IS NOT NULL
  UNION ALL SELECT review, voted_up, created, 'deck', CASE WHEN deck THEN 'steam-deck' ELSE 'elsewhere' END FROM reviews
  UNION ALL SELECT review, voted_up, created, 'early', CASE WHEN early THEN 'early-access' ELSE 'after-release' END FROM reviews
  UNION ALL SELECT review, voted_up, created, 'free', CASE WHEN free THEN 'got-it-free' ELSE 'paid-for-it' END FROM reviews),
seg AS (SELECT split, kind, subject, count(*) AS raised, count(*) FILTER (praise AND NOT complaint) AS praised, count(*) FILTER (complaint AND NOT praise) AS criticised,
               count(*) FILTER (praise AND complaint) AS mixed, count(*) FILTER (voted_up) AS recommending, CAST(sum(n_claims) AS BIGINT) AS claims_about
        FROM kinds JOIN sides USING (review) GROUP BY split, kind, subject),
heads AS (SELECT split, kind, count(*) AS reviews, count(*) FILTER (voted_up) AS positive FROM kinds GROUP BY split, kind)"""


def segment_heads(reviews: DataFrame) -> DataFrame:
    return by_kind(reviews).groupBy("split", "kind").agg(F.count(F.lit(1)).alias("reviews"), F.count_if("voted_up").alias("positive"))


def segment_subjects(reviews: DataFrame, sides: DataFrame) -> DataFrame:
    """Each subject's figures once more within every segment; segments of different splits overlap.

    Reviews are joined once, with all their segments in one array, counted by that array (some dozens of different
    ones) and only then taken apart.
    """
    df = per_subject(sides, reviews.select("review", "voted_up", kinds_of().alias("kinds")), ("kinds",))
    counts = [c for c in df.columns if c not in ("kinds", "subject")]
    split = F.element_at(F.create_map(*[F.lit(x) for k, s in SPLIT_OF.items() for x in (k, s)]), F.col("kind"))
    df = df.withColumn("kind", F.explode("kinds")).withColumn("split", split).groupBy("split", "kind", "subject").agg(*[F.sum(c).alias(c) for c in counts])
    return df.withColumnsRenamed({"mention_reviews": "raised", "positive_mentions": "recommending", "claims": "claims_about"})


@register("segments", A.with_views("reviews", "sides", body="--and\n" + KINDS_SQL + " SELECT * FROM seg"))
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment rollup."""
    return segment_subjects(A.reviews(spark, sf_dir), A.sides(A.claims(spark, sf_dir)))


@register("segment_list", A.with_views("reviews", "sides", body="--and\n" + KINDS_SQL + """,
o AS (SELECT *, sum(reviews) OVER w - reviews AS other, sum(positive) OVER w - positive AS other_positive FROM heads WINDOW w AS (PARTITION BY split))
SELECT split, kind, reviews, positive, reviews >= 100 AS enough, round(positive / reviews - other_positive / other, 9) AS recommended_gap FROM o"""))
def segment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of reviewers, whether enough of them wrote, and how much oftener they recommend than the rest of their split."""
    rest = W.partitionBy("split")
    df = segment_heads(A.reviews(spark, sf_dir)).withColumn("other", F.sum("reviews").over(rest) - F.col("reviews")).withColumn("op", F.sum("positive").over(rest) - F.col("positive"))
    return df.select("split", "kind", "reviews", "positive", (F.col("reviews") >= SEGMENT_FLOOR).alias("enough"), F.round(F.col("positive") / F.col("reviews") - F.col("op") / F.col("other"), 9).alias("recommended_gap"))


def against_the_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment's subjects beside all others of its split: counts and standard errors apart."""
    reviews = A.reviews(spark, sf_dir)
    rest = W.partitionBy("split")
    heads = segment_heads(reviews).withColumn("other_reviews", F.sum("reviews").over(rest) - F.col("reviews"))
    found = segment_subjects(reviews, A.sides(A.claims(spark, sf_dir)))
    grid = heads.join(found.select("subject").distinct()).join(found, ["split", "kind", "subject"], "left").fillna(0)
    same = W.partitionBy("split", "subject")
    for name, one in (("raised", F.col("raised")), ("praises", F.col("praised") + F.col("mixed")), ("complains", F.col("criticised") + F.col("mixed"))):
        other = F.sum(one).over(same) - one
        grid = grid.withColumn(f"n_{name}", one).withColumn(f"other_{name}", other).withColumn(f"z_{name}", errors_apart(other, F.col("other_reviews"), one, F.col("reviews")))
    return grid


_GRID_SQL = KINDS_SQL + """,
g AS (SELECT h.split, h.kind, s.subject, h.reviews, sum(h.reviews) OVER w - h.reviews AS other_reviews, coalesce(raised, 0) AS raised,
             coalesce(praised + mixed, 0) AS praises, coalesce(criticised + mixed, 0) AS complains
      FROM heads h CROSS JOIN (SELECT DISTINCT subject FROM seg) s LEFT JOIN seg ON h.split = seg.split AND h.kind = seg.kind AND s.subject = seg.subject WINDOW w AS (PARTITION BY h.split, s.subject)),
o AS (SELECT *, sum(raised) OVER w - raised AS other_raised, sum(praises) OVER w - praises AS other_praises, sum(complains) OVER w - complains AS other_complains FROM g WINDOW w AS (PARTITION BY split, subject))"""


@register("segment_comparison", A.with_views("reviews", "sides", body="--and\n" + _GRID_SQL + f"""
SELECT split, kind, subject, CAST(raised AS BIGINT) AS raised, CAST(other_raised AS BIGINT) AS other_raised, round({errors_apart_sql('other_raised', 'other_reviews', 'raised', 'reviews')}, 6) AS z_raised,
       round({errors_apart_sql('other_praises', 'other_reviews', 'praises', 'reviews')}, 6) AS z_praises, round({errors_apart_sql('other_complains', 'other_reviews', 'complains', 'reviews')}, 6) AS z_complains,
       reviews >= 100 AND other_reviews >= 100 AS enough FROM o"""))
def segment_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of reviewer against everyone else of its split, subject by subject."""
    df = against_the_rest(spark, sf_dir)
    return df.select("split", "kind", "subject", F.col("n_raised").alias("raised"), "other_raised", *[F.round(f"z_{n}", 6).alias(f"z_{n}") for n in ("raised", "praises", "complains")],
                     ((F.col("reviews") >= SEGMENT_FLOOR) & (F.col("other_reviews") >= SEGMENT_FLOOR)).alias("enough"))


#: How clear and how wide a gap between a kind of reviewer and the rest must be to be a finding.
FINDING_BAR, FINDING_GAP = 4.0, 0.02


def _findings_sql(bar: float, gap: float) -> str:
    return A.with_views("reviews", "sides", body="--and\n" + _GRID_SQL + f""",
l AS (SELECT split, kind, subject, 'praises' AS what, praises AS n, reviews, other_praises AS other_n, other_reviews, {errors_apart_sql('other_praises', 'other_reviews', 'praises', 'reviews')} AS z FROM o
      UNION ALL SELECT split, kind, subject, 'complains', complains, reviews, other_complains, other_reviews, {errors_apart_sql('other_complains', 'other_reviews', 'complains', 'reviews')} FROM o)
SELECT kind, subject, what, round(z, 6) AS z, round(n / reviews - other_n / other_reviews, 9) AS gap FROM l
WHERE reviews >= 100 AND other_reviews >= 100 AND abs(z) >= {bar}::DOUBLE AND abs(n / reviews - other_n / other_reviews) >= {gap}::DOUBLE AND kind NOT IN ('elsewhere', 'after-release', 'paid-for-it') AND subject <> 'Brand#55'""")


def findings(grid: DataFrame, bar: float = FINDING_BAR, gap: float = FINDING_GAP, floor: int = SEGMENT_FLOOR, left_out: tuple[str, ...] = ()) -> DataFrame:
    """Clear gaps of a grid of kinds against the rest, two-way splits tested once and some subjects left out, clearest first."""
    df = grid.where((F.col("reviews") >= floor) & (F.col("other_reviews") >= floor) & ~F.col("subject").isin(*left_out) & ~F.col("kind").isin(*[no for *_, no in FLAGS]))
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.col(f"z_{n}").alias("z"), (F.col(f"n_{n}") / F.col("reviews") - F.col(f"other_{n}") / F.col("other_reviews")).alias("gap")) for n in ("praises", "complains")]))
    df = df.select("kind", "subject", sides.alias("x")).select("kind", "subject", "x.what", "x.z", "x.gap")
    return df.where((F.abs("z") >= bar) & (F.abs("gap") >= gap)).orderBy(F.desc(F.abs("z"))).select("kind", "subject", "what", F.round("z", 6).alias("z"), F.round("gap", 9).alias("gap"))


@register("segment_findings", _findings_sql(FINDING_BAR, FINDING_GAP))
def segment_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a kind of reviewer says clearly more or less than the rest."""
    return findings(against_the_rest(spark, sf_dir), left_out=("Brand#55",))


@register("segment_findings_low", _findings_sql(1.5, 0.005))
def segment_findings_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at bars low enough for small tables to have findings."""
    return findings(against_the_rest(spark, sf_dir), 1.5, 0.005, left_out=("Brand#55",))


_SHARE_LOW = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, {m} - 1.959963985::DOUBLE * sqrt({v}) / k))"


@register("across_games", A.with_views("reviews", "sides", body=f"""--and
g AS (SELECT game, count(*) AS n FROM reviews GROUP BY game),
s AS (SELECT game, subject, count(*) AS raised, count(*) FILTER (praise) AS praising FROM sides JOIN reviews USING (review) GROUP BY game, subject),
x AS (SELECT g.game, u.subject, n, coalesce(raised, 0) AS raised, coalesce(praising, 0) AS praising, coalesce(raised, 0) / n AS rate
      FROM g CROSS JOIN (SELECT DISTINCT subject FROM s) u LEFT JOIN s ON s.game = g.game AND s.subject = u.subject),
a AS (SELECT subject, avg(rate) AS mean_rate, sum(rate * (1 - rate) / n) AS v, count(*) AS k, count(*) FILTER (rate >= 0.01::DOUBLE) AS raised_in, first(game ORDER BY rate DESC, game) AS most,
             avg(praising / raised) FILTER (raised >= 30) AS lean, CAST(sum(raised) AS BIGINT) AS pooled_raised, CAST(sum(n) AS BIGINT) AS pooled_n, max(rate) - min(rate) AS apart FROM x GROUP BY subject)
SELECT subject, round(mean_rate, 9) AS mean_rate, round({_SHARE_LOW.format(m='mean_rate', v='v')}, 9) AS mean_low, raised_in, most, round(lean, 9) AS lean, pooled_raised,
       round(pooled_raised / pooled_n, 9) AS pooled_rate, round({wilson_sql('pooled_raised', 'pooled_n')[0]}, 9) AS pooled_low, round(apart, 9) AS apart FROM a"""))
def across_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject over a group of games both ways: each game the same, and every review the same."""
    reviews = A.reviews(spark, sf_dir)
    games = reviews.groupBy("game").agg(F.count(F.lit(1)).alias("n"))
    found = A.sides(A.claims(spark, sf_dir)).join(reviews.select("review", "game"), "review").groupBy("game", "subject").agg(
        F.count(F.lit(1)).alias("raised"), F.count_if("praise").alias("praising"))
    grid = games.join(found.select("subject").distinct()).join(found, ["game", "subject"], "left").fillna(0).withColumn("rate", F.col("raised") / F.col("n"))
    df = grid.groupBy("subject").agg(
        F.avg("rate").alias("m"), F.sum(F.col("rate") * (1 - F.col("rate")) / F.col("n")).alias("v"), F.count(F.lit(1)).alias("k"), F.count_if(F.col("rate") >= 0.01).alias("raised_in"),
        F.min_by("game", F.struct(-F.col("rate"), F.col("game"))).alias("most"), F.avg(F.when(F.col("raised") >= 30, F.col("praising") / F.col("raised"))).alias("lean"),
        F.sum("raised").alias("pooled_raised"), F.sum("n").alias("pooled_n"), (F.max("rate") - F.min("rate")).alias("apart"))
    low, _ = wilson(F.col("pooled_raised"), F.col("pooled_n"))
    mean_low = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("m") - 1.959963985 * F.sqrt("v") / F.col("k")))
    return df.select("subject", F.round("m", 9).alias("mean_rate"), F.round(mean_low, 9).alias("mean_low"), "raised_in", "most", F.round("lean", 9).alias("lean"), "pooled_raised",
                     F.round(F.col("pooled_raised") / F.col("pooled_n"), 9).alias("pooled_rate"), F.round(low, 9).alias("pooled_low"), F.round("apart", 9).alias("apart"))


@register("library_overview", A.with_views("reviews", "verdicts", body="""
SELECT game, count(*) AS reviews, CAST(coalesce(sum(n_claims), 0) AS BIGINT) AS claims, round(count(*) FILTER (voted_up) / count(*), 9) AS recommended, min(created) AS first_review, max(created) AS newest_review,
       count(DISTINCT author) AS authors, count(DISTINCT language) AS languages FROM reviews LEFT JOIN verdicts USING (review) GROUP BY game"""))
def library_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line a game: sizes, share recommended and the span of its reviews."""
    df = A.reviews(spark, sf_dir).join(A.verdicts(A.claims(spark, sf_dir)), "review", "left")
    return df.groupBy("game").agg(F.count(F.lit(1)).alias("reviews"), F.coalesce(F.sum("n_claims"), F.lit(0)).alias("claims"), F.round(F.count_if("voted_up") / F.count(F.lit(1)), 9).alias("recommended"),
                                  F.min("created").alias("first_review"), F.max("created").alias("newest_review"), F.countDistinct("author").alias("authors"), F.countDistinct("language").alias("languages"))
