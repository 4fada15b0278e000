"""Selective prediction: how well a reader that may decline does, at what coverage, and where to draw its lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurate.functions.stats import Z_ROUNDED, softmax, wilson, wilson_sql
from murmurate.plans import adapters as A
from murmurate.registry import register

FLOOR = 0.75
BINS = 15
SHARED_UNDER = 40


@register("risk_coverage", A.with_views("scored", body="""--and
t AS (SELECT unnest(range(5, 100)) / 100 AS threshold),
c AS (SELECT threshold, count(*) FILTER (confidence >= threshold) AS answered, count(*) FILTER (confidence >= threshold AND correct) AS right_, count(*) AS n FROM t, scored GROUP BY threshold)
SELECT round(threshold, 2) AS threshold, answered, round(answered / n, 9) AS coverage, round(right_ / nullif(answered, 0), 9) AS accuracy FROM c"""))
def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and accuracy at thresholds 0.05 to 0.99, from one count a confidence level."""
    levels = A.scored(spark, sf_dir).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("right"))
    levels = levels.join(F.broadcast(levels.agg(F.sum("n").alias("all"))))
    grid = levels.withColumn("step", F.explode(F.sequence(F.lit(5), F.lit(99)))).withColumn("threshold", F.col("step") / 100)
    hit = F.col("confidence") >= F.col("threshold")
    df = grid.groupBy("threshold").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("answered"), F.sum(F.when(hit, F.col("right")).otherwise(0)).alias("right"), F.first("all").alias("all"))
    return df.select(F.round("threshold", 2).alias("threshold"), "answered", F.round(F.col("answered") / F.col("all"), 9).alias("coverage"),
                     F.round(F.when(F.col("answered") > 0, F.col("right") / F.col("answered")), 9).alias("accuracy"))


#: Cells of the confidence scale that running counts are kept in; levels are ordered within a cell only.
CELLS = 4096


def cumulative(levels: DataFrame, *by: str) -> DataFrame:
    """Running counts from the highest confidence down, a block of ties at once; from (confidence, n, right).

    In two steps: cells of the scale are summed up first, at most ``CELLS`` rows a group, and then levels within each.
    """
    df = levels.withColumn("cell", F.floor(F.col("confidence") * CELLS))
    down = W.partitionBy(*by or [F.lit(0)]).orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, -1)
    cells = df.groupBy(*by, "cell").agg(F.sum("n").alias("n_cell"), F.sum("right").alias("right_cell"))
    cells = cells.select(*by, "cell", *[F.coalesce(F.sum(f"{c}_cell").over(down), F.lit(0)).alias(f"{c}_above") for c in ("n", "right")])
    w = W.partitionBy(*by, "cell").orderBy(F.desc("confidence")).rowsBetween(W.unboundedPreceding, 0)
    df = df.join(cells, [*by, "cell"])
    return df.withColumn("answered", F.col("n_above") + F.sum("n").over(w)).withColumn("right_so_far", F.col("right_above") + F.sum("right").over(w)).drop("cell", "n_above", "right_above")


_LEVELS = """l AS (SELECT confidence, count(*) AS n, count(*) FILTER (correct) AS r FROM scored GROUP BY confidence),
c AS (SELECT *, sum(n) OVER w AS answered, sum(r) OVER w AS right_ FROM l WINDOW w AS (ORDER BY confidence DESC))"""


def confidence_levels(scored: DataFrame, *by: str) -> DataFrame:
    return scored.groupBy(*by, "confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("right"))


@register("risk_areas", A.with_views("scored", body="--and\n" + _LEVELS + """
SELECT round(sum(n * (1 - right_ / answered)) / sum(n), 9) AS aurc, round(sum(n * (answered - right_) / (SELECT count(*) FROM scored)) / sum(n), 9) AS augrc FROM c"""))
def risk_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas under the risk-coverage curve and its generalised form; ties count as one block."""
    df = cumulative(confidence_levels(A.scored(spark, sf_dir)))
    df = df.join(F.broadcast(df.agg(F.sum("n").alias("all"))))
    risk = F.sum(F.col("n") * (1 - F.col("right_so_far") / F.col("answered"))) / F.sum("n")
    general = F.sum(F.col("n") * (F.col("answered") - F.col("right_so_far")) / F.col("all")) / F.sum("n")
    return df.agg(F.round(risk, 9).alias("aurc"), F.round(general, 9).alias("augrc"))


@register("calibration_error", A.with_views("scored", body="""--and
b AS (SELECT ceil(confidence * 15) AS bin, count(*) AS n, avg(confidence) AS sure, avg(CAST(correct AS INT)) AS hit FROM scored GROUP BY 1)
SELECT round(sum(n * abs(sure - hit)) / sum(n), 9) AS ece, count(*) AS bins FROM b"""))
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calibration error over fifteen equal bins, open below and closed above."""
    b = A.scored(spark, sf_dir).groupBy(F.ceil(F.col("confidence") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("sure"), F.avg(F.col("correct").cast("int")).alias("hit"))
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("sure") - F.col("hit"))) / F.sum("n"), 9).alias("ece"), F.count(F.lit(1)).alias("bins"))


def most_coverage(levels: DataFrame, floor: float, *by: str) -> DataFrame:
    """The lowest threshold whose answers are right often enough, never inside a tie; no row where none is."""
    c = cumulative(levels, *by).where(F.col("right_so_far") / F.col("answered") >= floor)
    return c.groupBy(*by).agg(F.min("confidence").alias("line"), F.max("answered").alias("answered"))


@register("most_coverage", A.with_views("scored", body="--and\n" + _LEVELS + """
SELECT min(confidence) AS line, CAST(max(answered) AS BIGINT) AS answered FROM c WHERE right_ / answered >= 0.8::DOUBLE"""))
def most_coverage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line for 80% accuracy over all predictions."""
    return most_coverage(confidence_levels(A.scored(spark, sf_dir)), 0.8)


@register("lines_by_class", A.with_views("scored", body="""--and
s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY predicted) < 40 THEN -1 ELSE predicted END AS grp FROM scored),
l AS (SELECT grp, confidence, count(*) AS n, count(*) FILTER (correct) AS r FROM s GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS answered, sum(r) OVER w AS right_ FROM l WINDOW w AS (PARTITION BY grp ORDER BY confidence DESC)),
t AS (SELECT grp, min(confidence) AS line FROM c WHERE right_ / answered >= 0.75::DOUBLE GROUP BY grp)
SELECT predicted, count(*) AS predictions, max(line) AS line, count(*) FILTER (confidence >= line) AS answered, count(*) FILTER (confidence >= line AND correct) AS right_answers FROM s LEFT JOIN t ON s.grp = t.grp GROUP BY predicted"""))
def lines_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each predicted class; classes with fewer than forty predictions share one. Null: never answered."""
    scored = A.scored(spark, sf_dir)
    few = F.count(F.lit(1)).over(W.partitionBy("predicted")) < SHARED_UNDER
    s = scored.withColumn("grp", F.when(few, F.lit(-1)).otherwise(F.col("predicted")))
    lines = most_coverage(confidence_levels(s, "grp"), FLOOR, "grp").select("grp", "line")
    hit = F.coalesce(F.col("confidence") >= F.col("line"), F.lit(False))
    return s.join(lines, "grp", "left").groupBy("predicted").agg(F.count(F.lit(1)).alias("predictions"), F.max("line").alias("line"), F.count_if(hit).alias("answered"), F.count_if(hit & F.col("correct")).alias("right_answers"))


@register("held_out_by_game", A.with_views("scored", body="""--and
g AS (SELECT DISTINCT game AS held FROM scored),
l AS (SELECT held, confidence, count(*) AS n, count(*) FILTER (correct) AS r FROM g JOIN scored ON game <> held GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS answered, sum(r) OVER w AS right_ FROM l WINDOW w AS (PARTITION BY held ORDER BY confidence DESC)),
t AS (SELECT held, min(confidence) AS line FROM c WHERE right_ / answered >= 0.8::DOUBLE GROUP BY held)
SELECT game, max(line) AS line, count(*) AS n, count(*) FILTER (confidence >= line) AS answered, round(count(*) FILTER (confidence >= line AND correct) / nullif(count(*) FILTER (confidence >= line), 0), 9) AS accuracy
FROM scored LEFT JOIN t ON game = held GROUP BY game"""))
def held_out_by_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines drawn on all other games and applied to each: levels of a game are all levels less its own."""
    scored = A.scored(spark, sf_dir)
    own = confidence_levels(scored, "game")
    games = own.select(F.col("game").alias("held")).distinct()
    others = own.join(F.broadcast(games), F.col("game") != F.col("held")).groupBy("held", "confidence").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    lines = most_coverage(others, 0.8, "held").select(F.col("held").alias("game"), "line")
    hit = F.coalesce(F.col("confidence") >= F.col("line"), F.lit(False))
    df = scored.join(lines, "game", "left").groupBy("game").agg(F.max("line").alias("line"), F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("answered"), F.count_if(hit & F.col("correct")).alias("r"))
    return df.select("game", "line", "n", "answered", F.round(F.when(F.col("answered") > 0, F.col("r") / F.col("answered")), 9).alias("accuracy"))


@register("confusions", A.with_views("scored", body="""--and
c AS (SELECT truth, predicted, count(*) AS n FROM scored WHERE truth <> predicted GROUP BY ALL)
SELECT truth, predicted, n, row_number() OVER (PARTITION BY truth ORDER BY n DESC, predicted) AS became, row_number() OVER (PARTITION BY predicted ORDER BY n DESC, truth) AS came_from FROM c QUALIFY became <= 4 OR came_from <= 4"""))
def confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four classes each becomes most, and the four it comes from."""
    c = A.scored(spark, sf_dir).where("truth <> predicted").groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("became", F.row_number().over(W.partitionBy("truth").orderBy(F.desc("n"), "predicted"))).withColumn("came_from", F.row_number().over(W.partitionBy("predicted").orderBy(F.desc("n"), "truth")))
    return c.where("became <= 4 OR came_from <= 4")


@register("macro_f1", A.with_views("scored", body="""--and
t AS (SELECT truth AS k, count(*) AS labelled, count(*) FILTER (correct) AS hit FROM scored GROUP BY 1), p AS (SELECT predicted AS k, count(*) AS read FROM scored GROUP BY 1),
f AS (SELECT CASE WHEN hit = 0 THEN 0 ELSE 2 * hit / (labelled + coalesce(read, 0)) END AS f1 FROM t LEFT JOIN p USING (k))
SELECT round(avg(f1), 9) AS macro_f1, (SELECT round(avg(CAST(correct AS INT)), 9) FROM scored) AS accuracy, count(*) AS classes FROM f"""))
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean F1 of the labelled classes, and plain accuracy."""
    s = A.scored(spark, sf_dir)
    t = s.groupBy(F.col("truth").alias("k")).agg(F.count(F.lit(1)).alias("labelled"), F.count_if("correct").alias("hit"))
    p = s.groupBy(F.col("predicted").alias("k")).agg(F.count(F.lit(1)).alias("read"))
    f1 = F.when(F.col("hit") == 0, 0.0).otherwise(2 * F.col("hit") / (F.col("labelled") + F.coalesce("read", F.lit(0))))
    out = t.join(p, "k", "left").agg(F.round(F.avg(f1), 9).alias("macro_f1"), F.count(F.lit(1)).alias("classes"))
    return out.join(F.broadcast(s.agg(F.round(F.avg(F.col("correct").cast("int")), 9).alias("accuracy")))).select("macro_f1", "accuracy", "classes")


@register("accuracy_by_length", A.with_views("docs", "twice", body="""
SELECT language, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 3000 THEN 'middling' ELSE 'long' END AS length, doubt_first AS contested, count(*) AS n, round(avg(CAST(first = second AS INT)), 9) AS accuracy
FROM twice JOIN (SELECT doc_id, n_chars FROM docs) USING (doc_id) GROUP BY ALL"""))
def accuracy_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by language, length of the text, and whether the label is in doubt."""
    t = A.labelled_twice(spark, sf_dir).join(A.documents(spark, sf_dir).select("doc_id", "n_chars"), "doc_id")
    size = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 3000, "middling").otherwise("long")
    return t.groupBy("language", size.alias("length"), F.col("doubt_first").alias("contested")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("first") == F.col("second")).cast("int")), 9).alias("accuracy"))


@register("confidence_scores", A.with_views("scored", body="""--and
m AS (SELECT item, logits, list_max(logits) AS top FROM scored), e AS (SELECT item, logits, top, list_transform(logits, lambda x: exp(x - top)) AS p FROM m),
s AS (SELECT item, top, list_transform(p, lambda x: x / list_sum(p)) AS q FROM e)
SELECT item, round(list_max(q), 6) AS max_prob, round(list_max(q) - list_reverse_sort(q)[2], 6) AS margin, round(list_sum(list_transform(q, lambda x: x * ln(x))), 6) AS neg_entropy, round(top, 6) AS max_logit FROM s"""))
def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence four ways from the logits: greatest probability, margin, negative entropy, greatest logit."""
    df = A.scored(spark, sf_dir).select("item", "logits", softmax(F.col("logits")).alias("q"))
    down = F.sort_array("q", False)
    entropy = F.aggregate("q", F.lit(0.0), lambda s, x: s + x * F.ln(x))
    return df.select("item", F.round(down[0], 6).alias("max_prob"), F.round(down[0] - down[1], 6).alias("margin"), F.round(entropy, 6).alias("neg_entropy"), F.round(F.array_max("logits"), 6).alias("max_logit"))


@register("prior_adjusted", A.with_views("scored", body="""--and
p AS (SELECT list(ln(greatest(coalesce(n, 0), 0.5::DOUBLE) / (SELECT count(*) FROM scored)) ORDER BY k) AS priors FROM (SELECT unnest(range(10)) AS k) LEFT JOIN (SELECT truth AS k, count(*) AS n FROM scored GROUP BY 1) USING (k)),
a AS (SELECT item, list_transform(range(1, 11), lambda i: logits[i] - 0.5::DOUBLE * priors[i]) AS adjusted FROM scored, p)
SELECT item, list_position(adjusted, list_max(adjusted)) - 1 AS predicted, round(list_max(adjusted), 6) AS top FROM a"""))
def prior_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions after half the log prior is taken off the logits; a class never seen counts as half a label."""
    s = A.scored(spark, sf_dir)
    counts = s.groupBy(F.col("truth").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    sizes = s.agg(F.count(F.lit(1)).alias("all"))
    classes = spark.range(10).select(F.col("id").cast("int").alias("k"))
    p = classes.join(counts, "k", "left").join(F.broadcast(sizes)).select("k", F.ln(F.greatest(F.coalesce("n", F.lit(0)), F.lit(0.5)) / F.col("all")).alias("p"))
    priors = p.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("priors"))
    df = s.join(F.broadcast(priors)).select("item", F.zip_with("logits", "priors", lambda x, q: x - 0.5 * q).alias("a"))
    return df.select("item", (F.array_position("a", F.array_max("a")) - 1).alias("predicted"), F.round(F.array_max("a"), 6).alias("top"))


@register("class_weights", A.with_views("scored", body="""--and
c AS (SELECT truth, count(*) AS n FROM scored GROUP BY truth)
SELECT truth, n, round(sqrt(max(n) OVER () / n), 9) AS rarity, round(sum(n) OVER () / (count(*) OVER () * greatest(1, n)), 9) AS weight FROM c"""))
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How rare each class is, and the weight that makes classes count alike."""
    whole = W.partitionBy(F.lit(0))
    c = A.scored(spark, sf_dir).groupBy("truth").agg(F.count(F.lit(1)).alias("n"))
    return c.select("truth", "n", F.round(F.sqrt(F.max("n").over(whole) / F.col("n")), 9).alias("rarity"), F.round(F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.greatest(F.lit(1), F.col("n"))), 9).alias("weight"))


_FLOW, _FHIGH = wilson_sql("right_", "answered", Z_ROUNDED)


@register("frontier_score", A.with_views("scored", body=f"""--and
r AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, item) AS place, count(*) OVER () AS n FROM scored),
a AS (SELECT count(*) AS n, count(*) FILTER (confidence >= 0.2::DOUBLE) AS answered, count(*) FILTER (confidence >= 0.2::DOUBLE AND correct) AS right_,
             avg(CAST(correct AS INT)) FILTER (place <= ceil(n * 0.8::DOUBLE)) AS at80, avg(CAST(correct AS INT)) FILTER (place <= ceil(n * 0.9::DOUBLE)) AS at90 FROM r)
SELECT n, answered, round(answered / n, 9) AS coverage, round(right_ / answered, 9) AS accuracy, round({_FLOW}, 9) AS low, round({_FHIGH}, 9) AS high, round(at80, 9) AS at80, round(at90, 9) AS at90 FROM a"""))
def frontier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, accuracy with its interval, and accuracy over the surest 80% and 90%.

    The surest share is cut in a total order; confidence levels are counted first, and only the level that the cut
    falls in is ordered row by row.
    """
    s = A.scored(spark, sf_dir)
    totals = s.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= 0.2).alias("answered"), F.count_if((F.col("confidence") >= 0.2) & F.col("correct")).alias("right"))
    levels = cumulative(confidence_levels(s)).select(F.col("confidence").alias("level"), (F.col("answered") - F.col("n")).alias("above"))
    within = F.row_number().over(W.partitionBy("confidence").orderBy("item"))
    placed = s.join(levels, F.col("confidence") == F.col("level")).withColumn("place", F.col("above") + within).join(F.broadcast(totals.select(F.col("n").alias("all"))))
    hit = F.col("correct").cast("int")
    cuts = placed.agg(F.round(F.avg(F.when(F.col("place") <= F.ceil(F.col("all") * 0.8), hit)), 9).alias("at80"), F.round(F.avg(F.when(F.col("place") <= F.ceil(F.col("all") * 0.9), hit)), 9).alias("at90"))
    low, high = wilson(F.col("right"), F.col("answered"), Z_ROUNDED)
    return totals.join(F.broadcast(cuts)).select("n", "answered", F.round(F.col("answered") / F.col("n"), 9).alias("coverage"), F.round(F.col("right") / F.col("answered"), 9).alias("accuracy"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), "at80", "at90")


@register("threshold_crossings", A.with_views("scored", body="""--and
a AS (SELECT item, predicted, confidence, round(confidence + CASE WHEN item % 3 = 0 THEN 0.02::DOUBLE WHEN item % 3 = 1 THEN -0.02::DOUBLE ELSE 0 END, 6) AS other, CASE WHEN item % 17 = 0 THEN -1 ELSE predicted END AS other_predicted FROM scored)
SELECT item, predicted, confidence, other, confidence >= 0.3::DOUBLE AS answered, round(abs(confidence - 0.3::DOUBLE), 6) AS off_line FROM a WHERE predicted = other_predicted AND (confidence >= 0.3::DOUBLE) <> (other >= 0.3::DOUBLE)"""))
def threshold_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that one run answers and another declines though both pick the same class, and how far off the line they were."""
    s = A.scored(spark, sf_dir)
    drift = F.when(F.col("item") % 3 == 0, 0.02).when(F.col("item") % 3 == 1, -0.02).otherwise(0.0)
    other = s.select(F.col("item").alias("i"), F.round(F.col("confidence") + drift, 6).alias("other"), F.when(F.col("item") % 17 == 0, F.lit(-1)).otherwise(F.col("predicted")).alias("other_predicted"))
    both = s.join(other, F.col("item") == F.col("i")).where(F.col("predicted") == F.col("other_predicted"))
    answered = F.col("confidence") >= 0.3
    return both.where(answered != (F.col("other") >= 0.3)).select("item", "predicted", "confidence", "other", answered.alias("answered"), F.round(F.abs(F.col("confidence") - 0.3), 6).alias("off_line"))


@register("run_spread", A.with_views("scored", body="""--and
r AS (SELECT game % 2 AS config, game AS seed, count(*) FILTER (confidence >= 0.3::DOUBLE) / count(*) AS coverage FROM scored GROUP BY ALL)
SELECT config, count(*) AS runs, round(max(coverage) - min(coverage), 9) AS spread, round(avg(coverage), 9) AS mean, first(seed ORDER BY coverage DESC, seed) AS best FROM r GROUP BY config"""))
def run_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each configuration over seeds: how far coverage spreads, and the best seed."""
    r = A.scored(spark, sf_dir).groupBy((F.col("game") % 2).alias("config"), F.col("game").alias("seed")).agg((F.count_if(F.col("confidence") >= 0.3) / F.count(F.lit(1))).alias("c"))
    return r.groupBy("config").agg(F.count(F.lit(1)).alias("runs"), F.round(F.max("c") - F.min("c"), 9).alias("spread"), F.round(F.avg("c"), 9).alias("mean"), F.min_by("seed", F.struct(-F.col("c"), F.col("seed"))).alias("best"))


DRAWS = 400


@register("game_interval", A.with_views("scored", body=f"""--and
g AS (SELECT row_number() OVER (ORDER BY game) - 1 AS slot, count(*) OVER () AS slots, n, a, r FROM (
  SELECT game, count(*) AS n, count(*) FILTER (confidence >= 0.2::DOUBLE) AS a, count(*) FILTER (confidence >= 0.2::DOUBLE AND correct) AS r FROM scored GROUP BY game)),
p AS (SELECT draw, CAST('0x' || substr(md5('17:' || draw || ':' || slot), 1, 8) AS BIGINT) % slots AS slot FROM g, (SELECT unnest(range({DRAWS})) AS draw)),
d AS (SELECT draw, sum(a) / sum(n) AS coverage, sum(r) / sum(a) AS accuracy FROM p JOIN g USING (slot) GROUP BY draw)
SELECT round(quantile_cont(coverage, 0.025), 9) AS coverage_low, round(quantile_cont(coverage, 0.975), 9) AS coverage_high, round(quantile_cont(accuracy, 0.025), 9) AS accuracy_low, round(quantile_cont(accuracy, 0.975), 9) AS accuracy_high FROM d"""))
def game_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap over whole games: 2.5 and 97.5 percentiles of coverage and accuracy over 400 draws.

    Games are counted first, so a draw resamples a few numbers; draws come from a seeded hash and repeat.
    """
    s = A.scored(spark, sf_dir)
    hit = F.col("confidence") >= 0.2
    games = s.groupBy("game").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("a"), F.count_if(hit & F.col("correct")).alias("r"))
    whole = W.partitionBy(F.lit(0))
    games = games.withColumn("slot", F.row_number().over(whole.orderBy("game")) - 1).withColumn("slots", F.count(F.lit(1)).over(whole))
    picks = games.select("slot", "slots").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    digest = F.md5(F.concat_ws(":", F.lit("17"), F.col("draw").cast("string"), F.col("slot").cast("string")))
    picks = picks.select("draw", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("slots")).alias("slot"))
    drawn = picks.join(F.broadcast(games), "slot").groupBy("draw").agg((F.sum("a") / F.sum("n")).alias("coverage"), (F.sum("r") / F.sum("a")).alias("accuracy"))
    return drawn.agg(*[F.round(F.percentile(c, p), 9).alias(f"{c}_{end}") for c in ("coverage", "accuracy") for p, end in ((0.025, "low"), (0.975, "high"))])


@register("commonest_class", A.with_views("scored", body="""--and
f AS (SELECT truth FROM scored WHERE game < 5 GROUP BY truth ORDER BY count(*) DESC, truth LIMIT 1)
SELECT f.truth AS class, count(*) AS held, round(avg(CAST(s.truth = f.truth AS INT)), 9) AS accuracy FROM scored s, f WHERE game >= 5 GROUP BY f.truth"""))
def commonest_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline that always says the commonest class of the games it learned from."""
    s = A.scored(spark, sf_dir)
    top = s.where("game < 5").groupBy(F.col("truth").alias("class")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "class").limit(1)
    return s.where("game >= 5").join(F.broadcast(top)).groupBy("class").agg(F.count(F.lit(1)).alias("held"), F.round(F.avg((F.col("truth") == F.col("class")).cast("int")), 9).alias("accuracy"))


def greedy_lines(scored: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Lines by class with pandas, the plain way, for tests against ``most_coverage``."""

    def line(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("confidence", ascending=False)
        right = rows["correct"].cumsum().to_numpy() / np.arange(1, len(rows) + 1)
        last = np.append(rows["confidence"].to_numpy()[1:] != rows["confidence"].to_numpy()[:-1], True)
        fit = rows["confidence"].to_numpy()[(right >= floor) & last]
        return pd.DataFrame({"predicted": [rows["predicted"].iloc[0]], "line": [fit.min() if len(fit) else None]})

    return scored.select("predicted", "confidence", "correct").groupBy("predicted").applyInPandas(line, "predicted int, line double")
