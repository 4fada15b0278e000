"""Prepared data as queries: vectors written and read back, labels on samples and folds, handouts, themes, looks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurate.operators.sampling import numbered
from murmurate.plans import adapters as A
from murmurate.registry import register
from murmurate.session import table
from murmurate.sources import prepared as P

PINS = {"encoder": "vowels", "revision": "1"}


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors share; a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="murmurate-")
        atexit.register(shutil.rmtree, folder, True)
        root = f"file://{folder}"
    return f"{root.rstrip('/')}/murmurate/{name}-{uuid.uuid4().hex}"


def vowels(texts: list[str]) -> list[list[float]]:
    """A stand-in for an encoder: how often each vowel stands in a text, and one."""
    return [[*(float(t.count(v)) for v in "aeiou"), 1.0] for t in texts]


_VOWELS = "[" + ", ".join(f"CAST(length({{t}}) - length(replace({{t}}, '{v}', '')) AS DOUBLE)" for v in "aeiou") + ", 1.0::DOUBLE]"


@register("claim_vectors", f"""
WITH v AS (SELECT item_id, {_VOWELS.format(t='text')} AS v FROM benchmark WHERE text IS NOT NULL), s AS (SELECT item_id, v, 127 / list_max(v) AS scale FROM v)
SELECT item_id, round(scale, 4) AS scale, CAST(list_sum(list_transform(v, lambda x: CAST(floor(x * scale + 0.5) AS BIGINT))) AS BIGINT) AS cells FROM s""")
def claim_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims prepared in two goes, the second making only what the first has not, and read back under the encoder's pins."""
    b = table(spark, sf_dir, "benchmark").where(F.col("text").isNotNull())
    claims = b.select(F.col("item_id").cast("string").alias("recommendationid"), F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end"), F.col("text").alias("claim"),
                      F.lit(None).cast("string").alias("subject"), F.lit("neutral").alias("polarity"), F.lit(0.5).alias("confidence"))
    folder = fresh(spark, "meaning")
    P.write_claim_vectors(claims.where("recommendationid % 3 = 0"), folder, lambda texts: [[1.0]] * len(texts), {"encoder": "other"})
    P.write_claim_vectors(claims.where("recommendationid % 2 = 0"), folder, vowels, PINS)
    P.write_claim_vectors(claims, folder, vowels, PINS)
    held = P.claim_vectors(spark, folder, PINS)
    return held.select(F.col("recommendationid").cast("long").alias("item_id"), F.round(F.col("scale").cast("double"), 4).alias("scale"), F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x).alias("cells"))


@register("review_vectors", f"""
WITH t AS (SELECT sha256(text) AS text_sha256, any_value(text) AS t, count(*) AS n_reviews FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT text_sha256, n_reviews, list_sum({_VOWELS.format(t='t')}) AS total FROM t""")
def review_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector a distinct text, written and read back."""
    path = fresh(spark, "embeddings")
    P.write_review_vectors(table(spark, sf_dir, "documents"), path, vowels, 1, "vowels")
    return P.review_vectors(spark, path).select("text_sha256", "n_reviews", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"))


@register("named_vectors", f"""
WITH n AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), v AS (SELECT doc_id, {_VOWELS.format(t='text')} AS v FROM documents JOIN n USING (doc_id) WHERE text IS NOT NULL)
SELECT doc_id, v[1] AS first, list_sum(v) AS total FROM v""")
def named_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of named reviews, by way of their texts."""
    path, docs = fresh(spark, "embeddings"), table(spark, sf_dir, "documents")
    P.write_review_vectors(docs, path, vowels, 1, "vowels")
    found = P.vectors_for(docs, P.review_vectors(spark, path), table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"))
    return found.select("doc_id", F.get("embedding", F.lit(0)).cast("double").alias("first"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"))


@register("current_report", A.with_views("reviews", body="SELECT game, count(*) AS reviews, count(*) FILTER (voted_up) AS positive FROM reviews GROUP BY game"))
def current_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as JSON and read back while its pins hold; with other pins it is made again."""
    path, schema = fresh(spark, "report"), "game string, reviews long, positive long"
    made = A.reviews(spark, sf_dir).groupBy("game").agg(F.count(F.lit(1)).alias("reviews"), F.count_if("voted_up").alias("positive"))
    P.write_report(made, path, PINS)
    stale = P.current_report(spark, path, schema, PINS | {"revision": "2"})
    held = P.current_report(spark, path, schema, PINS)
    return made if held is None or stale is not None else held


@register("training_lines", """
SELECT l.doc_id, 'text ' || l.quality AS subject, CASE WHEN l.doc_id % 2 = 0 THEN 'praise' ELSE 'neutral' END AS polarity, 'medium' AS confidence, 'stratified' AS subset, octet_length(encode(text)) AS bytes
FROM labels l JOIN documents d USING (doc_id) WHERE quality IS NOT NULL AND trim(text) <> '' AND l.doc_id % 5 <> 0""")
def training_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts as training lines and back: wrongly cut ones are held back, defaults fill what was not said."""
    path = fresh(spark, "training")
    rows = table(spark, sf_dir, "labels").where("quality IS NOT NULL").join(table(spark, sf_dir, "documents"), "doc_id").select(
        "text", F.col("doc_id").cast("string").alias("review_id"), F.concat(F.lit("text "), F.col("quality").cast("string")).alias("subject"), F.when(F.col("doc_id") % 2 == 0, "praise").alias("polarity"), (F.col("doc_id") % 5 == 0).alias("split_wrong"))
    P.write_training(rows, path)
    back = P.training_rows(spark, path)
    return back.select(F.col("review_id").cast("long").alias("doc_id"), "subject", "polarity", "confidence", "subset", F.octet_length("text").cast("long").alias("bytes"))


@register("labels_on_folds", A.with_views("scored", body="""--and
f AS (SELECT game % 3 AS fold, item, truth, list_position(logits, list_max(logits)) - 1 AS predicted FROM scored)
SELECT fold, truth % 2 AS language, count(*) AS n, count(*) FILTER (truth = predicted) AS hit FROM f GROUP BY ALL"""))
def labels_on_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out logits of all folds joined to the labels' languages by review and claim."""
    s = A.scored(spark, sf_dir)
    logits = s.select((F.col("game") % 3).alias("fold"), F.col("game").alias("app_id"), F.col("item").cast("string").alias("review_id"), F.lit(0).alias("claim_index"), "truth", "logits")
    labels = s.select(F.col("item").cast("string").alias("review_id"), F.lit(0).alias("claim_index"), (F.col("truth") % 2).alias("language"))
    both = P.pooled_folds(logits, 10).join(labels, ["review_id", "claim_index"])
    return both.groupBy("fold", "language").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth") == F.col("predicted")).alias("hit"))


@register("labels_on_sample", A.with_views("claims", body="""--and
d AS (SELECT review, ord, part, CAST(sum(length(CAST(part AS VARCHAR)) + 1) OVER (PARTITION BY review ORDER BY ord) - length(CAST(part AS VARCHAR)) - 1 AS BIGINT) AS starts FROM claims WHERE review % 10 = 0)
SELECT review, ord, CAST(part AS VARCHAR) AS text, starts, subject FROM d JOIN (SELECT review, ord, subject FROM claims WHERE ord % 2 = 0) USING (review, ord)"""))
def labels_on_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the text of the drawn claim they are of, and where it stands in the claims joined by a blank."""
    c = A.claims(spark, sf_dir)
    text = F.col("part").cast("string")
    before = W.partitionBy("review").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    drawn = c.where("review % 10 = 0").select("review", "ord", text.alias("text"), F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0)).alias("starts"))
    return drawn.join(c.where("ord % 2 = 0").select("review", "ord", "subject"), ["review", "ord"])


@register("handouts", A.with_views("claims", body="""--and
n AS (SELECT review, ord, ord * 10 AS a, ord * 10 + 8 AS b FROM claims), p AS (SELECT review, ord * 10 + 4 AS a, ord * 10 + 13 AS b FROM claims WHERE part % 40 = 0),
o AS (SELECT p.review, p.a, arg_min(n.ord, {'x': -(least(p.b, n.b) - greatest(p.a, n.a)), 'o': n.ord}) AS ord FROM p JOIN n ON p.review = n.review AND p.a < n.b AND n.a < p.b GROUP BY ALL),
k AS (SELECT review, list_sort(list(DISTINCT ord)) AS asked FROM o GROUP BY review)
SELECT review, (SELECT count(*) FROM n WHERE n.review = k.review) AS claims, array_to_string(asked, ',') AS asked FROM k"""))
def handouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reviews of picked spans with the claims asked about: of those a pick overlaps, the one it overlaps most."""
    c = A.claims(spark, sf_dir)
    cuts = c.select("review", "ord", (F.col("ord") * 10).alias("start"), (F.col("ord") * 10 + 8).alias("end"))
    picks = c.where("part % 40 = 0").select("review", (F.col("ord") * 10 + 4).alias("start"), (F.col("ord") * 10 + 13).alias("end"))
    found = handed_out(picks, cuts)
    return found.select("review", "claims", F.array_join(F.col("asked").cast("array<string>"), ",").alias("asked"))


def handed_out(picks: DataFrame, cuts: DataFrame) -> DataFrame:
    """(review, claims, asked): picks (review, start, end) on a text's present cuts (review, ord, start, end). Picks that no cut overlaps are dropped."""
    p = picks.select("review", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    met = p.join(cuts, "review").where((F.col("p_start") < F.col("end")) & (F.col("start") < F.col("p_end")))
    shared = F.least("p_end", "end") - F.greatest("p_start", "start")
    best = met.groupBy("review", "p_start", "p_end").agg(F.min_by("ord", F.struct((-shared).alias("x"), F.col("ord").alias("o"))).alias("ord"))
    asked = best.groupBy("review").agg(F.sort_array(F.collect_set("ord")).alias("asked"))
    sizes = cuts.join(asked.select("review"), "review", "left_semi").groupBy("review").agg(F.count(F.lit(1)).alias("claims"))
    return asked.join(sizes, "review")


def ranked_themes(themes: DataFrame, links: DataFrame) -> DataFrame:
    """Themes (side, theme, reviews) of all subjects, most reviews first, without one that is linked (theme, other) either way to a kept one.

    Greedy on some hundreds of rows a side, so a side is one call.
    """
    both = links.select("theme", "other").union(links.select("other", "theme")).groupBy("theme").agg(F.collect_set("other").alias("linked"))
    rows = themes.join(both, "theme", "left")

    def keep(part: pd.DataFrame) -> pd.DataFrame:
        kept, out = set(), []
        for r in part.sort_values(["reviews", "theme"], ascending=[False, True]).itertuples(index=False):
            if not kept & set(r.linked if r.linked is not None else ()):
                kept.add(r.theme)
                out.append((r.side, r.theme, r.reviews, len(out) + 1))
        return pd.DataFrame(out, columns=["side", "theme", "reviews", "place"])

    return rows.groupBy("side").applyInPandas(keep, "side string, theme string, reviews long, place int")


@register("ranked_themes", A.with_views("sides", body="""--and
t AS (SELECT 'complaint' AS side, subject AS theme, count(*) FILTER (complaint) AS reviews FROM sides GROUP BY subject UNION ALL SELECT 'praise', subject, count(*) FILTER (praise) FROM sides GROUP BY subject),
l AS (SELECT DISTINCT a.subject AS theme, b.subject AS other FROM sides a JOIN sides b ON a.review = b.review AND a.subject <> b.subject AND substr(a.subject, 1, 7) = substr(b.subject, 1, 7) AND a.review % 97 = 0),
e AS (SELECT theme, other FROM l UNION SELECT other, theme FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY reviews DESC, theme) AS p FROM t),
k(side, p, kept) AS (SELECT DISTINCT side, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM r
  UNION ALL SELECT k.side, r.p, CASE WHEN len(list_filter(kept, lambda x: list_contains(coalesce(n.linked, []), x))) = 0 THEN list_append(kept, r.theme) ELSE kept END
  FROM k JOIN r ON r.side = k.side AND r.p = k.p + 1 LEFT JOIN (SELECT theme, list(other) AS linked FROM e GROUP BY theme) n ON n.theme = r.theme),
f AS (SELECT side, arg_max(kept, p) AS kept FROM k GROUP BY side)
SELECT r.side, r.theme, reviews, CAST(list_position(kept, r.theme) AS INT) AS place FROM r JOIN f USING (side) WHERE list_contains(kept, r.theme)""").replace("WITH ", "WITH RECURSIVE ", 1))
def ranked_themes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects as themes of either side; those of one family that a drawn review raises together are linked."""
    s = A.sides(A.claims(spark, sf_dir))
    themes = s.select("subject", F.explode(F.array(F.struct(F.lit("praise").alias("side"), F.col("praise").alias("hit")), F.struct(F.lit("complaint").alias("side"), F.col("complaint").alias("hit")))).alias("x"))
    themes = themes.groupBy(F.col("x.side").alias("side"), F.col("subject").alias("theme")).agg(F.count_if("x.hit").alias("reviews"))
    drawn = s.where("review % 97 = 0").select("review", "subject")
    pair = drawn.alias("a").join(drawn.alias("b"), (F.col("a.review") == F.col("b.review")) & (F.col("a.subject") != F.col("b.subject")) & (F.substring("a.subject", 1, 7) == F.substring("b.subject", 1, 7)))
    return ranked_themes(themes, pair.select(F.col("a.subject").alias("theme"), F.col("b.subject").alias("other")).distinct())


@register("length_batches", """
WITH n AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, text, k // 400 AS part, k FROM n)
SELECT doc_id, part, (row_number() OVER (PARTITION BY part ORDER BY length(text), k) - 1) // 32 AS batch FROM w""")
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in batches of alike length within windows of their order."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")
    n = numbered(d, F.floor(F.col("doc_id") / 4096), "doc_id", name="k").withColumn("k", F.col("k") - 1)
    return P.length_batches(n, "text", F.col("k"), 32, 400).select("doc_id", F.col("window").alias("part"), "batch")


def looked(seen: DataFrame, looks: DataFrame, key: str = "game") -> DataFrame:
    """The last look at each game: a store (key, month, looked) with newer looks put over older ones."""
    return seen.unionByName(looks).groupBy(key).agg(F.max(F.struct("looked", "month")).alias("l")).select(key, "l.month", "l.looked")


@register("last_seen", A.with_views("reviews", body="""--and
a AS (SELECT game, strftime(make_timestamp(max(created) * 1000000), '%Y-%m') AS month, max(created) AS looked FROM reviews WHERE NOT deck GROUP BY game UNION ALL SELECT game, strftime(make_timestamp(max(created) * 1000000), '%Y-%m'), max(created) FROM reviews WHERE deck AND game <> 'BUILDING' GROUP BY game)
SELECT game, arg_max(month, looked) AS month, max(looked) AS looked FROM a GROUP BY game"""))
def last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest look at each game, from a store and later looks."""
    r = A.reviews(spark, sf_dir)
    look = lambda df: df.groupBy("game").agg(F.max("created").alias("looked")).select("game", A.month_of(F.col("looked")).alias("month"), "looked")
    return looked(look(r.where("NOT deck")), look(r.where("deck AND game <> 'BUILDING'")))


@register("reranked", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT v AS q FROM v WHERE vec_id = 3),
n AS (SELECT vec_id, list_dot_product(v, q) / sqrt(list_dot_product(v, v) * list_dot_product(q, q)) AS similarity FROM v, q WHERE vec_id % 4 <> 1 ORDER BY similarity DESC, vec_id LIMIT 100)
SELECT vec_id, round(similarity, 9) AS similarity, vec_id * 37 % 101 / 101 AS score FROM n WHERE vec_id * 37 % 101 / 101 >= 0.1::DOUBLE ORDER BY score DESC, n.similarity DESC, vec_id LIMIT 50""")
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred nearest to a query that words have not found already, scored again by another model and cut."""
    from murmurate.corpus import search_by_meaning

    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("review"), F.lit(0).alias("ord"), F.col("vec_id").cast("string").alias("claim"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    query = v.where("review = 3").select("vector").first()["vector"]  # one vector
    found = search_by_meaning(v, list(query), v.where("review % 4 = 1").select("review", "ord"), lambda texts: [int(t) * 37 % 101 / 101 for t in texts])
    return found.select(F.col("review").alias("vec_id"), F.round("similarity", 9).alias("similarity"), "score")
