"""Keeping labels, readings and their sidecars in step: matches by words, back-fills, checks, splits and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurate.functions.stats import wilson, wilson_sql
from murmurate.operators.evaluate import confidence_levels, most_coverage
from murmurate.operators.sampling import ROLE_SQL, numbered, role
from murmurate.plans import adapters as A
from murmurate.registry import register
from murmurate.session import table

MARK = "♥"
#: So many first characters of a marked text find the texts that it can be.
HEAD = 6


@register("censored_match", """
WITH k AS (SELECT p_partkey AS id, p_name AS words, p_brand AS brand FROM part), l AS (SELECT id, brand, regexp_replace(words, '[aeiou]', '♥', 'g') AS marked FROM k WHERE id % 5 = 0),
j AS (SELECT l.id, k.id AS hit FROM l JOIN k ON k.brand = l.brand AND length(k.words) = length(l.marked) AND regexp_full_match(k.words, replace(regexp_replace(l.marked, '([^A-Za-z0-9 ♥])', '\\\\\\1', 'g'), '♥', '.')))
SELECT id, CASE WHEN count(hit) = 1 THEN min(hit) END AS matched, count(hit) AS hits FROM l LEFT JOIN j USING (id) GROUP BY id""")
def censored_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one text of a group whose words are a marked one's, each mark standing for any character; null for none or several."""
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("words"), F.col("p_brand").alias("brand"))
    marked = k.where("id % 5 = 0").select("id", "brand", F.regexp_replace("words", "[aeiou]", MARK).alias("marked"))
    found = marked_hits(marked.select("brand", "marked"), k, "brand")
    # Once more by id: the SQL joins by it, so that an id with several rows has the hits of all of them for each.
    each = marked.join(found, ["brand", "marked"], "left").groupBy("id").agg(F.min("first").alias("first"), (F.coalesce(F.sum("hits"), F.lit(0)) * F.count(F.lit(1))).alias("hits"))
    return each.select("id", F.when(F.col("hits") == 1, F.col("first")).alias("matched"), "hits")


def marked_hits(marked: DataFrame, texts: DataFrame, by: str, head: int = HEAD) -> DataFrame:
    """Of every different (group, marked) that fits a text of its group: the smallest id and how many texts (id, words) it fits.

    A mark stands for any character but a line break. Equal texts meet as one. They meet on size and on their first
    characters with the marks put in, once for each way these are marked in their group and size: at most 2^head ways.
    """
    at = lambda c, n: F.substring(c, n, 1)
    shape = F.concat(*[F.when(at("marked", n) == MARK, "1").otherwise("0") for n in range(1, head + 1)])
    wanted = marked.distinct().select(by, "marked", F.length("marked").alias("size"), shape.alias("shape"), F.substring("marked", 1, head).alias("key"))
    distinct = texts.groupBy(by, "words").agg(F.min("id").alias("first"), F.count("id").alias("n")).withColumn("size", F.length("words"))
    put_in = F.concat(*[F.when(at("shape", n) == "1", MARK).otherwise(at("words", n)) for n in range(1, head + 1)])
    shaped = distinct.join(wanted.select(by, "size", "shape").distinct(), [by, "size"]).withColumn("key", put_in)
    same = F.forall(F.zip_with(F.split("marked", ""), F.split("words", ""), lambda a, b: (a == b) | ((a == MARK) & (b != "\n"))), lambda x: F.coalesce(x, F.lit(False)))
    met = wanted.join(shaped, [by, "size", "shape", "key"]).where(same)
    return met.groupBy(by, "marked").agg(F.min("first").alias("first"), F.sum("n").alias("hits"))


@register("vectors_of_named", """
WITH n AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), t AS (SELECT doc_id, sha256(text) AS key FROM documents WHERE text IS NOT NULL),
v AS (SELECT key, min(doc_id) AS vector FROM t GROUP BY key) SELECT n.doc_id, v.vector FROM n JOIN t USING (doc_id) JOIN v USING (key)""")
def vectors_of_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of each named review, by way of its text's hash: reviews of one text share one vector."""
    n = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    t = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("key"))
    v = t.groupBy("key").agg(F.min("doc_id").alias("vector"))
    return n.join(t, "doc_id").join(v, "key").select("doc_id", "vector")


@register("key_backfill", """
WITH c AS (SELECT doc_id, CAST('0x' || substr(k, 15, 2) || substr(k, 13, 2) || substr(k, 11, 2) || substr(k, 9, 2) || substr(k, 7, 2) || substr(k, 5, 2) || substr(k, 3, 2) AS BIGINT) AS high FROM (SELECT doc_id, sha256(text) AS k FROM documents WHERE text IS NOT NULL))
SELECT d.doc_id, high FROM documents d LEFT JOIN c USING (doc_id)""")
def key_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text keys for readings that were written without them; seven of the eight bytes, to fit a signed number."""
    from murmurate.functions.formats import text_key

    d = table(spark, sf_dir, "documents")
    key = text_key(F.col("text"))
    keyed = d.where(F.col("text").isNotNull()).select("doc_id", F.floor(key / 256).cast("long").alias("high"))
    return d.select("doc_id").join(keyed, "doc_id", "left")


@register("induced_check", A.with_views("docs", "twice", body="""--and
h AS (SELECT list(doc_id ORDER BY doc_id) AS handout FROM (SELECT doc_id FROM twice ORDER BY doc_id LIMIT 100)),
s AS (SELECT language || '-' || first AS id, list_distinct(list(doc_id)) AS evidence FROM twice WHERE doc_id % 3 <> 0 GROUP BY ALL)
SELECT id, len(evidence) AS given, CASE WHEN NOT regexp_full_match(id, '[a-z]+(-[a-z]+)*') THEN 'id' WHEN len(list_filter(evidence, lambda x: NOT list_contains(handout, x))) > 0 THEN 'not handed out' WHEN len(evidence) < 3 THEN 'too little evidence' ELSE 'kept' END AS verdict FROM s, h"""))
def induced_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects a model came up with, refused where their evidence wasn't handed out or is too little."""
    t = A.labelled_twice(spark, sf_dir)
    handed = t.select("doc_id").orderBy("doc_id").limit(100).agg(F.collect_set("doc_id").alias("handout"))
    s = t.where("doc_id % 3 <> 0").groupBy(F.concat_ws("-", "language", "first").alias("id")).agg(F.collect_set("doc_id").alias("evidence"))
    verdict = F.when(~F.col("id").rlike("^[a-z]+(-[a-z]+)*$"), "id").when(F.size(F.array_except("evidence", "handout")) > 0, "not handed out").when(F.size("evidence") < 3, "too little evidence").otherwise("kept")
    return s.join(F.broadcast(handed)).select("id", F.size("evidence").cast("long").alias("given"), verdict.alias("verdict"))


@register("read_twice_scores", A.with_views("docs", "twice", body="""--and
r AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'good' ELSE first END AS predicted FROM twice WHERE NOT only_first)
SELECT language, count(*) AS n, round(avg(CAST(predicted = first AS INT)), 9) AS of_first, round(avg(CAST(predicted = second AS INT)), 9) AS of_second, round(avg(CAST(predicted = first OR predicted = second AS INT)), 9) AS of_either,
       round(avg(CAST(predicted = first AS INT)) FILTER (first = second), 9) AS where_both_agree FROM r GROUP BY language"""))
def read_twice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader against both labellers: the first, the second, either, and where they agree."""
    r = A.labelled_twice(spark, sf_dir).where("NOT only_first").withColumn("predicted", F.when(F.col("doc_id") % 4 == 0, "good").otherwise(F.col("first")))
    a, b = F.col("predicted") == F.col("first"), F.col("predicted") == F.col("second")
    share = lambda c: F.round(F.avg(c.cast("int")), 9)
    return r.groupBy("language").agg(F.count(F.lit(1)).alias("n"), share(a).alias("of_first"), share(b).alias("of_second"), share(a | b).alias("of_either"),
                                     F.round(F.avg(F.when(F.col("first") == F.col("second"), a.cast("int"))), 9).alias("where_both_agree"))


@register("aspect_scores", A.with_views("claims", body="""--and
w AS (SELECT review, ord, subject AS s FROM claims WHERE subject IS NOT NULL UNION SELECT review, ord, also_subject FROM claims WHERE also_subject IS NOT NULL),
g AS (SELECT review, ord, subject AS s FROM claims WHERE subject IS NOT NULL AND part % 9 <> 0 UNION SELECT review, ord, 'RETURNS' FROM claims WHERE part % 4 = 0),
b AS (SELECT coalesce(w.s, g.s) AS subject, w.s IS NOT NULL AS wanted, g.s IS NOT NULL AS given FROM w FULL JOIN g ON w.review = g.review AND w.ord = g.ord AND w.s = g.s)
SELECT subject, count(*) FILTER (wanted) AS labelled, count(*) FILTER (given) AS read, count(*) FILTER (wanted AND given) AS agreed, round(2 * count(*) FILTER (wanted AND given) / (count(*) FILTER (wanted) + count(*) FILTER (given)), 9) AS f1 FROM b GROUP BY subject"""))
def aspect_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (claim, subject) pair labelled and read: F1 by subject."""
    c = A.claims(spark, sf_dir)
    wanted = A.exploded(c).select("review", "ord", "subject").distinct().withColumn("wanted", F.lit(True))
    first = c.where(F.col("subject").isNotNull() & (F.col("part") % 9 != 0)).select("review", "ord", "subject")
    given = first.union(c.where("part % 4 = 0").select("review", "ord", F.lit("RETURNS"))).distinct().withColumn("given", F.lit(True))
    b = wanted.join(given, ["review", "ord", "subject"], "full_outer")
    agg = b.groupBy("subject").agg(F.count("wanted").alias("labelled"), F.count("given").alias("read"), F.count_if(F.col("wanted") & F.col("given")).alias("agreed"))
    return agg.withColumn("f1", F.round(2 * F.col("agreed") / (F.col("labelled") + F.col("read")), 9))


@register("game_split", A.with_views("reviews", body=f"""--and
a AS (SELECT author, count(*) AS reviews FROM reviews GROUP BY author), s AS (SELECT author, reviews, {ROLE_SQL.format(k='author')} AS part, row_number() OVER (ORDER BY sha256('fold:1:' || author)) - 1 AS place FROM a)
SELECT CASE WHEN part < 0.2::DOUBLE THEN 'held-out' WHEN part < 0.35::DOUBLE THEN 'validation' ELSE 'train' END AS role, place % 5 AS fold, count(*) AS authors, CAST(sum(reviews) AS BIGINT) AS reviews FROM s GROUP BY ALL"""))
def game_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and folds that keep all of an author together, and how much each holds."""
    a = A.reviews(spark, sf_dir).groupBy("author").agg(F.count(F.lit(1)).alias("reviews"))
    rank = F.sha2(F.concat(F.lit("fold:1:"), F.col("author").cast("string")), 256)
    s = numbered(a, F.substring(rank, 1, 3), rank).select(role(F.col("author")).alias("role"), ((F.col("place") - 1) % 5).alias("fold"), "reviews")
    return s.groupBy("role", "fold").agg(F.count(F.lit(1)).alias("authors"), F.sum("reviews").alias("reviews"))


@register("language_lines", A.with_views("scored", body=f"""--and
s AS (SELECT *, CASE WHEN game < 6 THEN 'language ' || game % 3 ELSE 'rare' END AS language FROM scored WHERE game < 6 OR item % 20 = 9),
l AS (SELECT language, confidence, count(*) AS n, count(*) FILTER (correct) AS r FROM s GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS answered, sum(r) OVER w AS right_ FROM l WINDOW w AS (PARTITION BY language ORDER BY confidence DESC)),
t AS (SELECT language, min(confidence) AS line FROM c WHERE right_ / answered >= 0.8::DOUBLE GROUP BY language),
e AS (SELECT s.language, count(*) AS claims, CASE WHEN count(*) >= 40 THEN max(line) END AS line, count(*) FILTER (confidence >= line) AS answered, count(*) FILTER (confidence >= line AND correct) AS hits FROM s LEFT JOIN t ON s.language = t.language GROUP BY s.language)
SELECT language, claims, round(line, 4) AS line, CASE WHEN line IS NOT NULL THEN answered END AS answered, round({wilson_sql('hits', 'answered')[0]}, 9) AS low FROM e"""))
def language_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line each language is answered above, none for languages with under forty claims, and what it delivers."""
    s = A.scored(spark, sf_dir).where("game < 6 OR item % 20 = 9").withColumn("language", F.when(F.col("game") < 6, F.concat(F.lit("language "), (F.col("game") % 3).cast("string"))).otherwise("rare"))
    lines = most_coverage(confidence_levels(s, "language"), 0.8, "language").select("language", "line")
    hit = F.coalesce(F.col("confidence") >= F.col("line"), F.lit(False))
    e = s.join(lines, "language", "left").groupBy("language").agg(F.count(F.lit(1)).alias("claims"), F.max("line").alias("any_line"), F.count_if(hit).alias("answers"), F.count_if(hit & F.col("correct")).alias("hits"))
    e = e.withColumn("line", F.when(F.col("claims") >= 40, F.col("any_line")))
    low, _ = wilson(F.col("hits"), F.col("answers"))
    return e.select("language", "claims", F.round("line", 4).alias("line"), F.when(F.col("line").isNotNull(), F.col("answers")).alias("answered"), F.round(low, 9).alias("low"))


def merged_fields(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Sidecars: fields that the new one sets win, all others stay."""
    fields = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]
    a, b = old.select(key, F.struct(*[c for c in old.columns if c != key]).alias("o")), new.select(key, F.struct(*[c for c in new.columns if c != key]).alias("n"))
    both = a.join(b, key, "full_outer")
    pick = lambda c: F.coalesce(*[F.col(f"{s}.{c}") for s, have in (("n", new.columns), ("o", old.columns)) if c in have]).alias(c)
    return both.select(key, *[pick(c) for c in fields])


@register("sidecar_merge", A.with_views("reviews", body="""--and
o AS (SELECT game, count(*) AS held, min(created) AS first_review, NULL AS stopped FROM reviews WHERE NOT deck GROUP BY game), n AS (SELECT game, CASE WHEN count(*) > 300 THEN count(*) END AS held, 'end' AS stopped FROM reviews WHERE deck AND game <> 'BUILDING' GROUP BY game)
SELECT game, coalesce(n.held, o.held) AS held, o.first_review, coalesce(n.stopped, o.stopped) AS stopped FROM o FULL JOIN n USING (game)"""))
def sidecar_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one writer recorded of each game, over what others did."""
    r = A.reviews(spark, sf_dir)
    old = r.where("NOT deck").groupBy("game").agg(F.count(F.lit(1)).alias("held"), F.min("created").alias("first_review")).withColumn("stopped", F.lit(None).cast("string"))
    new = r.where("deck AND game <> 'BUILDING'").groupBy("game").agg(F.count(F.lit(1)).alias("n")).select("game", F.when(F.col("n") > 300, F.col("n")).alias("held"), F.lit("end").alias("stopped"))
    return merged_fields(old, new, "game")


@register("reading_differences", A.with_views("claims", body="""--and
b AS (SELECT review, ord, CASE WHEN part % 10 = 0 THEN 'Brand#11' WHEN part % 11 = 0 THEN NULL ELSE subject END AS subject FROM claims WHERE part % 50 <> 1)
SELECT a.subject AS was, b.subject AS now, count(*) AS claims FROM claims a LEFT JOIN b USING (review, ord) WHERE a.subject IS DISTINCT FROM b.subject GROUP BY ALL"""))
def reading_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two readings of a corpus differ, claim by claim."""
    c = A.claims(spark, sf_dir)
    b = c.where("part % 50 <> 1").select("review", "ord", F.when(F.col("part") % 10 == 0, "Brand#11").when(F.col("part") % 11 == 0, F.lit(None)).otherwise(F.col("subject")).alias("now"))
    both = c.select("review", "ord", F.col("subject").alias("was")).join(b, ["review", "ord"], "left")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).groupBy("was", "now").agg(F.count(F.lit(1)).alias("claims"))
