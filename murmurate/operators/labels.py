"""Labels: agreement between labellers and reader, reliability, ceilings, merges and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurate.functions.stats import corrected, kappa, ratio, wilson, wilson_sql
from murmurate.plans import adapters as A
from murmurate.registry import register


def agreement_by_class(pairs: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """Per class: labelled, read and agreed; from (truth, guess), a null guess being no answer."""
    both = pairs.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    t = both.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("labelled"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).alias("agreed"))
    g = both.where(F.col(guess).isNotNull()).groupBy(F.col(guess).alias("class")).agg(F.sum("n").alias("read"))
    return t.join(g, "class", "full_outer").fillna(0)


_CLASSES = """c AS (SELECT truth, guess, count(*) AS n FROM pairs GROUP BY ALL),
t AS (SELECT truth AS class, sum(n) AS labelled, sum(CASE WHEN truth = guess THEN n ELSE 0 END) AS agreed FROM c GROUP BY truth),
g AS (SELECT guess AS class, sum(n) AS read FROM c GROUP BY guess),
x AS (SELECT coalesce(t.class, g.class) AS class, coalesce(labelled, 0) AS labelled, coalesce(agreed, 0) AS agreed, coalesce(read, 0) AS read FROM t FULL JOIN g ON t.class = g.class)"""


@register("reader_agreement", A.with_views("docs", "twice", body=f"""--and
pairs AS (SELECT first AS truth, second AS guess FROM twice), {_CLASSES},
s AS (SELECT *, (SELECT count(*) FROM pairs) AS seen FROM x)
SELECT class, CAST(labelled AS BIGINT) AS labelled, CAST(read AS BIGINT) AS read, CAST(agreed AS BIGINT) AS agreed, round(agreed / nullif(read, 0), 9) AS precision, round(agreed / nullif(labelled, 0), 9) AS recall,
       round(CASE WHEN agreed = 0 THEN 0 ELSE 2 * agreed / (read + labelled) END, 9) AS f1,
       round(CASE WHEN labelled >= 40 AND agreed / labelled - (read - agreed) / (seen - labelled) > 0.1::DOUBLE
             THEN greatest(0.0, least(1.0, (read / seen - (read - agreed) / (seen - labelled)) / (agreed / labelled - (read - agreed) / (seen - labelled)))) END, 9) AS corrected FROM s"""))
def reader_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 (0 where nothing is right) and the share corrected for the reader's errors, by class."""
    pairs = A.labelled_twice(spark, sf_dir).select(F.col("first").alias("truth"), F.col("second").alias("guess"))
    df = agreement_by_class(pairs).join(F.broadcast(pairs.agg(F.count(F.lit(1)).alias("seen"))))
    a, n, r = F.col("agreed"), F.col("labelled"), F.col("read")
    fixed = corrected(r / F.col("seen"), n, r, a, F.col("seen"))
    return df.select("class", "labelled", "read", "agreed", F.round(ratio(a, r), 9).alias("precision"), F.round(ratio(a, n), 9).alias("recall"),
                     F.round(F.when(a == 0, F.lit(0.0)).otherwise(2 * a / (r + n)), 9).alias("f1"), F.round(fixed, 9).alias("corrected"))


@register("agreement_totals", A.with_views("docs", "twice", body=f"""--and
m AS (SELECT count(*) AS labels, count(*) FILTER (NOT only_first AND NOT only_second) AS matched, count(*) FILTER (only_first) AS unjoined,
             count(*) FILTER (NOT only_first AND NOT only_second AND first = second) AS agreed, count(*) FILTER (NOT only_first AND NOT only_second AND NOT doubt_first) AS settled,
             count(*) FILTER (NOT only_first AND NOT only_second AND NOT doubt_first AND first = second) AS settled_agreed FROM twice)
SELECT labels, matched, unjoined, agreed, settled, settled_agreed, round(agreed / matched, 9) AS rate, round({wilson_sql('agreed', 'matched')[0]}, 9) AS low, round({wilson_sql('agreed', 'matched')[1]}, 9) AS high FROM m"""))
def agreement_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the reader agrees with the labels it could be joined to, over all and over those not in doubt."""
    df = A.labelled_twice(spark, sf_dir)
    both, same = ~F.col("only_first") & ~F.col("only_second"), F.col("first") == F.col("second")
    df = df.agg(F.count(F.lit(1)).alias("labels"), F.count_if(both).alias("matched"), F.count_if("only_first").alias("unjoined"), F.count_if(both & same).alias("agreed"),
                F.count_if(both & ~F.col("doubt_first")).alias("settled"), F.count_if(both & ~F.col("doubt_first") & same).alias("settled_agreed"))
    low, high = wilson(F.col("agreed"), F.col("matched"))
    return df.withColumns({"rate": F.round(ratio(F.col("agreed"), F.col("matched")), 9), "low": F.round(low, 9), "high": F.round(high, 9)})


@register("commonest_confusions", A.with_views("docs", "twice", body="""--and
c AS (SELECT first, second, count(*) AS n FROM twice WHERE first <> second GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY n DESC, second) AS place, sum(n) OVER (PARTITION BY first) AS wrong FROM c)
SELECT first, second, n, place, round(n / wrong, 9) AS share FROM r WHERE place <= 4"""))
def commonest_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each class is most often taken for, four at most."""
    df = A.labelled_twice(spark, sf_dir).where("first <> second").groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("first").orderBy(F.desc("n"), "second"))
    df = df.withColumn("place", place).withColumn("wrong", F.sum("n").over(W.partitionBy("first")))
    return df.where("place <= 4").select("first", "second", "n", "place", F.round(F.col("n") / F.col("wrong"), 9).alias("share"))


@register("reliability", A.with_views("docs", "twice", body=f"""--and
p AS (SELECT language, first, second FROM twice WHERE NOT only_first AND NOT only_second),
n AS (SELECT language, count(*) AS pairs, count(*) FILTER (first = second) AS agreed FROM p GROUP BY language),
a AS (SELECT language, first AS class, count(*) AS n FROM p GROUP BY ALL), b AS (SELECT language, second AS class, count(*) AS n FROM p GROUP BY ALL),
e AS (SELECT a.language, sum(a.n * b.n) AS products FROM a JOIN b ON a.language = b.language AND a.class = b.class GROUP BY a.language)
SELECT n.language, pairs, agreed, round(agreed / pairs, 9) AS rate, round({wilson_sql('agreed', 'pairs')[0]}, 9) AS low,
       round(CASE WHEN coalesce(products, 0) / (pairs * pairs) < 1 THEN (agreed / pairs - coalesce(products, 0) / (pairs * pairs)) / (1 - coalesce(products, 0) / (pairs * pairs)) END, 9) AS kappa FROM n LEFT JOIN e ON n.language = e.language"""))
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two labellers and Cohen's kappa by language, from the marginals."""
    p = A.labelled_twice(spark, sf_dir).where("NOT only_first AND NOT only_second")
    n = p.groupBy("language").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("first") == F.col("second")).alias("agreed"))
    a = p.groupBy("language", F.col("first").alias("class")).agg(F.count(F.lit(1)).alias("n_a"))
    b = p.groupBy("language", F.col("second").alias("class")).agg(F.count(F.lit(1)).alias("n_b"))
    e = a.join(b, ["language", "class"]).groupBy("language").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("products"))
    df = n.join(e, "language", "left")
    expected = F.coalesce("products", F.lit(0)) / (F.col("pairs") * F.col("pairs"))
    rate = F.col("agreed") / F.col("pairs")
    return df.select("language", "pairs", "agreed", F.round(rate, 9).alias("rate"), F.round(wilson(F.col("agreed"), F.col("pairs"))[0], 9).alias("low"), F.round(kappa(rate, expected), 9).alias("kappa"))


@register("commonest_split", A.with_views("docs", "twice", body="""--and
s AS (SELECT language, least(first, second) AS one, greatest(first, second) AS other, count(*) AS n FROM twice WHERE first <> second GROUP BY ALL)
SELECT language, one, other, n FROM s QUALIFY row_number() OVER (PARTITION BY language ORDER BY n DESC, one, other) = 1"""))
def commonest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair of classes that two labellers most often disagree over, whichever said which."""
    s = A.labelled_twice(spark, sf_dir).where("first <> second").groupBy("language", F.least("first", "second").alias("one"), F.greatest("first", "second").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    top = F.row_number().over(W.partitionBy("language").orderBy(F.desc("n"), "one", "other"))
    return s.withColumn("place", top).where("place = 1").select("language", "one", "other", "n")


@register("labeller_pairing", A.with_views("docs", "twice", body="""--and
a AS (SELECT doc_id, language, first FROM twice WHERE NOT only_second), b AS (SELECT doc_id, second FROM twice WHERE NOT only_first)
SELECT count(*) FILTER (first IS NOT NULL AND second IS NOT NULL) AS pairs, count(*) FILTER (second IS NULL) AS only_first, count(*) FILTER (first IS NULL) AS only_second FROM a FULL JOIN b USING (doc_id)"""))
def labeller_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of two labellers side by side: pairs, and those that only one gave."""
    t = A.labelled_twice(spark, sf_dir)
    both = t.where("NOT only_second").select("doc_id", "first").join(t.where("NOT only_first").select("doc_id", "second"), "doc_id", "full_outer")
    return both.agg(F.count_if(F.col("first").isNotNull() & F.col("second").isNotNull()).alias("pairs"), F.count_if(F.col("second").isNull()).alias("only_first"), F.count_if(F.col("first").isNull()).alias("only_second"))


@register("contested", A.with_views("docs", "twice", body="""
SELECT round(avg(CAST(doubt_first AS INT)), 9) AS flagged_first, round(avg(CAST(doubt_second AS INT)), 9) AS flagged_second,
       round(avg(CAST(first = second AS INT)) FILTER (NOT doubt_first AND NOT doubt_second), 9) AS clear_agreement, round(avg(CAST(first = second AS INT)) FILTER (doubt_first OR doubt_second), 9) AS contested_agreement FROM twice"""))
def contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each labeller flags doubt, and how far they agree with and without it."""
    same, doubt = (F.col("first") == F.col("second")).cast("int"), F.col("doubt_first") | F.col("doubt_second")
    return A.labelled_twice(spark, sf_dir).agg(
        F.round(F.avg(F.col("doubt_first").cast("int")), 9).alias("flagged_first"), F.round(F.avg(F.col("doubt_second").cast("int")), 9).alias("flagged_second"),
        F.round(F.avg(F.when(~doubt, same)), 9).alias("clear_agreement"), F.round(F.avg(F.when(doubt, same)), 9).alias("contested_agreement"))


@register("ceiling", A.with_views("docs", "twice", body="""--and
c AS (SELECT language, first, CASE WHEN NOT only_first THEN second WHEN NOT only_second THEN 'good' END AS again, CASE WHEN n_chars % 3 = 0 THEN 'poor' ELSE first END AS read FROM twice JOIN docs USING (doc_id, language)),
k AS (SELECT * FROM c WHERE again IS NOT NULL)
SELECT count(*) AS read_twice, count(*) FILTER (first = again) AS settled, count(*) FILTER (first <> again) AS split, count(*) FILTER (read = first OR read = again) AS matched_either,
       round(avg(CAST(first = again AS INT)), 9) AS ceiling, round(avg(CAST(read = first AS INT)) FILTER (first = again), 9) AS where_settled FROM k""".replace("JOIN docs USING (doc_id, language)", "JOIN (SELECT doc_id, n_chars FROM docs) USING (doc_id)")))
def ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items read twice by people and once by the reader: the best a reader can do is what people agree on."""
    t = A.labelled_twice(spark, sf_dir).join(A.documents(spark, sf_dir).select("doc_id", "n_chars"), "doc_id")
    again = F.when(~F.col("only_first"), F.col("second")).when(~F.col("only_second"), F.lit("good"))
    k = t.select("first", again.alias("again"), F.when(F.col("n_chars") % 3 == 0, F.lit("poor")).otherwise(F.col("first")).alias("read")).where(F.col("again").isNotNull())
    same, hit = F.col("first") == F.col("again"), F.col("read") == F.col("first")
    return k.agg(F.count(F.lit(1)).alias("read_twice"), F.count_if(same).alias("settled"), F.count_if(~same).alias("split"), F.count_if(hit | (F.col("read") == F.col("again"))).alias("matched_either"),
                 F.round(F.avg(same.cast("int")), 9).alias("ceiling"), F.round(F.avg(F.when(same, hit.cast("int"))), 9).alias("where_settled"))


@register("beyond_the_first", A.with_views("claims", body="""--and
x AS (SELECT review, CASE WHEN review % 4 <> 0 THEN list_sort(list_distinct(list(also_subject) FILTER (also_subject IS NOT NULL))) END AS asked, list_sort(list_distinct(list(subject) FILTER (subject IS NOT NULL AND ord % 2 = 1))) AS found FROM claims GROUP BY review)
SELECT review, len(asked) AS labelled, coalesce(len(found), 0) AS read, len(list_intersect(asked, coalesce(found, []))) AS agreed FROM x WHERE review % 4 <> 0""".replace("len(asked) AS labelled", "coalesce(len(asked), 0) AS labelled").replace("list_intersect(asked,", "list_intersect(coalesce(asked, []),")))
def beyond_the_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the other subjects labelled and read; reviews that were never asked have none and are left out."""
    df = A.claims(spark, sf_dir).where("review % 4 <> 0").groupBy("review").agg(F.collect_set("also_subject").alias("asked"), F.collect_set(F.when(F.col("ord") % 2 == 1, F.col("subject"))).alias("found"))
    return df.select("review", F.size("asked").cast("long").alias("labelled"), F.size("found").cast("long").alias("read"), F.size(F.array_intersect("asked", "found")).cast("long").alias("agreed"))


def merged(kept: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The new labels over the kept ones by key; a kept label without a new one stays."""
    a = kept.select(*keys, F.struct(*values).alias("old"))
    b = new.select(*keys, F.struct(*values).alias("new"))
    both = a.join(b, keys, "full_outer").withColumn("v", F.coalesce("new", "old"))
    return both.select(*keys, *[F.col(f"v.{v}").alias(v) for v in values])


@register("label_merge", A.with_views("docs", "twice", body="""--and
a AS (SELECT doc_id, first AS label FROM twice WHERE NOT only_second), b AS (SELECT doc_id, second AS label FROM twice WHERE NOT only_first AND doubt_first)
SELECT doc_id, coalesce(b.label, a.label) AS label FROM a FULL JOIN b USING (doc_id)"""))
def label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second labelling of doubtful items replaces the first; all others are kept."""
    t = A.labelled_twice(spark, sf_dir)
    return merged(t.where("NOT only_second").select("doc_id", F.col("first").alias("label")), t.where("NOT only_first AND doubt_first").select("doc_id", F.col("second").alias("label")), ["doc_id"], ["label"])


@register("keep_first", A.with_views("docs", "twice", body="""--and
u AS (SELECT doc_id, first AS label, 0 AS teaching FROM twice WHERE NOT only_second UNION ALL SELECT doc_id, second, 1 FROM twice WHERE NOT only_first),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY teaching) AS place, lead(label) OVER (PARTITION BY doc_id ORDER BY teaching) AS again FROM u)
SELECT doc_id, label, teaching, again FROM r WHERE place = 1"""))
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label an item: a randomly drawn one before a teaching one, the other becoming the second answer."""
    t = A.labelled_twice(spark, sf_dir)
    u = t.where("NOT only_second").select("doc_id", F.col("first").alias("label"), F.lit(0).alias("teaching")).unionByName(t.where("NOT only_first").select("doc_id", F.col("second").alias("label"), F.lit(1).alias("teaching")))
    w = W.partitionBy("doc_id").orderBy("teaching")
    return u.withColumn("place", F.row_number().over(w)).withColumn("again", F.lead("label").over(w)).where("place = 1").drop("place")


@register("label_summary", A.with_views("docs", "twice", body="""
SELECT language, first AS label, count(*) AS n, round(avg(CAST(doubt_first AS INT)), 9) AS contested, round(sum(CASE first WHEN 'good' THEN 1.0::DOUBLE WHEN 'rude' THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END), 6) AS weight FROM twice GROUP BY ALL"""))
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by language and class with the share in doubt and the sum of their weights."""
    weight = F.when(F.col("first") == "good", 1.0).when(F.col("first") == "rude", 0.7).otherwise(0.4)
    return A.labelled_twice(spark, sf_dir).groupBy("language", F.col("first").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("doubt_first").cast("int")), 9).alias("contested"), F.round(F.sum(weight), 6).alias("weight"))


@register("label_fingerprint", A.with_views("docs", "twice", body="SELECT language, substr(sha256(string_agg(doc_id || ':' || first, chr(10) ORDER BY doc_id || ':' || first)), 1, 16) AS fingerprint, count(*) AS n FROM twice GROUP BY language"))
def label_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of each language's labels that doesn't depend on their order; labels are a small table."""
    line = F.concat_ws(":", F.col("doc_id").cast("string"), "first")
    return A.labelled_twice(spark, sf_dir).groupBy("language").agg(
        F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256), 1, 16).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


@register("label_validation", A.with_views("docs", "twice", body="""
SELECT doc_id, CASE WHEN only_first THEN 'missing' WHEN second NOT IN ('good', 'poor') THEN 'unknown class' WHEN first = second AND doubt_second THEN 'names itself beside' ELSE 'taken' END AS verdict FROM twice"""))
def label_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a handed-in label is refused, the first reason that holds; else taken."""
    known = F.col("second").isin("good", "poor")
    verdict = F.when(F.col("only_first"), "missing").when(~known, "unknown class").when((F.col("first") == F.col("second")) & F.col("doubt_second"), "names itself beside").otherwise("taken")
    return A.labelled_twice(spark, sf_dir).select("doc_id", verdict.alias("verdict"))


@register("answered_reviews", A.with_views("claims", body="SELECT review, count(*) AS asked, count(*) FILTER (subject IS NOT NULL) AS labelled FROM claims WHERE ord % 2 = 0 GROUP BY review HAVING bool_and(subject IS NOT NULL)"))
def answered_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews whose every asked claim has a label; every second claim was asked about."""
    done = F.col("subject").isNotNull()
    return A.claims(spark, sf_dir).where("ord % 2 = 0").groupBy("review").agg(F.count(F.lit(1)).alias("asked"), F.count_if(done).alias("labelled"), F.bool_and(done).alias("all")).where("all").drop("all")


def measurement(role, matched):
    """How a game's figures can be measured."""
    return F.when(role == "train", "learned").when(matched.isNull(), "unlabelled").when(matched == 0, "unscored").otherwise("measured")


@register("gold_hold_backs", A.with_views("docs", body=r"""
SELECT CASE WHEN NOT regexp_matches(coalesce(text, ''), '\pL') THEN 'not a claim' WHEN lang = 'de' AND regexp_matches(text, '[ñ¿]') THEN 'wrong script' WHEN quality IS NULL THEN 'no longer cut' WHEN n_chars <> length(text) THEN 'other words' ELSE 'kept' END AS reason, count(*) AS n FROM docs GROUP BY 1"""))
def gold_hold_backs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items held back from judging by the first reason that applies."""
    text = F.coalesce("text", F.lit(""))
    reason = F.when(~text.rlike(r"\p{L}"), "not a claim").when((F.col("lang") == "de") & text.rlike("[ñ¿]"), "wrong script").when(F.col("quality").isNull(), "no longer cut").when(F.col("n_chars") != F.length("text"), "other words").otherwise("kept")
    return A.documents(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
