"""What a crawl has done and has still to do, files of older formats, briefs for a writer, and a reader scored on a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmurate import reading
from murmurate.functions import writing
from murmurate.operators import vectors  # noqa: F401  its SQL is used
from murmurate.plans import adapters as A
from murmurate.registry import SQL, register
from murmurate.session import table
from murmurate.sources.capture import READINGS

#: Rows short of a window's expected number, in shares of it, from which it is asked again.
SHORT = 0.05


def rest_for(busy: float, share: float) -> float:
    """Seconds to rest after some busy ones, so that work takes that share of the time."""
    return 0.0 if share >= 1 else busy * (1 - share) / share


def crawl_state(planned: DataFrame, runs: DataFrame) -> DataFrame:
    """Each planned window (app_id, window, expected) after the runs so far (app_id, window, fetched, reason, newest): done, asked again or pending.

    The newest run of a window counts; one that came back short is asked again unless it reached its end.
    """
    last = runs.groupBy("app_id", "window").agg(F.max(F.struct("newest", "fetched", "reason")).alias("l"), F.count(F.lit(1)).alias("tries"))
    df = planned.join(last, ["app_id", "window"], "left")
    short = F.col("l.fetched") < F.col("expected") * (1 - SHORT)
    state = F.when(F.col("l").isNull(), "pending").when((F.col("l.reason") != "end") & short, "again").otherwise("done")
    return df.select("app_id", "window", "expected", F.coalesce("tries", F.lit(0)).alias("tries"), F.col("l.fetched").alias("fetched"), F.col("l.newest").alias("newest"), state.alias("state"))


@register("crawl_windows", """
WITH p AS (SELECT event_type AS app_id, CAST(user_id % 50 AS INT) AS win, count(*) AS expected FROM events GROUP BY ALL),
r AS (SELECT event_type AS app_id, CAST(user_id % 50 AS INT) AS win, CAST(event_id % 2 AS INT) AS run, count(*) FILTER (event_id % 3 > 0) AS fetched, CASE WHEN user_id % 50 % 4 = 0 THEN 'end' ELSE 'cap' END AS reason, max(event_id) AS newest FROM events WHERE user_id % 50 <> 7 GROUP BY ALL),
l AS (SELECT app_id, win, arg_max(fetched, newest) AS fetched, arg_max(reason, newest) AS reason, max(newest) AS newest, count(*) AS tries FROM r GROUP BY ALL)
SELECT app_id, win AS "window", expected, coalesce(tries, 0) AS tries, fetched, newest, CASE WHEN l.newest IS NULL THEN 'pending' WHEN reason <> 'end' AND fetched < expected * (1 - 0.05::DOUBLE) THEN 'again' ELSE 'done' END AS state FROM p LEFT JOIN l USING (app_id, win)""")
def crawl_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of every type of event as a crawl would have to fetch them, after two runs over most of them."""
    e = table(spark, sf_dir, "events").withColumn("window", (F.col("user_id") % 50).cast("int")).withColumnRenamed("event_type", "app_id")
    planned = e.groupBy("app_id", "window").agg(F.count(F.lit(1)).alias("expected"))
    runs = e.where("window <> 7").groupBy("app_id", "window", (F.col("event_id") % 2).alias("run")).agg(F.count_if(F.col("event_id") % 3 > 0).alias("fetched"), F.max("event_id").alias("newest"))
    return crawl_state(planned, runs.withColumn("reason", F.when(F.col("window") % 4 == 0, "end").otherwise("cap")))


def brought(df: DataFrame, schema: T.StructType = READINGS, names: dict[str, str] | None = None) -> DataFrame:
    """Rows of an older format in the present one: renamed columns under their new names, absent ones null, others gone."""
    old = {new: was for was, new in (names or {}).items()}
    pick = lambda f: F.col(f.name) if f.name in df.columns else F.col(old[f.name]) if old.get(f.name) in df.columns else F.lit(None)
    return df.select(*[pick(f).cast(f.dataType).alias(f.name) for f in schema.fields])


@register("readings_brought", A.with_views("claims", body="SELECT CAST(review AS VARCHAR) AS recommendationid, CAST(ord AS BIGINT) AS start, subject, round(confidence::FLOAT::DOUBLE, 4) AS confidence, true AS no_key FROM claims"))
def readings_brought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a format without keys and with another name for ids, brought to the present one."""
    old = A.claims(spark, sf_dir).select(F.col("review").alias("id"), F.col("ord").alias("start"), "subject", "confidence", "polarity", F.lit(1).alias("unused"))
    new = brought(old, names={"id": "recommendationid"})
    return new.select("recommendationid", "start", "subject", F.round(F.col("confidence").cast("double"), 4).alias("confidence"), F.col("text_key").isNull().alias("no_key"))


@register("briefs", A.with_views("sides", body="""--and
p AS (SELECT 'praise' AS side, subject, count(*) FILTER (praise) AS n FROM sides GROUP BY subject UNION ALL SELECT 'complaint', subject, count(*) FILTER (complaint) FROM sides GROUP BY subject),
r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n DESC, subject DESC) AS place FROM p)
SELECT side, string_agg(subject || ' (' || format('{:,}', n) || ' reviews)', '; ' ORDER BY place) AS told FROM r WHERE place <= 8 GROUP BY side"""))
def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a writer is told: the eight points most raised on either side."""
    s = A.sides(A.claims(spark, sf_dir))
    both = F.explode(F.array(F.struct(F.lit("praise").alias("side"), F.col("praise").alias("hit")), F.struct(F.lit("complaint").alias("side"), F.col("complaint").alias("hit"))))
    points = s.select("subject", both.alias("x")).groupBy(F.col("x.side").alias("side"), F.col("subject").alias("label")).agg(F.count_if("x.hit").alias("reviews"))
    return writing.brief(points)


def scored_on(key: DataFrame, model: reading.Model) -> DataFrame:
    """A key's claims (text_key, ord, claim, language, truth) answered by a model, by subject: labelled, answered and agreed."""
    found = reading.answered(key, model)
    return found.groupBy("truth").agg(F.count(F.lit(1)).alias("labelled"), F.count("subject").alias("answered"), F.count_if(F.col("subject") == F.col("truth")).alias("agreed"))


@register("reader_on_a_key", """
WITH k AS (SELECT p_brand AS truth, CASE WHEN length(p_name) % 5 = 0 THEN NULL WHEN length(p_name) % 2 = 0 THEN substr(p_name, 1, 3) || p_brand ELSE p_brand END AS said FROM part)
SELECT truth, count(*) AS labelled, count(said) AS answered, count(*) FILTER (said = truth) AS agreed FROM k GROUP BY truth""")
def reader_on_a_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in reader, which says what its claim ends on and is wrong by a rule, against a key."""
    p = table(spark, sf_dir, "part")
    key = p.select(F.col("p_partkey").alias("text_key"), F.lit(0).alias("ord"), F.concat("p_name", F.lit("|"), "p_brand").alias("claim"), F.lit("en").alias("language"), F.col("p_brand").alias("truth"))

    def model(texts, languages):
        out = []
        for t in texts:
            name, brand = t.split("|")
            out.append((None if len(name) % 5 == 0 else name[:3] + brand if len(name) % 2 == 0 else brand, 0.5, "neutral", {}))
        return out

    return scored_on(key, model)


def asks(df: DataFrame, subject: str, ambiguous: str, key: str, text: str, subjects: tuple[str, ...] = (), only_ambiguous: bool = False, one_in: int = 1, words: str | None = None) -> DataFrame:
    """The labels that a revisit question is asked of: all conditions that are set must hold.

    one_in keeps those whose key's first four hash bytes, little-endian, divide by it; words is a phrase that the text says.
    """
    from murmurate.functions import text as tx

    digest = F.sha2(F.col(key).cast("string"), 256)
    number = F.conv(F.concat(*[F.substring(digest, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
    out = df.where(number % one_in == 0) if one_in > 1 else df
    out = out.where(F.col(subject).isin(*subjects)) if subjects else out
    out = out.where(F.col(ambiguous)) if only_ambiguous else out
    return out.where(F.size(tx.phrase_forms(F.translate(text, "‘’", "''"), words)) > 0) if words else out


@register("revisit_questions", A.with_views("docs", "twice", body=r"""--and
q AS (SELECT doc_id, first, doubt_first, text, sha256(CAST(doc_id AS VARCHAR)) AS s FROM twice JOIN (SELECT doc_id, text FROM docs) USING (doc_id)),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: x <> '') AS words FROM q WHERE first IN ('good', 'rude') AND CAST('0x' || substr(s, 7, 2) || substr(s, 5, 2) || substr(s, 3, 2) || substr(s, 1, 2) AS BIGINT) % 2 = 0)
SELECT doc_id, first FROM w WHERE list_contains(words, 'the') OR list_contains(words, 'la')"""))
def revisit_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second label of two classes whose text says one of two words."""
    q = A.labelled_twice(spark, sf_dir).join(A.documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    asked = [asks(q, "first", "doubt_first", "doc_id", "text", ("good", "rude"), one_in=2, words=w) for w in ("the", "la")]
    return asked[0].unionByName(asked[1]).select("doc_id", "first").distinct()


@register("neighbour_draw", f"""WITH m AS ({SQL['rare_margins']}),
k AS (SELECT m.vec_id, label AS subject, CAST(trunc((2 - greatest(-2.0::DOUBLE, least(2.0::DOUBLE, margin))) * 1000000) AS BIGINT) AS key FROM m JOIN embeddings e ON m.vec_id = e.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY key, vec_id) AS place FROM k)
SELECT subject, vec_id, place FROM p ORDER BY place, subject LIMIT 60""")
def neighbour_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty vectors, subjects in turn, widest margin to the rare queries first; margins within a millionth tie."""
    from murmurate.operators.sampling import round_robin
    from murmurate.operators.vectors import rare_margins

    m = rare_margins(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("subject")), "vec_id")
    key = ((2 - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("margin")))) * 1_000_000).cast("long")
    return round_robin(m.withColumn("key", key), "subject", 60, "key", "vec_id").select("subject", "vec_id", "place")


def tfidf_baseline(train: DataFrame, held: DataFrame, text: str, label: str, features: int = 1 << 15, rounds: int = 40) -> DataFrame:
    """held with ``guess`` and ``confidence`` of a logistic regression on weighted counts of words and pairs of words."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, IndexToString, StringIndexer
    from pyspark.ml.functions import vector_to_array

    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    both = lambda w: F.concat(w, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))
    cut = lambda df: df.withColumn("terms_of", F.element_at(F.transform(F.array(words), both), 1))
    names = StringIndexer(inputCol=label, outputCol="class_of", stringOrderType="alphabetAsc", handleInvalid="skip").fit(train)
    model = Pipeline(stages=[names, HashingTF(inputCol="terms_of", outputCol="counts_of", numFeatures=features), IDF(inputCol="counts_of", outputCol="weights_of"),
                             LogisticRegression(featuresCol="weights_of", labelCol="class_of", maxIter=rounds, regParam=0.01, predictionCol="guess_of", probabilityCol="shares_of")]).fit(cut(train))
    scored = cut(held)
    for stage in model.stages[1:]:
        scored = stage.transform(scored)
    named = IndexToString(inputCol="guess_of", outputCol="guess", labels=names.labels).transform(scored)
    return named.withColumn("confidence", F.array_max(vector_to_array("shares_of"))).select(*held.columns, "guess", "confidence")


@register("tfidf_baseline")
def tfidf_baseline_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline on the labelled documents of three sources in four, held against the rest, by label."""
    d = A.documents(spark, sf_dir).where("quality IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.col("quality").cast("string").alias("label"))
    found = tfidf_baseline(d.where("doc_id % 4 <> 0"), d.where("doc_id % 4 = 0"), "text", "label")
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("held"), F.count_if(F.col("guess") == F.col("label")).alias("hit"), F.round(F.avg("confidence"), 6).alias("confidence"))
