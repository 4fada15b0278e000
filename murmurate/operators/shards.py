"""Captures as files: written as shards and sweeps, found again, and read whole, as counted, by id and with their readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurate import corpus
from murmurate.operators.prepared import fresh
from murmurate.plans import adapters as A
from murmurate.registry import register
from murmurate.session import table
from murmurate.sources import capture

SWEEP = 1_700_000_000


def write_copies(df: DataFrame, snapshot: str, name: str) -> int:
    """Writes copies as files of a snapshot, ``shard-<n>.parquet`` or one ``sweep-<time>.parquet``; returns how many files there are.

    A shard is what one task writes. Files are written aside and take their names by rename.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(snapshot).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    draft = f"{snapshot}/.{name}.partial"
    (df.coalesce(1) if name.startswith("sweep-") else df).write.mode("overwrite").parquet(draft)
    made = sorted(s.getPath().toString() for s in fs.listStatus(path(draft)) if s.getPath().getName().startswith("part-"))
    for n, file in enumerate(made):
        fs.rename(path(file), path(f"{snapshot}/{name}.parquet" if name.startswith("sweep-") else f"{snapshot}/{name}-{n}.parquet"))
    fs.delete(path(draft), True)
    return len(made)


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as captured reviews; the last third of the ids is swept, a few of them for the first time."""
    d = table(spark, sf_dir, "documents")
    given = {"recommendationid": F.col("doc_id").cast("string"), "appid": F.lit(7).cast("long"), "author_steamid": F.col("source"), "language": F.col("lang"), "review": F.col("text"),
             "timestamp_created": F.col("doc_id") * 1000, "timestamp_updated": F.col("doc_id") * 1000, "voted_up": F.col("doc_id") % 3 > 0, "votes_up": F.col("doc_id") % 5, "weighted_vote_score": F.col("doc_id") % 10 / 10,
             "author_playtime_at_review": F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 900), "raw_json": F.lit("{}")}
    return d.select(*[F.coalesce(given[f.name], F.lit("")).alias(f.name) if f.name == "recommendationid" else given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in capture.CAPTURE.fields])


def written(spark: SparkSession, sf_dir: str) -> str:
    """A library with an older, empty snapshot and one with a crawl and a sweep; returns its root.

    Documents without an id are copies of the crawl whose id is empty.
    """
    root = fresh(spark, "library")
    copies, number = _copies(spark, sf_dir), F.col("recommendationid").try_cast("long")
    write_copies(copies.limit(0), f"{root}/appid=7/snapshot=300", "other")
    write_copies(copies.where(F.coalesce(number % 10 < 9, F.lit(True))), f"{root}/appid=7/snapshot=200", "shard")
    swept = copies.where(number % 10 >= 7).withColumn("review", F.concat(F.lit("edited "), "review")).withColumn("timestamp_updated", F.col("timestamp_updated") + 5)
    write_copies(swept, f"{root}/appid=7/snapshot=200", f"sweep-{SWEEP}")
    return root


def _snapshot(spark: SparkSession, sf_dir: str) -> str:
    found = capture.latest_snapshot(spark, written(spark, sf_dir), 7)
    if found is None:
        raise FileNotFoundError("no snapshot with a shard")
    return found


@register("capture_scan", f"""
SELECT doc_id AS id, CAST(0 AS BIGINT) AS sweep, 'shard' AS kind, 200 AS snapshot FROM documents WHERE doc_id % 10 < 9
UNION ALL SELECT doc_id, {SWEEP}, 'sweep', 200 FROM documents WHERE doc_id % 10 >= 7""")
def capture_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of the newest snapshot that has a shard, with the file it came from."""
    snapshot = _snapshot(spark, sf_dir)
    rows = capture.scan(spark, snapshot)
    return rows.select(F.col("recommendationid").cast("long").alias("id"), "sweep", F.regexp_extract("capture_file", "^([a-z]+)-", 1).alias("kind"), F.lit(int(snapshot.rsplit("=", 1)[1])).alias("snapshot"))


_NEWEST = """n AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 10 >= 7 THEN 'edited ' || text ELSE text END AS review, doc_id % 10 >= 7 AS swept FROM documents)"""
_BLANK = r"(review IS NULL OR regexp_matches(review, '^[\s\p{Z}\x0b\x{85}]*$'))"


@register("counting_rows", f"WITH {_NEWEST} SELECT doc_id AS id, coalesce(lang, '') AS language, doc_id * 1000 AS created, doc_id % 3 > 0 AS voted_up, CASE WHEN doc_id % 4 > 0 THEN doc_id % 900 END AS played, coalesce(source, '') AS author, sha256(review) AS text FROM n WHERE NOT {_BLANK}")
def counting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that are counted, with their authors."""
    rows = capture.counting_rows(capture.newest(capture.scan(spark, _snapshot(spark, sf_dir))))
    return rows.select(F.col("recommendationid").cast("long").alias("id"), "language", "created", "voted_up", F.col("played_minutes").alias("played"), "author", F.sha2("review", 256).alias("text"))


@register("english_bodies", f"WITH {_NEWEST} SELECT doc_id AS id, octet_length(encode(review)) AS bytes FROM n WHERE review IS NOT NULL AND lang = 'en'")
def english_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of one language, filtered in the scan."""
    rows = capture.bodies(capture.newest(capture.scan(spark, _snapshot(spark, sf_dir)))).where("language = 'en'")
    return rows.select(F.col("recommendationid").cast("long").alias("id"), F.octet_length("text").cast("long").alias("bytes"))


@register("reviews_by_id", f"WITH {_NEWEST} SELECT n.doc_id AS id, sha256(review) AS text, n.doc_id % 5 AS votes_up FROM n JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l ON n.doc_id = l.doc_id")
def reviews_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reviews of some ids."""
    ids = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("recommendationid"))
    rows = capture.reviews_named(capture.newest(capture.scan(spark, _snapshot(spark, sf_dir))), ids)
    return rows.select(F.col("recommendationid").cast("long").alias("id"), F.sha2("review", 256).alias("text"), "votes_up")


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of every text as one reading, the rest as a second that is declined where the id is even."""
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"^[ -~]{40,}"))
    span = F.explode(F.array(F.struct(F.lit(0).alias("a"), F.lit(20).alias("b")), F.struct(F.lit(20).alias("a"), F.lit(40).alias("b"))))
    r = d.select("doc_id", span.alias("s")).select("doc_id", "s.a", "s.b")
    declined = (F.col("a") > 0) & (F.col("doc_id") % 2 == 0)
    return r.select(F.col("doc_id").cast("string").alias("recommendationid"), F.col("a").cast("long").alias("start"), F.col("b").cast("long").alias("end"), F.when(~declined, F.concat(F.lit("s"), (F.col("doc_id") % 6).cast("string"))).alias("subject"),
                    F.lit(0.5).cast("float").alias("confidence"), F.when(F.col("doc_id") % 3 == 0, "praise").otherwise("complaint").alias("polarity"), F.when(F.col("doc_id") % 5 == 0, "s9:neutral").alias("also"), F.lit(None).cast("decimal(20,0)").alias("text_key"))


_READ = r"""r AS (SELECT doc_id, a, a + 20 AS b, CASE WHEN NOT (a > 0 AND doc_id % 2 = 0) THEN 's' || doc_id % 6 END AS subject, CASE WHEN doc_id % 3 = 0 THEN 'praise' ELSE 'complaint' END AS polarity, doc_id % 5 = 0 AS beside
  FROM documents, (SELECT unnest([0, 20]) AS a) WHERE regexp_matches(text, '^[ -~]{40,}'))"""


@register("readings_scan", f"WITH {_READ} SELECT subject, polarity, count(*) AS n, count(*) FILTER (beside) AS beside FROM r GROUP BY ALL")
def readings_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings written and read back, with what stands beside the first subject as a map."""
    path = fresh(spark, "readings")
    _readings(spark, sf_dir).write.parquet(path)
    return capture.readings(spark, path).groupBy("subject", "polarity").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("also_map") > 0).alias("beside"))


def _corpus(spark: SparkSession, sf_dir: str) -> corpus.Corpus:
    path = fresh(spark, "readings")
    _readings(spark, sf_dir).write.parquet(path)
    return corpus.Corpus.from_capture(spark, _snapshot(spark, sf_dir), path)


@register("corpus_behind_a_term", f"""WITH {_NEWEST}, {_READ},
c AS (SELECT n.doc_id, r.a, r.subject, r.polarity, substr(review, CAST(a + 1 AS INT), 20) AS claim FROM r JOIN n ON r.doc_id = n.doc_id AND NOT {_BLANK}),
m AS (SELECT doc_id, a, claim FROM c WHERE subject = 's1' AND polarity = 'complaint' AND regexp_matches(claim, '(?i)(^|[^\\pL\\pN])the($|[^\\pL\\pN])'))
SELECT doc_id AS review, CAST(a // 20 AS INT) AS ord, claim, (SELECT count(*) FROM m) AS total FROM m ORDER BY review, ord LIMIT 25""")
def corpus_behind_a_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims behind a subject's complaints that say a word, the first page, from a capture and its readings."""
    found = _corpus(spark, sf_dir).claims_behind("s1", "complaint", term="the")
    return found.select(F.col("review").cast("long").alias("review"), "ord", "claim", "total")


@register("corpus_by_kind", f"""WITH {_NEWEST}, {_READ},
k AS (SELECT doc_id FROM n WHERE NOT {_BLANK} AND doc_id % 4 > 0 AND doc_id % 900 < 120)
SELECT subject, count(DISTINCT r.doc_id) AS reviews FROM r JOIN k USING (doc_id) WHERE subject IS NOT NULL GROUP BY subject""")
def corpus_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of one kind of reviewer by subject, from a capture and its readings."""
    of_kind = _corpus(spark, sf_dir).of_kind("under-2-hours")
    return of_kind.claims.where(F.col("subject").isNotNull()).groupBy("subject").agg(F.countDistinct("review").alias("reviews"))


@register("measurement", A.with_views("docs", "twice", body="""--and
g AS (SELECT language, CASE WHEN language = 'en' THEN 'train' ELSE 'held-out' END AS role, CASE WHEN language = 'de' THEN NULL ELSE count(*) FILTER (first = second) END AS matched FROM twice GROUP BY language)
SELECT language, CASE WHEN role = 'train' THEN 'learned' WHEN matched IS NULL THEN 'unlabelled' WHEN matched = 0 THEN 'unscored' ELSE 'measured' END AS standing FROM g"""))
def measurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the figures of each language can be measured."""
    from murmurate.operators.labels import measurement as standing

    g = A.labelled_twice(spark, sf_dir).groupBy("language").agg(F.count_if(F.col("first") == F.col("second")).alias("n"))
    matched = F.when(F.col("language") != "de", F.col("n"))
    return g.select("language", standing(F.when(F.col("language") == "en", "train").otherwise("held-out"), matched).alias("standing"))


@register("kept_texts", "SELECT doc_id, lang AS language, sha256(text) AS text FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0")
def kept_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept texts as lines of JSON, written and read back."""
    from murmurate.sources import files

    path = fresh(spark, "kept")
    table(spark, sf_dir, "documents").where("text IS NOT NULL AND doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("review_id"), F.col("lang").alias("language"), "text").write.json(path)
    return files.kept_texts(spark, path).select(F.col("review_id").cast("long").alias("doc_id"), "language", F.sha2("text", 256).alias("text"))


@register("table_for_people", A.with_views("reviews", body="SELECT game, language, count(*) AS reviews, CAST(count(*) FILTER (voted_up) AS VARCHAR) AS positive FROM reviews GROUP BY ALL"))
def table_for_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV and JSON for people; counts come back from one and the share from the other."""
    from murmurate.sources import files

    folder = fresh(spark, "tables")
    made = A.reviews(spark, sf_dir).groupBy("game", "language").agg(F.count(F.lit(1)).alias("reviews"), F.count_if("voted_up").alias("positive"))
    files.write_table(made, folder, "games", "game", "language")
    lines = spark.read.option("header", True).csv(f"{folder}/games.csv").toDF("game", "language", "reviews_text", "positive")
    whole = spark.read.schema("game string, language string, reviews long").option("multiLine", True).json(f"{folder}/games.json")
    return whole.join(lines.drop("reviews_text"), ["game", "language"])
