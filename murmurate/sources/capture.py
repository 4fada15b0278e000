"""Captures: immutable shards of a crawl and later sweeps, read as one table of newest copies.

A snapshot folder holds ``shard-*.parquet`` (the crawl) and ``sweep-<unix>.parquet`` (what changed since); anything
else in it is ignored. Of an id that any sweep holds, only the newest sweep copy counts, by edit time and then by
sweep; ids that no sweep holds count as they stand in the shards, each copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a capture as files hold them. Fixed values.
CAPTURE = T.StructType([
    T.StructField("recommendationid", T.StringType(), False), T.StructField("appid", T.LongType(), False), T.StructField("author_steamid", T.StringType()),
    *[T.StructField(f"author_{n}", T.LongType()) for n in ("num_games_owned", "num_reviews", "playtime_forever", "playtime_at_review", "playtime_last_two_weeks")],
    T.StructField("author_last_played", T.LongType()), T.StructField("language", T.StringType()), T.StructField("review", T.StringType()),
    T.StructField("timestamp_created", T.LongType()), T.StructField("timestamp_updated", T.LongType()), T.StructField("voted_up", T.BooleanType()),
    T.StructField("votes_up", T.LongType()), T.StructField("votes_funny", T.LongType()), T.StructField("weighted_vote_score", T.DoubleType()), T.StructField("comment_count", T.LongType()),
    *[T.StructField(n, T.BooleanType()) for n in ("steam_purchase", "received_for_free", "written_during_early_access", "refunded", "primarily_steam_deck")],
    T.StructField("raw_json", T.StringType(), False)])

READINGS = T.StructType([
    T.StructField("recommendationid", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("subject", T.StringType()),
    T.StructField("confidence", T.FloatType()), T.StructField("polarity", T.StringType()), T.StructField("also", T.StringType()), T.StructField("text_key", T.DecimalType(20, 0))])

U32_MAX = (1 << 32) - 1


def scan(spark: SparkSession, snapshot: str, schema: T.StructType = CAPTURE) -> DataFrame:
    """All copies of a snapshot with ``sweep`` (0 for the crawl) and their order (``capture_file``, ``capture_row``)."""
    df = spark.read.schema(schema).option("pathGlobFilter", "{shard,sweep}-*.parquet").parquet(snapshot)
    name = F.col("_metadata.file_name")
    sweep = F.coalesce(F.regexp_extract(name, r"^sweep-(\d+)\.parquet$", 1).try_cast("long"), F.lit(0).cast("long"))
    return df.select("*", sweep.alias("sweep"), name.alias("capture_file"), F.col("_metadata.row_index").alias("capture_row"))


def newest(copies: DataFrame, key: str = "recommendationid", updated: str = "timestamp_updated", sweep: str = "sweep", as_of: int | None = None) -> DataFrame:
    """The copies that count, as of a time if one is given: then later sweeps are not seen.

    Swept ids are few beside the crawl, so their newest copy is found by one aggregate and joined back.
    """
    if as_of is not None:
        copies = copies.where(F.col(sweep) <= as_of)
    stamp = F.struct(F.coalesce(F.col(updated), F.lit(0)).cast("long").alias("u"), F.col(sweep).cast("long").alias("s"))
    best = copies.where(F.col(sweep) > 0).groupBy(F.col(key).alias("swept_id")).agg(F.max(stamp).alias("best"))
    joined = copies.join(best, F.col(key) == F.col("swept_id"), "left")
    return joined.where(F.col("best").isNull() | ((F.col(sweep) > 0) & (stamp == F.col("best")))).drop("swept_id", "best")


def only_swept(copies: DataFrame, counted: DataFrame, as_of: int, key: str = "recommendationid", sweep: str = "sweep") -> DataFrame:
    """Ids that sweeps up to a time hold but neither the crawl nor ``counted`` does."""
    swept = copies.where((F.col(sweep) > 0) & (F.col(sweep) <= as_of)).select(key).distinct()
    crawled = copies.where(F.col(sweep) == 0).select(key)
    return swept.join(crawled, key, "left_anti").join(counted.select(key), key, "left_anti")


def blank(text: Column) -> Column:
    """Whether a text is null or white space alone, by Unicode's measure."""
    return text.isNull() | text.rlike(r"^[\s\p{Z}\u0085]*$")


def counting_rows(df: DataFrame) -> DataFrame:
    """Rows that are counted: blank texts go, and nulls get the values that counting gives them; minutes stay null."""
    flag = lambda n: F.coalesce(F.col(n), F.lit(False)).alias(n)
    return df.where(~blank(F.col("review"))).select(
        "recommendationid", "review", F.coalesce("language", F.lit("")).alias("language"), F.coalesce("timestamp_created", F.lit(0)).alias("created"),
        flag("voted_up"), F.coalesce("votes_up", F.lit(0)).alias("votes_up"), F.coalesce("weighted_vote_score", F.lit(0.0)).alias("helpfulness"),
        F.col("author_playtime_at_review").alias("played_minutes"), flag("primarily_steam_deck"), flag("written_during_early_access"), flag("received_for_free"),
        F.coalesce("author_steamid", F.lit("")).alias("author"))


def bodies(df: DataFrame) -> DataFrame:
    """(id, language, text): null texts go, blank ones stay."""
    return df.where(F.col("review").isNotNull()).select("recommendationid", "language", F.col("review").alias("text"))


def reviews_named(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Whole reviews of some ids; Spark broadcasts the ids where they are few."""
    return df.join(ids, "recommendationid", "left_semi")


def facts_named(df: DataFrame, ids: DataFrame) -> DataFrame:
    """What may be published of some reviews: no text and no author, but the text's hash and size."""
    kept = [c for c in df.columns if c not in ("review", "author_steamid", "raw_json", "sweep", "capture_file", "capture_row")]
    return reviews_named(df, ids).select(*kept, F.sha2("review", 256).alias("text_sha256"), F.octet_length("review").alias("text_bytes"))


def latest_snapshot(spark: SparkSession, root: str, app_id: int) -> str | None:
    """The newest ``appid=/snapshot=`` folder that holds a shard."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/appid={app_id}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = sorted((s.getPath().getName() for s in fs.listStatus(folder)), key=lambda n: int(n.split("=")[1]) if n.startswith("snapshot=") and n.split("=")[1].isdigit() else -1, reverse=True)
    for name in names:
        files = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/appid={app_id}/{name}/shard-*.parquet"))
        if name.startswith("snapshot=") and files is not None and len(files):
            return f"{root}/appid={app_id}/{name}"
    return None


def from_json_lines(raw: DataFrame, app_id: int, column: str = "value") -> DataFrame:
    """Review objects as JSON text into the capture's columns; counts beyond 32 bits and texts that are no numbers are null.

    A line without an id is refused when it is written (the column can't be null).
    """
    j = lambda path: F.get_json_object(F.col(column), f"$.{path}")
    whole = lambda path: F.when(j(path).try_cast("long").between(0, U32_MAX), j(path).try_cast("long"))
    flag = lambda path: j(path).try_cast("boolean")
    text = F.from_json(F.col(column), "recommendationid string, language string, review string, author struct<steamid: string>")
    rows = raw.select(column, text.alias("t"))
    return rows.select(
        F.col("t.recommendationid").alias("recommendationid"), F.lit(app_id).cast("long").alias("appid"), F.col("t.author.steamid").alias("author_steamid"),
        *[whole(f"author.{n}").alias(f"author_{n}") for n in ("num_games_owned", "num_reviews", "playtime_forever", "playtime_at_review", "playtime_last_two_weeks")],
        j("author.last_played").try_cast("long").alias("author_last_played"), F.col("t.language").alias("language"), F.col("t.review").alias("review"),
        j("timestamp_created").try_cast("long").alias("timestamp_created"), j("timestamp_updated").try_cast("long").alias("timestamp_updated"), flag("voted_up").alias("voted_up"),
        whole("votes_up").alias("votes_up"), whole("votes_funny").alias("votes_funny"), j("weighted_vote_score").try_cast("double").alias("weighted_vote_score"), whole("comment_count").alias("comment_count"),
        *[flag(n).alias(n) for n in ("steam_purchase", "received_for_free", "written_during_early_access", "refunded", "primarily_steam_deck")],
        F.col(column).alias("raw_json"))


def readings(spark: SparkSession, path: str) -> DataFrame:
    """Readings with ``also`` as a map; a file without the expected columns is refused."""
    from murmurate.functions.formats import also_map

    df = spark.read.parquet(path)
    missing = [f.name for f in READINGS.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"stale readings, without {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in READINGS.fields]).withColumn("also_map", also_map(F.col("also")))
