"""Sweeps as a stream: new copies arrive in files and move a table of newest copies forward, once each.

Each batch is written under its own number, so a batch that is run again replaces itself; readers take the newest
copy over all batches. Beside it, event-time windows over the events table, which are an addition of this engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from murmurate.registry import register
from murmurate.session import table

COPY = T.StructType([T.StructField("id", T.LongType()), T.StructField("updated", T.LongType()), T.StructField("text", T.StringType())])


def arriving(spark: SparkSession, folder: str, schema: T.StructType = COPY, files_a_batch: int = 1) -> DataFrame:
    """Copies as files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(folder)


def without_repeats(stream: DataFrame, slack: str = "1 day") -> DataFrame:
    """Each edit of an id once, late ones up to a slack behind the newest edit."""
    timed = stream.withColumn("edited", F.timestamp_seconds("updated"))
    return timed.withWatermark("edited", slack).dropDuplicatesWithinWatermark(["id", "updated"])


def sweep_into(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's copies as one sweep, named by the batch; running a batch twice leaves it once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("sweep", F.lit(number + 1)).write.mode("overwrite").parquet(f"{target}/sweep={number + 1}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The newest copy of every id over all sweeps, later sweeps winning ties."""
    df = spark.read.option("basePath", target).parquet(f"{target}/sweep=*")
    last = F.struct("updated", "sweep", "text")
    return df.groupBy("id").agg(F.max(last).alias("c")).select("id", "c.updated", "c.sweep", "c.text")


@register("event_windows", """
SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type; the same expression runs on a stream with a watermark."""
    return daily(table(spark, sf_dir, "events"))


def daily(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.countDistinct("user_id").alias("users")).select(
        F.col("w.start").alias("day"), "event_type", "n", "total", "users")


@register("event_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in sessions that end after half an hour without one."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


@register("events_sliding", """
WITH b AS (SELECT event_type, unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS started, value FROM events)
SELECT started, event_type, count(*) AS n, round(max(value), 6) AS greatest FROM b GROUP BY ALL""")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve-hour windows every six hours."""
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "12 hours", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("greatest")).select(F.col("w.start").alias("started"), "event_type", "n", "greatest")
