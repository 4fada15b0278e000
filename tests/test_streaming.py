"""Sweeps as streams: once each, late copies dropped, and the newest copy wins."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from murmurate.streaming import sweeps


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("id", "updated", "text"), r, strict=True))) for r in rows))


def test_sweeps_arrive_once(spark, tmp_path):
    put(tmp_path / "in", "a.json", [(1, 10, "old"), (2, 10, "two")])
    target, mark = str(tmp_path / "out"), str(tmp_path / "check")
    sweeps.sweep_into(sweeps.arriving(spark, str(tmp_path / "in")), target, mark).awaitTermination()
    put(tmp_path / "in", "b.json", [(1, 20, "new"), (3, 5, "three")])
    sweeps.sweep_into(sweeps.arriving(spark, str(tmp_path / "in")), target, mark).awaitTermination()
    sweeps.sweep_into(sweeps.arriving(spark, str(tmp_path / "in")), target, mark).awaitTermination()
    got = sorted((r["id"], r["text"]) for r in sweeps.current(spark, target).collect())
    assert got == [(1, "new"), (2, "two"), (3, "three")]


def test_repeats_within_the_slack(spark, tmp_path):
    put(tmp_path / "in", "a.json", [(1, 100, "x"), (1, 100, "x"), (1, 200, "y")])
    stream = sweeps.without_repeats(sweeps.arriving(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["updated"] for r in spark.table("once").collect()) == [100, 200]


def test_daily_windows_on_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    counted = stream.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    query = counted.writeStream.format("memory").outputMode("complete").queryName("days").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert spark.table("days").agg(F.sum("n")).first()[0] == events.count()
