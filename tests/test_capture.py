"""Captures on files: newest copies against a plain model, reads as of a time, lookups and parsing."""

from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmurate.sources import capture


def one_file(spark, rows, schema, path, tmp):
    part = tmp / "part"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(part))
    path.parent.mkdir(parents=True, exist_ok=True)
    next(part.glob("*.parquet")).rename(path)


SMALL = "recommendationid string, timestamp_updated long, review string"


def small_schema():
    from pyspark.sql import types as T

    return T.StructType([T.StructField("recommendationid", T.StringType()), T.StructField("timestamp_updated", T.LongType()), T.StructField("review", T.StringType())])


def test_scan_names_files_and_sweeps(spark, tmp_path):
    snap = tmp_path / "appid=7" / "snapshot=100"
    one_file(spark, [("1", 5, "a"), ("2", None, "b")], SMALL, snap / "shard-0.parquet", tmp_path)
    one_file(spark, [("2", 3, "c")], SMALL, snap / "sweep-150.parquet", tmp_path)
    one_file(spark, [("9", 3, "no")], SMALL, snap / "readings.parquet", tmp_path)
    found = {(r["recommendationid"], r["sweep"]) for r in capture.scan(spark, str(snap), small_schema()).collect()}
    assert found == {("1", 0), ("2", 0), ("2", 150)}
    kept = capture.newest(capture.scan(spark, str(snap), small_schema()))
    assert sorted((r["recommendationid"], r["review"]) for r in kept.collect()) == [("1", "a"), ("2", "c")]
    assert capture.latest_snapshot(spark, str(tmp_path), 7).endswith("snapshot=100")
    (tmp_path / "appid=7" / "snapshot=200").mkdir()
    assert capture.latest_snapshot(spark, str(tmp_path), 7).endswith("snapshot=100")
    assert capture.latest_snapshot(spark, str(tmp_path), 8) is None


copy = st.tuples(st.sampled_from("abcd"), st.one_of(st.none(), st.integers(0, 4)), st.sampled_from([0, 0, 10, 20, 30]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(copy, max_size=12), st.sampled_from([None, 10, 20, 30]))
def test_newest_against_a_plain_model(spark, copies, as_of):
    rows = [(k, u, s, n) for n, (k, u, s) in enumerate(copies)]
    df = spark.createDataFrame(rows, "recommendationid string, timestamp_updated long, sweep int, n int")
    seen = [r for r in rows if as_of is None or r[2] <= as_of]
    best = {}
    for k, u, s, _ in seen:
        if s:
            best[k] = max(best.get(k, (-1, -1)), (u or 0, s))
    want = sorted(n for k, u, s, n in seen if k not in best or (s and (u or 0, s) == best[k]))
    assert sorted(r["n"] for r in capture.newest(df, as_of=as_of).collect()) == want


def test_counting_rows_and_bodies(spark):
    rows = [("1", "x", None, None), ("2", "  \t", None, True), ("3", None, 4, None), ("4", "", 2, None)]
    df = spark.createDataFrame(rows, "recommendationid string, review string, votes_up long, voted_up boolean")
    for name, kind in (("language", "string"), ("timestamp_created", "long"), ("weighted_vote_score", "double"), ("author_playtime_at_review", "long"), ("primarily_steam_deck", "boolean"),
                       ("written_during_early_access", "boolean"), ("received_for_free", "boolean"), ("author_steamid", "string")):
        df = df.withColumn(name, F.lit(None).cast(kind))
    counted = capture.counting_rows(df).collect()
    assert [r["recommendationid"] for r in counted] == ["1"]
    assert counted[0]["votes_up"] == 0 and counted[0]["helpfulness"] == 0.0 and counted[0]["language"] == "" and counted[0]["played_minutes"] is None
    assert sorted(r["recommendationid"] for r in capture.bodies(df).collect()) == ["1", "2", "4"]


def test_json_rows(spark):
    lines = [json.dumps({"recommendationid": "5", "author": {"steamid": "s", "num_reviews": 2**33, "playtime_forever": 7}, "language": "english", "review": "fine", "voted_up": True, "votes_up": 3, "weighted_vote_score": "0.5", "timestamp_created": 9}),
             json.dumps({"recommendationid": "6", "weighted_vote_score": 0.25, "votes_up": -1, "review": None})]
    df = capture.from_json_lines(spark.createDataFrame([(x,) for x in lines], "value string"), 7)
    assert [f.name for f in df.schema.fields] == [f.name for f in capture.CAPTURE.fields]
    a, b = df.orderBy("recommendationid").collect()
    assert (a["author_num_reviews"], a["author_playtime_forever"], a["weighted_vote_score"], a["voted_up"], a["votes_up"]) == (None, 7, 0.5, True, 3)
    assert (b["weighted_vote_score"], b["votes_up"], b["review"]) == (0.25, None, None)


def test_readings_without_a_column_are_refused(spark, tmp_path):
    spark.createDataFrame([("1", 0)], "recommendationid string, start long").write.parquet(str(tmp_path / "r"))
    with pytest.raises(ValueError, match="stale readings"):
        capture.readings(spark, str(tmp_path / "r"))
