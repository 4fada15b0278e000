"""Prepared data, its states, and the command line."""

from __future__ import annotations

import json
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmurate.__main__ import main
from murmurate.operators.prepared import handed_out, vowels
from murmurate.sources import prepared as P
from murmurate.streaming import control, sweeps

PINS = {"model": "a"}


def claims_of(spark, texts):
    return spark.createDataFrame([(str(n), 0, len(t), t, None, "praise", 0.5) for n, t in enumerate(texts)], "recommendationid string, start long, end long, claim string, subject string, polarity string, confidence double")


def test_preparation_goes_on_where_it_stopped(spark, tmp_path):
    folder = str(tmp_path / "meaning")
    few, many = claims_of(spark, ["one aa", "two ee"]), claims_of(spark, ["one aa", "two ee", "three ii", "three ii"])
    assert P.preparation(many, folder, PINS) == "none"
    assert P.write_claim_vectors(few, folder, vowels, PINS) == 2
    assert P.preparation(many, folder, PINS) == "partial" and P.preparation(many, folder, {"model": "b"}) == "stale"
    assert P.write_claim_vectors(many, folder, vowels, PINS) == 2 and P.write_claim_vectors(many, folder, vowels, PINS) == 0
    assert P.preparation(many, folder, PINS) == "ready"
    rows = {r["recommendationid"]: r for r in P.claim_vectors(spark, folder, PINS).collect()}
    assert rows["2"]["vector"] == rows["3"]["vector"] and max(rows["2"]["vector"]) == 127 and rows["2"]["scale"] == pytest.approx(127 / 2)


def test_texts_reach_the_model_by_length(spark):
    seen = spark.sparkContext.accumulator(0)

    def embed(texts):
        assert texts == sorted(texts, key=len)
        seen.add(len(texts))
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(n, "x" * (n * 7 % 11 + 1)) for n in range(50)], "n int, t string").coalesce(1)
    assert all(r["vector"] == [float(len(r["t"]))] for r in P.embedded(df, "t", embed, batch=8).collect()) and seen.value == 50


def test_pooling():
    hidden, mask = np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]]]), np.array([[1, 1, 0]])
    assert P.pooled(hidden, mask).tolist() == [[0.6, 0.8]] and P.pooled(hidden, mask, first=True).tolist() == [[1.0, 0.0]]


def test_reports_hold_while_their_source_does(spark, tmp_path):
    report, source, schema = str(tmp_path / "r"), tmp_path / "s", "game string"
    source.mkdir()
    (source / "a.bin").write_bytes(b"1")
    df = spark.createDataFrame([("a",)], schema)
    assert P.current_report(spark, report, schema, PINS) is None
    P.write_report(df, report, PINS)
    assert P.current_report(spark, report, schema, PINS, str(source)).collect() == df.collect()
    assert P.current_report(spark, report, schema, {"model": "b"}) is None
    assert P.newer_than(spark, report, str(source)).count() == 0
    time.sleep(1.1)
    (source / "b.bin").write_bytes(b"22")
    assert P.current_report(spark, report, schema, PINS, str(source)) is None
    assert [r["path"][-5:] for r in P.newer_than(spark, report, str(source)).collect()] == ["b.bin"]


def test_storage_totals(spark, tmp_path):
    for game, name, size in ((1, "shard-0.parquet", 5), (1, "shard-1.parquet", 7), (2, "sweep-9.parquet", 3)):
        (tmp_path / f"appid={game}" / "snapshot=1").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"appid={game}" / "snapshot=1" / name).write_bytes(b"x" * size)
    assert sorted(tuple(r) for r in P.storage_totals(spark, str(tmp_path)).collect()) == [("1", "shard", 2, 12), ("2", "sweep", 1, 3)]


def test_folds_that_overlap_are_refused(spark):
    good = spark.createDataFrame([(0, 1, [0.1, 0.9]), (1, 2, [0.7, 0.3])], "fold int, app_id int, logits array<double>")
    assert sorted(r["predicted"] for r in P.pooled_folds(good, 2).collect()) == [0, 1]
    with pytest.raises(ValueError, match="game 1 is in 2 folds"):
        P.pooled_folds(good.union(spark.createDataFrame([(1, 1, [0.5, 0.5])], good.schema)), 2)
    with pytest.raises(ValueError, match="another width"):
        P.pooled_folds(good, 3)


def test_picks_that_are_no_longer_cut_are_dropped(spark):
    cuts = spark.createDataFrame([(1, 0, 0, 8), (1, 1, 10, 18), (2, 0, 0, 5)], "review int, ord int, start int, end int")
    picks = spark.createDataFrame([(1, 4, 18), (1, 0, 8), (2, 6, 9)], "review int, start int, end int")
    assert [(r["review"], r["claims"], r["asked"]) for r in handed_out(picks, cuts).collect()] == [(1, 2, [0, 1])]


def test_training_defaults(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text(json.dumps({"text": "a", "subject": "x"}) + "\n" + json.dumps({"text": "b", "polarity": "praise", "ironic": True}) + "\n")
    a, b = P.training_rows(spark, str(tmp_path)).orderBy("text").collect()
    assert (a["polarity"], a["confidence"], a["subset"], a["ironic"], a["subject"]) == ("neutral", "medium", "stratified", False, "x") and (b["polarity"], b["ironic"]) == ("praise", True)


def test_due_and_progress(spark, tmp_path):
    asked = spark.createDataFrame([("a", 1_000_000), ("b", None), ("c", 1_000_000 + 86_000)], "game string, asked long")
    assert [r["game"] for r in control.due(asked, 1_000_000 + 86_400).collect()] == ["b", "a"]
    assert [r["game"] for r in control.due(asked, 1_000_000 + 86_400, "weekly").collect()] == ["b"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"id": 1, "updated": 5, "text": "x"}))
    watch = control.Progress()
    spark.streams.addListener(watch)
    query = sweeps.sweep_into(sweeps.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    assert control.run_until(query, threading.Event())
    for _ in range(50):
        if watch.seen(query.id).get("done"):
            break
        time.sleep(0.1)
    assert watch.seen(query.id)["rows"] == 1
    spark.streams.removeListener(watch)
    endless = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "e")).start()
    stop = threading.Event()
    stop.set()
    assert not control.run_until(endless, stop, 0.2) and not endless.isActive


def test_command_line(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "mention_rate" in capsys.readouterr().out
    assert main(["sql", "corpus_totals"]) == 0 and "SELECT" in capsys.readouterr().out
    assert main(["run", "corpus_totals", "/root/testdata/sf0.001", "--to", str(tmp_path / "o")], spark) == 0 and spark.read.parquet(str(tmp_path / "o")).count() == 1
    for name, rows in (("old", [(1, "a"), (2, "b")]), ("new", [(2, "c"), (3, "d")])):
        spark.createDataFrame(rows, "id long, label string").write.json(str(tmp_path / name))
    assert main(["ingest", str(tmp_path / "old"), str(tmp_path / "new"), str(tmp_path / "both"), "--key", "id"], spark) == 0
    assert sorted((r["id"], r["label"]) for r in spark.read.json(str(tmp_path / "both")).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"id": 1, "updated": 5, "text": "x"}))
    assert main(["sweep", str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")], spark) == 0 and sweeps.current(spark, str(tmp_path / "t")).select(F.col("text")).first()[0] == "x"


def test_tfidf_baseline(spark):
    from murmurate.operators.keeping import rest_for, tfidf_baseline

    words = {"a": "warm bread and fresh soup", "b": "loud engine on a cold road", "c": "a long film with sad songs"}
    rows = [(n, f"{words[k]} {n}", k) for n in range(60) for k in "abc"]
    df = spark.createDataFrame(rows, "n int, text string, label string")
    got = tfidf_baseline(df.where("n < 40"), df.where("n >= 40"), "text", "label", features=1 << 10).collect()
    assert len(got) == 60 and all(r["guess"] == r["label"] and r["confidence"] > 0.5 for r in got)
    assert rest_for(6.0, 0.75) == pytest.approx(2.0) and rest_for(3.0, 1.0) == 0.0
