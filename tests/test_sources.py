"""Sources and sinks: files for people, label files, batches, and a paged service."""

from __future__ import annotations

import csv
import io
import json

import pytest

from murmurate.functions import terms
from murmurate.sources import files, paged
from tests import recorded


def test_csv_and_json(spark, tmp_path):
    rows = [(1, "plain", 0.5, True), (2, 'a "quoted", cell\nwith lines', None, False), (3, "=SUM(A1)", 1 / 3, None)]
    df = spark.createDataFrame(rows, "id long, text string, share double, flag boolean")
    files.write_table(df, f"file://{tmp_path}", "points", "id")
    raw = (tmp_path / "points.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and b"\r\n" in raw
    got = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline="")))
    assert got == [["id", "text", "share", "flag"], ["1", "plain", "0.5", "true"], ["2", 'a "quoted", cell\nwith lines', "", "false"], ["3", "'=SUM(A1)", "0.333333", ""]]
    assert json.loads((tmp_path / "points.json").read_text())[1] == {"id": 2, "text": 'a "quoted", cell\nwith lines', "share": None, "flag": False}
    files.export({"points": df}, f"file://{tmp_path}/out", "what this is")
    assert (tmp_path / "out" / "README.txt").read_text() == "what this is"
    with pytest.raises(FileExistsError):
        files.export({"points": df}, f"file://{tmp_path}/out", "again")


def test_labels_and_drawn_reviews(spark, tmp_path):
    folder = tmp_path / "claims" / "77" / "second"
    folder.mkdir(parents=True)
    (folder / "labels.json").write_text(json.dumps([{"review_id": "1", "index": 0, "subject": "audio", "also": None}, {"review_id": "1", "index": 1, "subject": "story", "also": [{"subject": "audio", "polarity": "praise"}]}]))
    got = files.labels(spark, f"file://{tmp_path}/claims/*/second/labels.json").orderBy("index").collect()
    assert [(r["set_name"], r["game_folder"], r["also"] is None) for r in got] == [("second", "77", True), ("second", "77", False)]
    (folder / "sample.json").write_text(json.dumps([{"id": "1", "claims": [{"index": 0, "text": "a"}, {"index": 1, "text": "b"}], "asked": [1]}, {"id": "2", "claims": [{"index": 0, "text": "c"}]}]))
    assert sorted((r["id"], r["index"], r["asked"]) for r in files.drawn(spark, f"file://{folder}/sample.json").collect()) == [("1", 0, False), ("1", 1, True), ("2", 0, True)]


def test_announcements(spark, tmp_path):
    day = 86_400
    posts = [("1", "Patch 1.2", 0), ("2", "patch 1.2", 5 * day), ("3", "Patch 1.2", 8 * day), ("4", "Summer sale", 9 * day), ("5", "Patch 1.2", 16 * day)]
    (tmp_path / "a.json").write_text(json.dumps({"asked": 1, "posts": [{"gid": g, "title": t, "posted": p, "patch_notes": False} for g, t, p in posts]}))
    assert sorted(r["gid"] for r in files.announcements(spark, f"file://{tmp_path}/a.json").collect()) == ["1", "3", "5"]


def test_batches_and_appends(spark, tmp_path):
    df = spark.range(7).toDF("k")
    files.write_batches(df, str(tmp_path / "b"), 3, "k")
    assert sorted((r["batch"], r["k"]) for r in spark.read.json(str(tmp_path / "b")).collect()) == [(k // 3, k) for k in range(7)]
    assert files.write_new(df, str(tmp_path / "n"), "k", spark) == 7
    assert files.write_new(spark.range(9).toDF("k"), str(tmp_path / "n"), "k", spark) == 2
    assert files.write_new(df, str(tmp_path / "n"), "k", spark) == 0


def test_paged_service(spark):
    windows = paged.plan(recorded.count, 0, 200 * 3600, target=60)
    assert sum(w.expected for w in windows) == 200 and len(windows) >= 4
    assert all(a.end < b.start for a, b in zip(windows, windows[1:], strict=False))
    df = paged.read(spark, "tests.recorded:fetch", windows)
    assert sorted(int(r["id"]) for r in df.collect()) == list(range(200))
    assert len(list(paged.walk(recorded.fetch, windows[0], "recommendationid", keep_until=3600))) == 2
    assert paged.next_wait(3, 0, None) == 8 and paged.next_wait(20, 0, None) == 300 and paged.next_wait(1, 0, 7.0) == 7 and paged.next_wait(9, 1700, None) is None


def test_terms():
    assert terms.terms("The combat is not very fun, great combat system!") == ["combat", "fun", "great", "great combat", "system", "combat system"]
    assert terms.terms("ᴄᴏᴍʙᴀᴛ 10 x") == ["combat"]
    assert terms.terms("面白い") == ["面白", "白い"]
    assert terms.without_particle("게임에서") == "게임" and terms.without_particle("나는") == "나는"
    assert terms.mentions("Great combat", "combat") and not terms.mentions("combats", "combat")
    found = [("combat", 20, 5.0), ("combat system", 20, 4.9), ("combats", 9, 4.0), ("music", 12, 3.0)]
    assert [t for t, *_ in terms.merged(found)] == ["combat system", "combats", "music"]  # a word is held against whole terms
    assert terms.one_inflected("story", "stories") and terms.one_inflected("boss", "bosses") and not terms.one_inflected("be", "bes")
