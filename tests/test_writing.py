"""Windows, checks on paragraphs, pages and time estimates."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmurate.functions import writing

REVIEW = "one two three four five six seven eight nine ten"
OFFSETS = [(0, 3), (4, 7), (8, 13), (14, 18), (19, 23), (24, 27), (28, 33), (34, 39), (40, 44), (45, 48)]


@pytest.mark.parametrize(("at", "length", "budget", "want"), [
    (19, 4, 10, "three four five six seven"), (0, 3, 10, "one two three"), (45, 3, 10, "eight nine ten"), (19, 4, 512, REVIEW), (19, 4, 0, "five")])
def test_windows(at, length, budget, want):
    assert writing.window_around(REVIEW, OFFSETS, at, length, budget) == want


def test_windows_mark_the_claim():
    assert writing.window_around(REVIEW, OFFSETS, 19, 4, 10, mark=True) == "three four ** five ** six seven"
    assert writing.window_around("é b", [], 0, 1, 5) == "é b"
    assert writing.window_around("é b", [(0, 1), (1, 4)], 0, 1, 1) == "é b"


@given(st.text(max_size=20), st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=5), st.integers(0, 30), st.integers(0, 30), st.integers(0, 20), st.booleans())
def test_windows_never_fail(review, offsets, at, length, budget, mark):
    assert isinstance(writing.window_around(review, sorted(offsets), at, length, budget, mark), str)


def test_checks():
    assert writing.sentences('It is 4.5 of 5. "Good." Really? Yes (it is.) unfinished') == ["It is 4.5 of 5.", '"Good."', "Really?", "Yes (it is.)"]
    assert writing.numbers("1,840 of 12% and 4.5, 7.") == ["1,840", "12%", "4.5", "7"]
    assert writing.quotations('say "fine" and “odd”') == ["fine", "odd"]
    text = 'Players praise the music. 12% complain. 99 of them left. They say "runs well." They say "never said this."'
    assert writing.checked(text, "12% of 400", ["It runs well on my machine"]) == 'Players praise the music. 12% complain. They say "runs well."'
    assert writing.checked("99 left. Fine.", "none", []) is None
    assert writing.rebuilt("a. b. c.", ["a.", "b."]) == "a. b." and writing.rebuilt("a", ["z"]) is None


def test_on_dataframes(spark):
    df = spark.createDataFrame([("Good. 3 left. Fine.", "3", ["x"]), (None, "3", None)], "p string, t string, q array<string>")
    assert [r[0] for r in df.select(writing.checked_column(F.col("p"), F.col("t"), F.col("q"))).collect()] == ["Good. 3 left. Fine.", None]
    points = spark.createDataFrame([("praise", "Music", 1200), ("praise", "Art", 50), ("complaint", "Bugs", 7)], "side string, label string, reviews long")
    assert {r["side"]: r["told"] for r in writing.brief(points).collect()} == {"praise": "Music (1,200 reviews); Art (50 reviews)", "complaint": "Bugs (7 reviews)"}
    page = writing.page("A & B", {"Points": points})
    assert "<h1>A &amp; B</h1>" in page and page.count("<tr>") == 4
    taken = spark.createDataFrame([("small", "en", 10.0, 100), ("small", "en", 30.0, 100), ("large", "fr", 5.0, 0)], "size string, language string, seconds double, reviews long")
    sizes = spark.createDataFrame([("small", 1.0, 0), ("large", 4.0, 1)], "size string, cost double, place int")
    wanted = spark.createDataFrame([("small", "en", 10), ("large", "en", 10), ("large", "fr", 10)], "size string, language string, reviews long")
    got = {(r["size"], r["language"]): r["seconds"] for r in writing.reading_seconds(taken, sizes, wanted).collect()}
    assert got == {("small", "en"): 2.0, ("large", "en"): 8.0, ("large", "fr"): None}
