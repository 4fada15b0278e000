"""A hand-made capture, read by a table-driven model and asked every question."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from murmurate import reading, registry
from murmurate.corpus import Corpus, search_by_meaning
from murmurate.sources import capture
from tests.oracle import compare, connect

registry.load()

TEXTS = {
    "1": ("english", "The music is superb in every level. The camera is awful in tight rooms."), "2": ("english", "The music is superb in every level. The camera is awful in tight rooms."),
    "3": ("english", "   "), "4": ("french", "The camera is awful in tight rooms."), "5": ("english", "Nothing that the table knows about here."), "6": ("english", None), "7": ("english", "..."),
}
TABLE = {"The music is superb in every level.": ("audio", 0.9, "praise", {"atmosphere": "praise"}), "The camera is awful in tight rooms.": ("controls", 0.8, "complaint", {})}
CALLS = []


def model(texts, languages):
    return [TABLE.get(t, (None, 0.1, "neutral", {})) for t in texts]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("capture")
    snap = root / "appid=7" / "snapshot=100"
    snap.mkdir(parents=True)
    rows = []
    for n, (key, (language, text)) in enumerate(TEXTS.items()):
        row = dict.fromkeys(f.name for f in capture.CAPTURE.fields)
        rows.append(row | {"recommendationid": key, "appid": 7, "language": language, "review": text, "timestamp_created": 1_700_000_000 + n * 86_400, "voted_up": n % 2 == 0, "weighted_vote_score": n / 10,
                           "author_playtime_at_review": None if n == 1 else n * 100, "primarily_steam_deck": n == 0, "raw_json": "{}"})
    spark.createDataFrame(rows, capture.CAPTURE).coalesce(1).write.parquet(str(root / "part"))
    next((root / "part").glob("*.parquet")).rename(snap / "shard-0.parquet")
    bodies = capture.bodies(capture.newest(capture.scan(spark, str(snap))))
    reading.stored_form(reading.read(bodies, model)).write.parquet(str(root / "readings.parquet"))
    return Corpus.from_capture(spark, str(snap), str(root / "readings.parquet"))


def test_totals_and_subjects(corpus):
    t = corpus.totals().first()
    assert (t["reviews"], t["claims"], t["unclassified"], t["silent"], t["claimless"]) == (5, 6, 1, 2, 1)
    got = {r["subject"]: r for r in corpus.subjects().collect()}
    assert {k: (r["mention_reviews"], r["praised"], r["criticised"]) for k, r in got.items()} == {"audio": (2, 2, 0), "atmosphere": (2, 2, 0), "controls": (3, 0, 3)}
    assert got["controls"]["rate"] == pytest.approx(0.6) and got["controls"]["bias"] == pytest.approx(1.0)
    assert corpus.in_language("french").totals().first()["reviews"] == 1
    assert corpus.of_kind("steam-deck").totals().first()["claims"] == 2


def test_pages_and_search(corpus):
    page = corpus.claims_behind("controls", side="complaint", start=1, count=5).collect()
    assert [(r["review"], r["claim"], r["total"]) for r in page] == [("2", TEXTS["4"][1], 3), ("4", TEXTS["4"][1], 3)]
    assert corpus.claims_behind("controls", term="tight room").count() == 3 and corpus.claims_behind("controls", kind="steam-deck").count() == 1
    found = corpus.search("superb in").collect()
    assert [(r["review"], r["subject"], r["forms"]) for r in found] == [("2", "audio", ["superb in"]), ("1", "audio", ["superb in"])]
    assert corpus.shortlist().count() == 7 and corpus.months().count() == 3


def test_pages_follow_numbers(spark):
    ids = ["9", "10", "100", "-3", "b", "98765432109876543210", "2"]
    reviews = spark.createDataFrame([(i, "said the thing", "english", 0.5) for i in ids], "review string, text string, language string, helpfulness double")
    claims = spark.createDataFrame([(i, o, 0, 14, "s", "praise", 0.5, None) for i in ids for o in (1, 0)], "review string, ord int, start long, end long, subject string, polarity string, confidence double, also map<string,string>")
    given, numbered = Corpus(reviews, claims), [-3, 2, 9, 10, 100]
    at = lambda c, start, count: [(r["review"], r["ord"]) for r in c.claims_behind("s", term="the", start=start, count=count).collect()]
    assert at(given, 0, 6) == [("-3", 0), ("-3", 1), ("2", 0), ("2", 1), ("9", 0), ("9", 1)]
    assert at(given, 6, 25) == [("10", 0), ("10", 1), ("100", 0), ("100", 1), (ids[5], 0), (ids[5], 1), ("b", 0), ("b", 1)]
    some = [r.where(F.col("review").rlike("^-?[0-9]{1,3}$")).withColumn("review", F.col("review").cast("long")) for r in (reviews, claims)]
    assert at(Corpus(*some), 0, 25) == [(i, o) for i in numbered for o in (0, 1)]


def test_first_page_as_in_the_sql(spark):
    """A larger table than the other queries are held to: there the ids differ in their number of digits."""
    sf = "/root/testdata/sf0.01"
    compare(spark, connect(sf), sf, registry.QUERIES["corpus_behind_a_term"], registry.SQL["corpus_behind_a_term"])


@pytest.mark.parametrize("more", ["doc_id", "CAST(NULL AS BIGINT)"], ids=["repeated", "without an id"])
def test_first_page_of_odd_ids(spark, tmp_path, more):
    con = duckdb.connect()
    con.sql(f"CREATE TABLE documents AS SELECT * REPLACE ({more} AS doc_id) FROM '/root/testdata/sf0.001/documents.parquet' UNION ALL FROM '/root/testdata/sf0.001/documents.parquet'")
    con.sql(f"COPY documents TO '{tmp_path}/documents.parquet'")
    compare(spark, con, str(tmp_path), registry.QUERIES["corpus_behind_a_term"], registry.SQL["corpus_behind_a_term"])


def test_readings_of_one_span_share_a_place(spark, tmp_path):
    row = dict.fromkeys(f.name for f in capture.CAPTURE.fields) | {"recommendationid": "1", "appid": 7, "review": "said the thing", "raw_json": "{}"}
    spark.createDataFrame([row], capture.CAPTURE).coalesce(1).write.parquet(str(tmp_path / "part"))
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "shard-0.parquet")
    spans = [("1", 0, 8, "s", 0.5, "praise", None, None), ("1", 0, 8, "s", 0.5, "praise", None, None), ("1", 9, 14, "s", 0.5, "praise", None, None)]
    spark.createDataFrame(spans, capture.READINGS).write.parquet(str(tmp_path / "readings"))
    c = Corpus.from_capture(spark, str(tmp_path), str(tmp_path / "readings"))
    assert [(r["ord"], r["claim"], r["total"]) for r in c.claims_behind("s").collect()] == [(0, "said the", 3), (0, "said the", 3), (1, "thing", 3)]
    c.export(f"file://{tmp_path}/out")
    assert len((tmp_path / "out" / "points.csv").read_text().splitlines()) == 4


def test_comparisons(corpus, spark):
    assert {r["subject"]: (r["raised"], r["raised_other"]) for r in corpus.compare("steam-deck").collect()} == {"audio": (1, 1), "atmosphere": (1, 1), "controls": (1, 2)}
    with pytest.raises(ValueError, match="same split"):
        corpus.compare("steam-deck", "got-it-free")
    updates = spark.createDataFrame([("u", 1_700_000_000 + 86_400)], "name string, posted long")
    got = {r["subject"]: (r["praise_before"], r["praise_after"], r["of_before"], r["of_after"]) for r in corpus.around(updates).collect()}
    assert got == {"audio": (1, 1, 1, 4), "atmosphere": (1, 1, 1, 4), "controls": (0, 0, 1, 4)}
    assert corpus.recent_moves("2023-11").count() == 0


def test_export(corpus, tmp_path):
    corpus.export(f"file://{tmp_path}/out")
    assert {p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")} == {"subjects.csv", "subjects.json", "months.csv", "months.json", "points.csv", "points.json", "README.txt"}


def test_answers_are_reused_and_lines_decline(spark):
    df = spark.createDataFrame([(k, lang, t) for k, (lang, t) in TEXTS.items() if t], "recommendationid string, language string, text string")
    first = reading.read(df, model)
    edited = df.withColumn("text", F.when(F.col("recommendationid") == "4", F.concat("text", F.lit(" And the music is superb here."))).otherwise(F.col("text")))

    def other(texts, languages):
        return [("new", 1.0, "neutral", None) for _ in texts]

    again = reading.read(edited, other, prior=first)
    assert {r["recommendationid"] for r in again.where("subject = 'new'").collect()} == {"4"}
    assert again.where("recommendationid <> '4'").count() == first.where("recommendationid <> '4'").count()
    lines = spark.createDataFrame([("audio", 0.95), ("controls", 0.5)], "name string, line double")
    got = {(r["recommendationid"], r["ord"]): r["subject"] for r in reading.read(df, model, subject_lines=lines).collect()}
    assert got["1", 0] is None and got["1", 1] == "controls"
    side = first.select("recommendationid", "ord", reading.polarity_on(F.col("subject"), "atmosphere", F.col("polarity"), F.col("also")).alias("p")).where("recommendationid = '1'").orderBy("ord").collect()
    assert [r["p"] for r in side] == ["praise", None]


def test_search_by_meaning(spark):
    rows = [(n, 0, f"claim {n}", [1.0, n / 10]) for n in range(10)]
    vectors = spark.createDataFrame(rows, "review long, ord int, claim string, vector array<double>")
    near = [r["review"] for r in search_by_meaning(vectors, [1.0, 0.0], most=3).collect()]
    assert near == [0, 1, 2]
    skip = spark.createDataFrame([(0, 0)], "review long, ord int")
    got = search_by_meaning(vectors, [1.0, 0.0], skip, rerank=lambda t: [float(x.split()[1]) / 4 for x in t], most=3).collect()
    assert [(r["review"], r["score"]) for r in got] == [(3, 0.75), (2, 0.5), (1, 0.25)]
