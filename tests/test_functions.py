"""Scalar functions against known values."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from murmurate.functions import formats as fmt
from murmurate.functions import stats
from murmurate.functions import text as tx
from murmurate.operators import vectors


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column).collect()]


def test_percent(spark):
    shares = [0.0, 1.0, 0.0005, 0.9995, 0.5, 0.125, 0.095, 0.0949, 0.905, 0.9005, 0.1, 0.9, 1e-7, 0.004]
    assert values(spark, fmt.percent(F.col("x")), shares, "x double") == ["0%", "100%", "<0.1%", ">99.9%", "50%", "13%", "9.5%", "9.5%", "90.5%", "90.1%", "10%", "90%", "<0.1%", "0.4%"]


def test_floor_of_sum(spark):
    """Against fractions, in several orders and partitions; sums of doubles are off by one in some."""
    rng = random.Random(7)
    groups = [[round(rng.uniform(900, 500_000), 2) for _ in range(200)] for _ in range(40)]
    groups = [[*g, math.ceil(sum(map(Fraction, g))) - math.fsum(g)] for g in groups]  # near whole sums
    groups += [[0.1] * 10, [0.7, 0.1, 0.2], [1e15, 0.3, -1e15, 0.7], [-1e-20], [1.0, -1e-20], [1.0, -2.0 ** -80, 2.0 ** -80], [1.0, -1e-300], [2.0 ** 53, 1.0, 1.0, -0.5], [-0.5, 0.25], [3.0], [5e-324]]
    want = {k: math.floor(sum(map(Fraction, g))) for k, g in enumerate(groups)}
    rows = [(k, x) for k, g in enumerate(groups) for x in g]
    for parts in (1, 5):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "k long, x double").repartition(parts)
        assert dict(map(tuple, df.groupBy("k").agg(stats.floor_of_sum(F.col("x"))).collect())) == want
    assert values(spark, stats.floor_of_sum(F.col("x")), [(None,), (None,)], "x double") == [None]


def test_figures_shown_as_in_the_sql(spark):
    """A table where the sums of a group are a whole number but for what doubles can't hold."""
    from murmurate import registry
    from tests.oracle import compare, connect

    registry.load()
    sf = "/root/testdata/sf0.01"
    compare(spark, connect(sf), sf, registry.QUERIES["figures_shown"], registry.SQL["figures_shown"])


def test_percent_range(spark):
    rows = [(0.5, 0.4, 0.6), (0.9, 0.899, 0.901), (0.5, 0.4999, 0.5001), (0.5, 0.498, 0.502)]
    got = values(spark, fmt.percent_range(F.col("a"), F.col("b"), F.col("c")), rows, "a double, b double, c double")
    assert got == ["50% [40%, 60%]", "90% [89.9%, 90.1%]", "50%", "50% [49.8%, 50.2%]"]


def test_small_formats(spark):
    assert values(spark, fmt.thousands(F.col("x")), [1234567, 12], "x long") == ["1,234,567", "12"]
    assert values(spark, fmt.decimal_cell(F.col("x")), [0.5, 2.0, 1.2345678], "x double") == ["0.5", "2", "1.234568"]
    assert values(spark, fmt.day_text(F.col("x")), [1700000000, 0], "x long") == ["14 November 2023", "unknown"]
    assert values(spark, fmt.iso_day(F.col("x")), [1700000000, -5], "x long") == ["2023-11-14", None]
    assert values(spark, fmt.month_name(F.col("x")), ["2024-02"]) == ["Feb 2024"]
    assert values(spark, fmt.hours(F.col("x")), [59, 60, 1737, None], "x long") == ["59 min", "1.0 h", "29.0 h", None]
    digest = hashlib.sha256(b"text").digest()
    assert int(values(spark, fmt.text_key(F.col("x")), ["text"])[0]) == int.from_bytes(digest[:8], "little")
    assert values(spark, fmt.also_map(F.col("x")), ["audio:praise,controls:complaint", None, ""]) == [{"audio": "praise", "controls": "complaint"}, {}, {}]


@pytest.mark.parametrize(("title", "notes", "want"), [
    ("Patch 1.2", False, True), ("Hotfix today", False, True), ("v0.221.10", False, True), ("Only $9.99", False, False), ("10.5% more", False, False), ("Beta patch 2.0", False, False),
    ("Summer sale update", False, False), ("State of the Game", True, False), ("A note", True, True), ("50% off patch", True, False), ("Roadmap", False, False), ("Version 01.003.302b", False, True)])
def test_updates(spark, title, notes, want):
    df = spark.createDataFrame([(title, notes)], "t string, n boolean")
    assert df.select(tx.is_update(F.col("t"), F.col("n"))).first()[0] is want


def test_text_functions(spark):
    assert values(spark, tx.phrase_forms(F.col("x"), "steam deck"), ["On Steam Decks, steam deck不能", "deck steam", "steamy deck"]) == [["steam decks", "steam deck"], [], ["steamy deck"]]
    assert values(spark, tx.phrase_forms(F.col("x"), "art run"), ["art runs", "art run"]) == [[], ["art run"]]
    assert values(spark, tx.phrase_forms(F.col("x"), "不 能"), ["我不能玩", "no"]) == [["不能"], []]
    assert values(spark, tx.plain_title(F.col("x")), ["a‮ b\n\n c\x07", "  d  "]) == ["a b c", "d"]
    assert values(spark, tx.file_safe(F.col("x")), ["a/b:c?.", " x "]) == ["a-b-c-", "x"]
    assert values(spark, tx.byte_slice(F.col("x"), F.lit(1), F.lit(3)), ["aéz", "aaé", "a"]) == ["é", None, None]
    assert values(spark, tx.numbers_in(F.col("x")), ["1,200 of 3.5% and 7."]) == [["1,200", "3.5%", "7"]]
    assert values(spark, tx.bigrams(F.col("x")), ["かなだ", "か"]) == [["かな", "なだ"], []]
    assert values(spark, tx.wrong_script(F.col("x"), "Latin"), ["привет", "hello", "hi п"]) == [True, False, False]
    table = (("vr", ("vr", "头显"), ()), ("mods", ("mod", "mods"), ("mod squad",)))
    assert values(spark, tx.keyword_subject(F.col("x"), table), ["a VR game", "modern", "mods!", "mod squad", "的头显很", "évr"]) == ["vr", None, "mods", None, "vr", None]
    assert values(spark, tx.quote_cut(F.col("x"), 10), ["short", "one two three four"]) == ["short", "one two…"]


def test_statistics(spark):
    low, high = stats.wilson(F.col("a"), F.col("b"))
    df = spark.createDataFrame([(8, 10), (0, 10), (0, 0)], "a long, b long")
    got = df.select(F.round(low, 6), F.round(high, 6)).collect()
    assert [tuple(r) for r in got] == [(0.490162, 0.943318), (0.0, 0.277533), (None, None)]
    z = stats.errors_apart(F.lit(10), F.lit(100), F.lit(30), F.lit(100))
    assert abs(df.select(z).first()[0] - 3.5355339) < 1e-6
    assert df.select(stats.errors_apart(F.lit(0), F.lit(0), F.lit(3), F.lit(10))).first()[0] == 0.0
    assert df.select(stats.nearly(F.lit(100), F.lit(105))).first()[0] is True
    scale, cells = stats.quantised(F.col("v"))
    v = spark.createDataFrame([([0.5, -1.0, 0.25],), ([0.0, 0.0],)], "v array<double>")
    assert [(r[0], list(r[1])) for r in v.select(scale, cells).collect()] == [(127.0, [64, -127, 32]), (1.0, [0, 0])]
    p = v.select(stats.softmax(F.col("v"))).first()[0]
    assert abs(sum(p) - 1) < 1e-12


def test_communities_and_diversity(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    base = rng.normal(size=(3, 16))
    points = np.concatenate([b + 0.05 * rng.normal(size=(6, 16)) for b in base])
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    assert sorted(map(sorted, vectors.communities(units))) == [list(range(0, 6)), list(range(6, 12)), list(range(12, 18))]
    assert vectors.communities(units[:2]) == []
    df = spark.createDataFrame([(i, u.tolist()) for i, u in enumerate(units)], "k long, v array<double>")
    picked = [r["k"] // 6 for r in vectors.farthest_first(df, "k", "v", 3).orderBy("place").collect()]
    assert sorted(picked) == [0, 1, 2]
