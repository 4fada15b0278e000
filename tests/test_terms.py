"""The rules for terms, one by one."""

from __future__ import annotations

from murmurate.functions import terms as t


def test_words_and_pairs():
    assert t.terms("Slow lifts, slow service at 9 am") == ["slow", "lifts", "slow lifts", "service", "slow service"]
    assert t.terms("the half-price offer") == ["half", "price", "half price", "offer", "price offer"]
    assert t.terms("no small cups") == ["small", "no small", "cups", "small cups", "no small cups"]
    assert t.terms("DON’T buy") == t.terms("don't buy") == ["buy", "don't buy"]
    assert t.terms("not too sweet") == ["sweet", "too sweet"]
    assert t.terms("ᴄʜᴇᴀᴘ") == ["cheap"] and t.terms("") == [] and t.terms("7 x 9") == []
    assert t.terms("kein warmes Wasser") == ["warmes", "kein warmes", "wasser", "warmes wasser", "kein warmes wasser"]


def test_scripts_without_spaces():
    assert t.terms("かなだ") == ["かな", "なだ"]
    cut = t.by_dictionary(["房间", "早餐", "干净"])
    assert t.terms("房间不干净", segment=cut) == ["房间", "干净", "不干净"]
    assert t.terms("早餐太早", segment=cut) == ["早餐", "太早"]
    assert t.terms("干净房间", segment=cut) == ["干净", "房间", "干净房间"]
    assert t.terms("雨雪房间", segment=cut) == ["雨雪", "房间"]  # lone characters pair, and do not lead a word
    assert t.terms("房间", segment=None) == ["房间"] and t.terms("有中文", filler=frozenset(["有中"])) == []


def test_korean_endings():
    assert t.terms("방이 깨끗하고 조용했습니다") == t.terms("방이 깨끗하다 조용해요")
    assert t.without_particle("화장실에서는") == "화장실" and t.without_particle("에서는") == "에서" and t.without_particle("는") == "는"


def test_same_word_or_not():
    assert t.one_inflected("waited", "waiting") and t.one_inflected("room", "rooms") and t.one_inflected("berry", "berries")
    assert not t.one_inflected("car", "card") and not t.one_inflected("mode", "mods") and not t.one_inflected("bed", "bed") and not t.one_inflected("as", "ases")
    assert t.alike("price tag", "tag") and t.alike("no small", "no small cups") and not t.alike("full price", "price tag") and t.alike("操作手感", "操作")
    assert t.nearly(95, 100) and t.nearly(100, 95) and not t.nearly(94, 100)
    assert t.own_names("rooms", "Rooms & beds", ["zimmer"]) == {"rooms", "beds", "zimmer"}


def names(found):
    return [(term, n) for term, n, _ in t.merged(found)]


def test_what_is_shown():
    assert names([("full", 40, 9.0), ("full price", 39, 8.0)]) == [("full price", 39)]
    assert names([("full", 40, 9.0), ("full price", 30, 8.0)]) == [("full", 40)]
    assert names([("cups", 40, 9.0), ("no cups", 21, 8.0)]) == [("no cups", 21)] and names([("cups", 40, 9.0), ("no cups", 19, 8.0)]) == [("cups", 40)]
    assert names([("full price", 30, 9.0), ("price tag", 29, 8.0)]) == [("full price", 30), ("price tag", 29)]
    assert names([("waited", 10, 9.0), ("waiting", 30, 8.0)]) == [("waiting", 30)]
    assert names([("にほ", 20, 9.0), ("んご", 20, 8.0), ("ほん", 20, 7.0)]) == [("にほんご", 20)]
    assert names([("small cups", 20, 9.0), ("no small", 20, 8.0), ("no small cups", 20, 7.0)]) == [("no small cups", 20)]
    assert len(t.merged([(f"{a}{b}{a}", 9, 5.0) for a in "bcdfg" for b in "aeiou"])) == 8
    assert t.merged([("alps", 9, 5.0), ("high alps", 9, 5.0)]) == [("high alps", 9, 5.0)]


def test_groups_as_a_whole(spark):
    rows = [(g, f"w{chr(97 + n // 26)}{chr(97 + n % 26)}x", 5 + n % 7, float(n % 50) / 7) for g in ("a", "b", None) for n in range(500)]
    rows += [("a", "late", 40, 99.0), ("a", "late train", 39, 0.5), ("b", "late", 40, 99.0)]
    got = t.merged_terms(spark.createDataFrame(rows, "side string, term string, reviews long, z double"), ["side"]).collect()
    for side in ("a", "b", None):
        want = t.merged([r[1:] for r in rows if r[0] == side])
        assert sorted((r["place"], r["term"], r["reviews"], r["z"]) for r in got if r["side"] == side) == [(k + 1, *w) for k, w in enumerate(want)]
