"""The splitter on the shapes reviews come in, and its invariants on any text."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from murmurate.functions import splitter


def claims(text):
    return [c for *_, c in splitter.split(text)]


@pytest.mark.parametrize(("text", "n"), [
    ("My kettle boils in two minutes. The handle gets far too hot. Cleaning it is simple enough.", 3), ("Weighs 2.5 kilos with the charger in the box.", 1), ("部屋がとても広いです。しかし駅から遠すぎます。", 2),
    ("The brakes grip well even in the rain. Get one.", 1), ("No. It was not worth what they asked for it.", 1), ("we rode this tram for eleven years and nobody ever fixed the doors on it", 1),
    ("Good\nThe battery lasts a whole weekend\nBad\nThe strap broke within days", 2), ("Hold on... how?! Half of the parts were missing from the parcel.", 2),
    ("Take a spare, e.g. one that fits the older frame, and you will be fine on the road.", 1), ("\t \n\n ", 0), ("", 0), ("- Nobody answers the telephone there\n- Parking costs a fortune", 2),
    ("A word on the delivery:\nThe second parcel came a month after the first.", 1), ("The shop keeps writing \"it is on its way. please be patient.\" and nothing ever comes.", 1),
    ("[b]Lovely[/b] breakfast and [i]terrible[/i] pillows in every single room.", 1), ("[h2]Rooms[/h2]\nThe beds are wide and firm.\n[h2]Noise[/h2]\nLorries pass all night.", 2),
    ("{ Taste }\n☐ Awful\n☑ Sweet\n☐ Plain\n☐ Salty\n{ Price }\n☐ Dear\n☑ Fair\n☐ Cheap\n", 2), ("Would suit:\n☐ Walkers\n☑ Riders\n☑ Drivers\n☑ Sailors\n", 3),
    ("!", 0), (";)", 0), ("------------", 0), ("( ͡• ͜ʖ ͡•)", 0), ("4/7", 1), ("a.m.", 1), ("T/B", 1), ("12", 1), ("山", 1), ("♥♥♥!!", 0), ("That soup was ♥♥♥♥ hot.", 1),
    ("Friendly staff, quiet rooms, fresh bread", 3), ("The garden, sadly, is overgrown.", 1), ("Lovely garden, terrace, pool.", 1), ("The engine, which needed some time to warm, is quiet", 1),
    ("Looking for the key? Under the blue mat.", 1), ("Was the soup warm? No. Would I still go back there? Certainly.", 2), ("Nice walk with the dog. :) When you like hills you will like this one.", 2),
    ("The stairs are steep on the way up,\nand the lift has been out for weeks.\nThe view is lovely though.", 2), ("Having worn the Orig. Boots for some years, the new soles feel thin", 1),
    ("[b][u]What works[/u][/b]:\n[list]\n[*]Every drawer closes without a sound.\n[*]The lamp is bright enough.\n[/list]", 2), ("The main change must be [h1]ALL DOORS OPEN AT ONCE[/h1], well done", 1),
    ("Там тихо и чисто т. е. можно хорошо выспаться", 1), ("В номере есть чайник, фен, утюг и т. д. Завтрак подают рано утром.", 2), ("Есть сад, пруд, баня и т. п. рядом с домом", 1), ("Окна выходят в сад т.е. на юг", 1)])
def test_counts(text, n):
    assert len(claims(text)) == n, claims(text)


def test_texts():
    assert claims("- Nobody answers the telephone there")[0].startswith("Nobody")
    assert claims("[b]Lovely[/b] breakfast and [i]terrible[/i] pillows in every single room.") == ["Lovely breakfast and terrible pillows in every single room."]
    got = claims("Would suit:\n☐ Walkers\n☑ Riders\n☑ Drivers\n☑ Sailors\n")
    assert all("Would suit:" in c for c in got) and "Riders" not in got[2] and not any("Walkers" in c for c in got)
    assert claims("Nice walk with the dog. :) When you like hills you will like this one.")[0] == "Nice walk with the dog. :)"
    assert claims("The labels are full of spelling errors, --\nAll the rest is in order.")[0] == "The labels are full of spelling errors"
    for nothing in ("☐ Good value", "?", "♥♥", "...", "z"):
        assert splitter.is_not_a_claim(nothing)
    for something in ("☑ Good value", "3/4", "山", "The bread is fresh."):
        assert not splitter.is_not_a_claim(something)
    assert splitter.same_words("one ♥♥♥♥♥ shop", "one cheap shop") and not splitter.same_words("one shop", "one shops")


def test_long_texts_take_time_in_proportion():
    import time

    def seconds(n):
        text = "1. The tap drips é. [h2]Bath[/h2] See www.a.test/x.y or т. е. that. " * n
        began = time.perf_counter()
        assert len(splitter.split(text)) >= n
        return time.perf_counter() - began

    seconds(50)
    few = min(seconds(400) for _ in range(3))
    assert min(seconds(3200) for _ in range(2)) < 16 * few


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab A1.!?,:-\n\"()[]/*hx☐☑♥é漢。、" "bi"), max_size=80))
def test_spans_are_sound(text):
    raw = text.encode()
    last = (-1, -1)
    for start, end, claim in splitter.split(text):
        assert 0 <= start < end <= len(raw)
        raw[start:end].decode()
        assert claim and not splitter.says_nothing(claim)
        assert (start, end) > last
        last = (start, end)


def test_column(spark):
    df = spark.createDataFrame([(1, "One point that is long enough. Another point é here now."), (2, None), (3, " ")], "id long, text string")
    rows = splitter.exploded(df, "text", "id").collect()
    assert [(r["id"], r["ord"]) for r in rows] == [(1, 0), (1, 1)]
    assert "Another point é here now.".encode() == rows[1]["claim"].encode()
    assert rows[1]["end"] == len("One point that is long enough. Another point é here now.".encode())
    assert [r["claim"] for r in splitter.exploded(df, "text", "id", deep=False).collect()] == ["One point that is long enough. Another point é here now."]
