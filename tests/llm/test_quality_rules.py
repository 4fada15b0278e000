"""Quality rules: counts by plain code, line frequency on planted menus and copies, and edges."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from murmurate.llm import quality_rules, scratch

SCHEMA = "doc_id long, text string, source string, kept string, host string"


def plain_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def judged(spark, rows, **named):
    df = spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], SCHEMA)
    return {r["doc_id"]: r for r in quality_rules.judged(df, **named).collect()}


def test_counts(spark):
    texts = [None, "", " \n\t", "a b c", "a b c a b c", "a a a a a a", "x y z w x y z", "é#$ 漢字\n<b>\n<b>\n\n \n", "one\ttwo\x0bthree\x0cfour\rfive", "q " * 3000 + "end of the end of the end", "w1 w2 w3 w4 " * 40,
             " ".join(f"u{i}" for i in range(20_000)) + " u5 u6 u7"]
    got = judged(spark, [(i, t, "h") for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        r = got[i]
        want = plain_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_more_words_than_short_places(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "SHORT_BITS", 3)
    text = "a b c d e f g h i j a b c k l m n"
    assert judged(spark, [(1, text, "h")])[1]["n_repeat_words"] == plain_counts(text)[4]


def letters(k):
    return "".join(chr(97 + int(c)) for c in str(k))


def prose(k, n=60):
    return " ".join(f"w{letters(k)}x{letters(i)}" for i in range(n))


def test_menus_go_and_copies_stay(spark):
    menu = "Home About Contact " + " ".join(f"link{letters(i)}" for i in range(30))
    rows = [(i, f"{prose(i)}\n{menu}", "h") for i in range(40)]  # originals that share a menu
    rows += [(100, f"{menu}\n{menu}\nonly a few words", "h")]  # little else
    rows += [(200 + i, f"{prose(7000)}\n{prose(7001)}", "h") for i in range(60)]  # exact copies are one document
    rows += [(300 + i, f"{prose(8000)}\n{prose(8001)}\nedited {letters(i)}", "h") for i in range(20)]  # as many near copies as the limit
    rows += [(400, f"{menu}\n{menu}\nonly a few words", "other")]  # the menu is rare on another host
    got = judged(spark, rows)
    assert all(got[i]["kept"] and got[i]["removed_words"] == 33 for i in range(40))
    assert got[100]["depleted"] and not got[100]["kept"]
    assert all(got[200 + i]["kept"] for i in range(60)) and all(got[300 + i]["kept"] for i in range(20))
    assert not got[400]["depleted"] and got[400]["removed_words"] == 0


def test_a_host_of_thin_pages_is_depleted(spark):
    menu = "\n".join(" ".join(f"m{letters(k)}x{letters(i)}" for i in range(10)) for k in range(6))
    rows = [(i, f"{menu}\n{prose(i, 15)}", "h") for i in range(200)] + [(1000 + i, f"{menu}\n{prose(5000 + i, 70)}", "h") for i in range(5)]
    rows += [(2000 + i, f"{menu}\n{prose(9000 + i, 15)}", "small") for i in range(20)]  # as many as the limit
    got = judged(spark, rows)
    assert all(got[i]["depleted"] and not got[i]["kept"] and got[i]["removed_words"] == 60 for i in range(200))
    assert all(got[1000 + i]["kept"] and got[1000 + i]["removed_words"] == 60 for i in range(5))
    assert all(got[2000 + i]["kept"] and got[2000 + i]["removed_words"] == 0 for i in range(20))


def test_lines_are_normalised_alike(spark):
    from pyspark.sql import functions as F

    text = " A  b1 2\t\n\n \t \nX\x0b\x0cy 77\r\n12 34\nlast "
    df = spark.createDataFrame([(text,), ("",), ("one",), ("\n a \n",)], "t string")
    one = F.filter(F.transform(F.split("t", "\n"), quality_rules.normalised_line), lambda x: x != "")
    rows = df.select(quality_rules.normalised_lines(F.col("t")).alias("whole"), one.alias("each")).collect()
    assert all(r["whole"] == r["each"] for r in rows) and rows[0]["whole"] == ["a b0 0", "x y 0", "0 0", "last"]


def test_documents_keep_their_columns(spark):
    rows = [(1, prose(1), None), (1, prose(1), None), (2, "few", "h"), (None, prose(3), "h"), (4, None, "h")]
    df = spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], SCHEMA)
    kept = quality_rules.kept_documents(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "None"]
    assert quality_rules.kept_documents(df.limit(0)).count() == 0


def test_lines_are_taken_out(spark):
    df = spark.createDataFrame([(i, f"{prose(i)}\nAll Rights reserved 20{i:02d}\nend {letters(i)}", "h", "x", "y") for i in range(30)], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in quality_rules.cleaned_documents(df).collect()}
    assert got == {i: f"{prose(i)}\nend {letters(i)}" for i in range(30)}


def test_whole_texts_are_read_in_small_batches(spark, tmp_path, monkeypatch):
    before, seen = spark.conf.get(scratch.BATCH_ROWS), {}

    def noted(df, name, stored=scratch.stored):
        seen[name] = int(spark.conf.get(scratch.BATCH_ROWS))
        return stored(df, name)

    monkeypatch.setattr(quality_rules, "stored", noted)
    spark.createDataFrame([(i, prose(i), "h", "x", "y") for i in range(600)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    assert quality_rules.judged(df).where("kept AND n_words = 60").count() == 600
    assert seen["quality-measured"] <= 256 and spark.conf.get(scratch.BATCH_ROWS) == before


def test_only_ascii_letters_are_lowered(spark):
    texts = ["ABC xyz", "ÀB Éc", "İI ıi", "ΑΣ Σ", "漢字 AZ@[`{", "", None, "\U00010400A"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", quality_rules._lowered(F.col("t")).alias("x")).collect()}
    assert got == {i: t and re.sub("[A-Z]", lambda m: m[0].lower(), t) for i, t in enumerate(texts)}
