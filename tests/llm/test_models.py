"""Language and quality models: held-out accuracy, methods against plain code, and edges."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

from murmurate.llm import language, quality_model, queries

SF = "/root/testdata/sf0.01"


def longest_match_phrases(text, learned):
    """Cross-parsing by plain search over a string or bytes."""
    n, start = 1, 0
    for at in range(len(text)):
        if text[start : at + 1] not in learned:
            n += 1
            start = at if text[at : at + 1] in learned else at + 1
    return n


LEARNED = (("aa", "the cat sat on the mat and the dog ran"), ("bb", "el gato se sienta en la alfombra y corre"), ("cc", "我们都喜欢这个游戏但是它太短了"))
TEXTS = ("the cat ran", "el gato corre en", "zzz the", "a" * 700, "the dog sat on the cat" * 30, "这个游戏太好了 the 我们喜欢", "喜欢" * 400)


@pytest.mark.parametrize(("cells", "alone"), [(40_000_000, 0), (40_000_000, 64), (1, 0), (1, 64), (1500, 0), (1500, 6)])
def test_phrases_are_longest_matches(monkeypatch, cells, alone):
    monkeypatch.setattr(language, "CELLS", cells)
    monkeypatch.setattr(language, "ALONE", alone)
    monkeypatch.setattr(language, "BLOCK", 16)
    monkeypatch.setattr(language, "TOGETHER", 4)
    model = language.Model(LEARNED)
    assert model.dense < model.width or cells > 1500
    coded = [model.encode(t) for t in TEXTS]
    counts = model.phrases([*coded, coded[0][:0]])
    spell = lambda codes: "".join(map(chr, codes.tolist()))
    for n, c in enumerate(coded):
        for k, (_, body) in enumerate(LEARNED):
            assert counts[n, k] == longest_match_phrases(spell(c), spell(model.encode(body)))
    assert counts[-1].tolist() == [0, 0, 0]


def test_automaton_holds_every_stretch():
    text = [1, 2, 1, 3, 1, 2, 2]
    machine = language.SuffixAutomaton(text)

    def walks(part):
        s = 0
        for c in part:
            if c not in machine.next[s]:
                return False
            s = machine.next[s][c]
        return True

    assert all(walks(text[a:b]) for a in range(7) for b in range(a, 8))
    assert not walks([2, 3]) and not walks([3, 1, 3])


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = queries.QUERIES["op2_language"](spark, SF).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    learned = (("en", "the quick brown fox jumps over the lazy dog and the cat"), ("fr", "le renard brun saute par dessus le chien paresseux et le chat"))
    rows = [(1, None, "a"), (2, "", "a"), (3, "123 !? \n", "a"), (4, "the lazy cat", "a"), (5, "le chat paresseux", "b"), (6, "the dog " * 20000, "b"), (6, "the dog " * 20000, "b"), (7, "漢字", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["found"]["lang"] for r in language.identified(df, learned).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "en", 5: "fr", 6: "en", 7: "en"}
    assert {r["found"]["lang"] for r in language.identified(df, ()).collect()} == {"und"}
    assert language.learned_text(df.limit(0)) == ()
    assert [n for n, _ in language.learned_text(df, learn=lambda key: key > 3)] == ["a", "b", "c"]


def test_every_letter_is_a_symbol():
    """Two texts of the same thousands of letters in another order are told apart, whatever the table holds."""
    letters = [chr(0x4E00 + k) for k in range(3000)]
    rng = np.random.default_rng(1)
    words = [["".join(rng.choice(letters, 3)) for _ in range(2000)] for _ in range(2)]
    learned = tuple((name, "".join(w)) for name, w in zip(("x", "y"), words, strict=True))
    model = language.Model(learned)
    assert model.width > 2900
    texts = [model.encode("".join(rng.choice(words[k % 2], 30))) for k in range(40)]
    assert model.phrases(texts).argmin(axis=1).tolist() == [k % 2 for k in range(40)]


def test_language_query_against_plain_search(spark):
    """Every prediction over sf0.001, by plain search for the longest matches."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learned = language.learned_text(docs, learn=quality_model.learnable(2, 4))
    model = language.Model(())

    def letters(text):
        out = "".join(c if language.is_letter(c) else " " for c in text.lower())
        return re.sub(" +", " ", out).removeprefix(" ")

    bodies = [letters(body) for _, body in learned]
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_language"](spark, sf).collect()}
    for r in docs.collect():
        text = letters(r["text"] or "")
        if not text.strip():
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        rates = [longest_match_phrases(text, body) * np.log2(max(2, len(whole))) / len(text) for body, (_, whole) in zip(bodies, learned, strict=True)]
        assert got[r["doc_id"]]["lang_pred"] == learned[int(np.argmin(rates))][0]
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / np.exp2(-4 * (np.array(rates) - min(rates))).sum())
    assert model.phrases([]).shape == (0, 0)


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.QUERIES["op3_quality_classifier"](spark, sf).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    right = {y: [r["predicted"] == y for r in held if labels[r["doc_id"]] == y] for y in (0, 1)}
    assert np.mean(right[0]) >= 0.9 and np.mean(right[1]) >= 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got[:500])


def test_updates_follow_the_regularised_leader():
    model = quality_model.Ftrl(4, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z, n = np.zeros(5), np.zeros(5)
    rng = np.random.default_rng(0)
    for _ in range(30):
        x = np.append(rng.uniform(size=4), 1.0)
        y = int(rng.integers(0, 2))
        w = np.array([0.0 if abs(z[i]) <= 0.1 else -(z[i] - np.sign(z[i]) * 0.1) / ((1 + np.sqrt(n[i])) / 0.5 + 0.2) for i in range(5)])
        g = (1 / (1 + np.exp(-(w @ x))) - y) * x
        z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / 0.5 * w
        n += g * g
        model.update(np.arange(4), x[:4], y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_quality_query_against_plain_updates(spark):
    """Every score over sf0.001, by plain code for the features, the updates and the dot products."""
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]

    def features(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        out = {}
        for salt, kind in enumerate((words, ["#" + quality_model.shape(w) for w in words])):
            one = [zlib.crc32(w.encode()) + (salt << 33) for w in kind]
            for grams in ([h * quality_model.PRIME for h in one], [(a * quality_model.PRIME % 2**64 ^ b + 2**40) * quality_model.PRIME for a, b in zip(one, one[1:], strict=False)]):
                for g in grams:
                    out[g % 2**64 >> 46] = out.get(g % 2**64 >> 46, 0.0) + 1 / len(grams)
        return {k: float(np.float32(v)) for k, v in sorted(out.items())}

    held = [(str(i), y, features(texts[i])) for i, y in labels]
    crc = [zlib.crc32(np.array(list(x), "<i4").tobytes()) for *_, x in held]
    share = {y: len(held) / (2 * sum(h[1] == y for h in held)) for y in (0, 1)}
    z, n = {}, {}

    def weight(k):
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= quality_model.L1 else -(v - np.sign(v) * quality_model.L1) / ((quality_model.BETA + np.sqrt(n[k])) / quality_model.ALPHA + quality_model.L2)

    for epoch in range(1, quality_model.EPOCHS + 1):
        for k in sorted(range(len(held)), key=lambda k: hashlib.md5(f"{epoch}:{held[k][0]}:{held[k][1]}:{crc[k]}".encode()).hexdigest()):
            _, y, x = held[k]
            x = x | {"bias": 1.0}
            w = {c: weight(c) for c in x}
            slope = (1 / (1 + np.exp(-sum(w[c] * v for c, v in x.items()))) - y) * share[y]
            for c, v in x.items():
                g, had = slope * v, n.get(c, 0.0)
                z[c] = z.get(c, 0.0) + g - (np.sqrt(had + g * g) - np.sqrt(had)) / quality_model.ALPHA * w[c]
                n[c] = had + g * g
    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op3_quality_classifier"](spark, sf).collect()}
    for i, text in texts.items():
        assert got[i] == pytest.approx(1 / (1 + np.exp(-sum(weight(c) * v for c, v in features(text).items()) - weight("bias"))), abs=1e-5)


def test_long_words_have_whole_shapes():
    word = "ab1" * 30 + "!" * 5 + "Z"
    assert quality_model.shape(word) == "a0" * 30 + "!A"
    assert (quality_model.features("x" * 200 + "1")[0] != quality_model.features("x" * 200 + "!")[0]).any()


def test_features_are_shares_of_each_kind():
    at, value = quality_model.features("A b  c\nA b")
    assert len(at) == len(value) == 5 + 4 + 5 + 4
    assert value.sum() == pytest.approx(4.0)
    assert len(quality_model.features(None)[0]) == len(quality_model.features(" \n")[0]) == 0
    assert quality_model.shape("Abc12!!x") == "Aa0!a"


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "fine words here", 9), (3, "fine words here", 9), (4, "w " * 50_000, 9), (None, "x", 9)], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (1, None), (99, 1)], "doc_id long, quality int")
    weights = quality_model.fit(docs, labels)
    rows = quality_model.scored(docs.drop("score"), weights).collect()
    by = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == 6 and by[1] == by[2] and by[3] > by[4]
    none = quality_model.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_model.scored(docs.drop("score"), none).collect()} == {0.5}
    assert quality_model.scored(docs, weights, least=0.0).columns == docs.columns
    one = quality_model.fit(docs, labels.where("quality = 1"))
    assert all(r["score"] > 0.5 for r in quality_model.scored(docs.drop("score"), one).collect())


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(70):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(20)]
        rows += [(100 * k + n, " ".join(rng.choice(words, 60)), f"l{k:02d}") for n in range(3 if k < 66 else 2)]
    rows += [(9000 + n, "never learned", "aa") for n in range(9)]  # marked, but held out
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language.learned_text(docs, learn=lambda key: (key < 9000) & (key % 100 != 0))
    assert [name for name, _ in learned] == [f"l{k:02d}" for k in range(70)]
    found = language.identified(docs.where("doc_id % 100 = 0 AND doc_id < 9000"), learned).collect()
    assert len(found) == 70 and all(r["found"]["lang"] == r["lang"] for r in found)
