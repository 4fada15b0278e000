"""SimHash against a plain fingerprint, and its index against all pairs."""

from __future__ import annotations

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from murmurate.llm import simhash
from murmurate.llm.components import components

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    table = {c: c + 32 for c in range(65, 91)}
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(table)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, distance=4):
    codes = np.array(codes, np.uint64)
    label = np.arange(len(codes))
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= distance
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label.tolist()
        label = new


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aBÉ b\n\t\x0b", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    row = spark.sql("SELECT xxhash64('the quick brown é fox jumps over the lazy dog again') h").first()
    assert row["h"] % (1 << 64) == xxhash.xxh64("the quick brown é fox jumps over the lazy dog again".encode(), seed=42).intdigest()


def test_gray_rank_counts_up():
    n = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def family(rng, groups, size, flips):
    out = []
    for _ in range(groups):
        base = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        out.append(base)
        for _ in range(size):
            code = base
            for b in rng.integers(0, 64, int(rng.integers(0, flips + 1))):
                code ^= 1 << int(b)
            out.append(code)
    return sorted(set(out))


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(3)
    for flips, size in ((2, 20), (4, 60), (7, 40)):
        codes = family(rng, 12, size, flips)
        want = plain_components(codes)
        a, b = simhash.forest(np.array(codes, np.uint64), np.zeros(len(codes), int))
        place = {c: k for k, c in enumerate(codes)}
        label = np.arange(len(codes))
        label = simhash.joined(label, np.array([place[int(x)] for x in a], int), np.array([place[int(x)] for x in b], int))
        assert label.tolist() == want


def test_links_across_blocks_and_parts(spark):
    rng = np.random.default_rng(5)
    codes = family(rng, 25, 25, 4) + [0, 15]
    want = plain_components(codes)
    df = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in codes], "fp long")
    for blocks, unit in ((5, 4096), (5, 8), (6, 4096)):
        roots = {r["node"]: r["root"] for r in components(simhash.links(df, len(codes), unit=unit, blocks=blocks)).collect()}
        signed = [int(np.uint64(c).astype(np.int64)) for c in codes]
        got = [roots.get(s, s) for s in signed]
        groups = {}
        for g, w in zip(got, want, strict=True):
            groups.setdefault(w, set()).add(g)
        assert all(len(v) == 1 for v in groups.values()) and len({next(iter(v)) for v in groups.values()}) == len(groups)


def test_real_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in simhash.components_of(docs).collect()}
    ids = sorted(texts)
    codes = [simhash.fingerprint(texts[i]) for i in ids]
    assert [plain_fingerprint(texts[i]) for i in ids[:100]] == codes[:100]
    want = plain_components(codes)
    assert [got[i]["component_id"] for i in ids] == [ids[w] for w in want]
    assert [got[i]["fp"] % (1 << 64) for i in ids] == codes
    assert simhash.deduplicated(docs).count() == len(set(want))


def test_edges(spark):
    rows = [(5, None, 1), (3, "", 1), (9, "one two", 2), (9, "one two", 2), (None, "one two", 3), (7, "w " * 30000, 4), (8, "w " * 30001, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted((r["doc_id"] is None, r["doc_id"], r["fp"], r["component_id"]) for r in simhash.components_of(docs).collect())
    by = {r[1]: r for r in got}
    assert by[5][2] == by[3][2] == 0 and by[5][3] == by[3][3] == 3
    assert by[9][3] == by[None][3] == 9 and by[7][3] == by[8][3] == 7
    assert sorted(str(r["doc_id"]) for r in simhash.deduplicated(docs).collect()) == ["3", "7", "9"]  # repeated rows are copies too
    assert simhash.components_of(docs.limit(0)).collect() == []


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, dedup_id string")
    return sorted((str(r["doc_id"]), r["text"][:3].lower(), r["dedup_id"]) for r in simhash.deduplicated(docs).collect())


def test_documents_without_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in ("axe", "bay", "cod"))
    rows = [(1, a, "x"), (None, a, "y"), (None, b, "z"), (None, c, "u"), (None, c, "u"), (None, "COD" + c[3:], "u")]
    assert kept(spark, rows) == [("1", "axe", "x"), ("None", "bay", "z"), ("None", "cod", "u")]


def test_an_id_with_two_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in ("axe", "bay"))
    assert kept(spark, [(1, a, "x"), (2, a, "y"), (2, b, "z")]) == [("1", "axe", "x"), ("2", "bay", "z")]
    assert len(kept(spark, [(2, a, "y"), (2, a.upper(), "z")])) == 1


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(300)}
