"""The pipeline stage by stage against plain code, and as a whole."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from murmurate.llm import mixing, quality_model, quality_rules, simhash
from tests.llm.test_simhash import plain_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(n))
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(staged):
    columns = staged[0][1].columns
    assert len(staged) == 5 and all(after.columns == columns for _, _, after in staged[:-1])
    assert all(after.count() for *_, after in staged)


def test_classifier(spark, staged):
    _, docs, after = staged[0]
    weights = quality_model.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), learn=quality_model.learnable(1, 3))
    score = quality_model.scorer(weights.astype("float32").astype(float))
    assert ids(after) == Counter(r["doc_id"] for r in docs.collect() if score(r["text"]) >= 0.5)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = ids(after)
    assert sum(kept[i] == 0 for i, q in quality.items() if q == 1) <= 0.05 * len(quality)


def test_rules(staged):
    _, docs, after = staged[1]
    assert ids(after) == Counter(r["doc_id"] for r in quality_rules.judged(docs).where("kept").collect())


def test_near_dedup(staged):
    _, docs, after = staged[2]
    rows = sorted((r["doc_id"], simhash.fingerprint(r["text"])) for r in docs.collect())
    want = {rows[w][0] for w in plain_components([c for _, c in rows])}
    assert ids(after) == Counter(want)


def test_mixing(staged):
    _, docs, after = staged[3]
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] += r["copies"] if r["taken"] else 0
    assert ids(after) == +want


def test_packing(staged):
    _, docs, after = staged[4]
    held, lengths = defaultdict(list), Counter()
    for r in after.collect():
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        lengths[r["doc_id"]] += r["piece"] == 0
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert lengths == ids(docs)


def test_run_gives_the_last_stage(spark, staged):
    pieces = lambda df: sorted(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert pieces(corpus_pipeline.run(spark, SF)) == pieces(staged[-1][2])
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_and_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, score double"
    rows = [(1, "good words " * 60, "en", "a", 5, None, None), (1, "good words " * 60, "en", "a", 5, None, None), (None, None, None, None, None, None, None), (3, "", None, "b", 0, 1, 0.5),
            (4, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)), "fr", "b", 3, None, None)]
    labels = spark.createDataFrame([(4, 1, 0), (3, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    for name, held in (("empty", []), ("odd", rows)):
        spark.createDataFrame(held, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).collect() == []
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()}
    assert got <= {1, 3, 4} and 4 in got
