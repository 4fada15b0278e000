"""Packing against the tokenizer itself and a check of every capacity."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from murmurate.llm import packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(packing.public_encoder_files()[0])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Zé\n\t\r\x0b\x1c  'st漢1٣ .,-!\0🙂"), max_size=60))
def test_ids_are_the_tokenizers(text):
    enc = packing.encoder(*packing.public_encoder_files())
    own = Tokenizer.from_file(packing.public_encoder_files()[0]) if not hasattr(test_ids_are_the_tokenizers, "t") else test_ids_are_the_tokenizers.t
    test_ids_are_the_tokenizers.t = own
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_special_strings_are_encoded_as_the_file_says(whole):
    enc = packing.encoder(*packing.public_encoder_files())
    text = "a <|endoftext|> b"
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_cuts():
    assert packing.cuts(5, 8) == [(0, 5)]
    assert packing.cuts(8, 8) == [(0, 8)]
    assert packing.cuts(19, 8) == [(0, 3), (3, 8), (11, 8)]


def check_bins(runs, histogram, capacity, documents, attention):
    bins, seen = defaultdict(list), Counter()
    for length, rank, first, offset, count in runs:
        for i in range(count):
            bins[first + i].append((offset, length))
            seen[length, rank + i] += 1
    assert all(v == 1 for v in seen.values())
    assert Counter(k for k, _ in seen.elements()) == Counter(histogram)
    for held in bins.values():
        held.sort()
        at = 0
        for offset, length in held:
            assert offset == at
            at += length
        assert at <= capacity and len(held) <= documents and sum(n * n for _, n in held) <= attention
    return len(bins)


@pytest.mark.parametrize("score", ["dot", "norm"])
@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 30), max_size=8), st.integers(1, 16), st.integers(256, 300))
def test_plan_keeps_every_capacity(score, histogram, documents, attention):
    runs = packing.plan(histogram, 16, documents, attention, score=score)
    check_bins(runs, histogram, 16, documents, attention)


def test_attention_capacity_binds():
    runs = packing.plan({4: 8}, 16, 16, 32)
    assert check_bins(runs, {4: 8}, 16, 16, 32) == 4


def test_plan_is_near_the_least():
    histogram = {k: 1000 + k for k in range(1, 1025)}
    n = check_bins(packing.plan(histogram), histogram, 1024, 1024, 1024 * 1024)
    least = max(-(-sum(k * v for k, v in histogram.items()) // 1024), sum(v for k, v in histogram.items() if k > 512))
    assert n <= 1.01 * least


def test_piece_that_fits_nowhere():
    with pytest.raises(ValueError, match="fits in no sequence"):
        packing.plan({9: 1}, 8)


def packed(spark, rows, **named):
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string, length string")
    return packing.pack(docs, **named).collect()


def check_rows(rows, texts, whole, capacity):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    for key, text in texts.items():
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        want = [(k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.cuts(len(ids), capacity))]
        assert sorted(pieces[key]) == want
    return len(sequences)


def test_real_documents(spark, whole):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = packing.pack(docs, block_rows=20).collect()
    n = check_rows(rows, texts, whole, 1024)
    assert n <= -(-sum(r["length"] for r in rows) // 1024) * 1.05 + 1


def test_edges(spark, whole):
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (3, "word " * 5000, "x", "y"), (4, "same", "x", "y"), (4, "same", "x", "y"), (None, "lost", "x", "y")]
    got = packed(spark, rows, capacity=64, block_rows=2)
    assert Counter(r["doc_id"] for r in got)[4] == 2
    assert len([r for r in got if r["doc_id"] is None]) == 1
    check_rows([r for r in got if r["doc_id"] != 4 or True], {1: None, 2: "", 3: "word " * 5000}, whole, 64)
    assert packed(spark, []) == []
