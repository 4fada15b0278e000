"""The operators' queries against their SQL."""

from __future__ import annotations

import pytest

from murmurate.llm import queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    compare(spark, connect(SF), SF, queries.QUERIES[name], queries.SQL[name])


EMPTY = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string",
         "embeddings": "vec_id long, embedding array<float>, label int"}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name, schema in EMPTY.items():
        spark.createDataFrame([], schema).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column, repeated rows, and columns with the names of results."""
    folder = tmp_path_factory.mktemp("odd")
    docs = [(1, "some words here", "en", "a", 5), (1, "some words here", "en", "a", 5), (None, None, None, None, None), (2, None, "en", None, 0), (3, "", None, "b", 0), (4, "\n\t", "fr", "b", 3), (5, "l'été est là", "fr", "a", 9)]
    extra = ", score double, host string, size long, component_id long, found string"
    tables = {"documents": (docs, EMPTY["documents"]), "labels": ([(1, 1, 0), (None, 0, None), (5, None, 1), (4, 0, 0), (2, 0, 0)], EMPTY["labels"]),
              "pages": ([(1, "http://x.com/a", "h"), (None, None, None), (1, "http://x.com/a", "h"), (2, "", "")], EMPTY["pages"]), "embeddings": ([(100, [1.0, 0.0], 1), (None, None, None), (2, [0.5, 0.5], None), (100, [1.0, 0.0], 1)], EMPTY["embeddings"])}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], schema + extra).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.mark.parametrize(("name", "rows"), [("op1_quality_rules", 7), ("op2_language", 7), ("op3_quality_classifier", 7), ("op4_simhash", 7), ("op5_url_filter", 4), ("op6_packing", 7), ("op7_nearest", 1), ("op8_sharding", 7),
                                            ("op9_revisits", 4), ("op10_mixing", 7)])
def test_odd_tables(spark, odd, name, rows):
    assert len(queries.QUERIES[name](spark, odd).collect()) == rows
