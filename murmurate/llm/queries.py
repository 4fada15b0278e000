"""The registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, mixing, nearest, packing, quality_model, quality_rules, revisits, scratch, sharding, simhash, url_filter
from .words import own_name

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query("op1_quality_rules", quality_rules.SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts and the verdict of the rules."""
    return quality_rules.judged(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


@_query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every whole text."""
    docs = _read(spark, sf_dir, "documents")
    learned = language.learned_text(docs, learn=quality_model.learnable(2, 4))
    found = language.identified(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", quality_model.held_out(F.col("doc_id"), 2, 4).alias("held_out"),
                        F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def quality_weights(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None):
    """Weights learned from the labelled documents that are not held out."""
    docs = _read(spark, sf_dir, "documents") if docs is None else docs
    return quality_model.fit(docs, _read(spark, sf_dir, "labels"), learn=quality_model.learnable(1, 3))


@_query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every whole text."""
    docs = _read(spark, sf_dir, "documents")
    found = quality_model.scored(docs.select("doc_id", "text"), quality_weights(spark, sf_dir))
    return found.select("doc_id", quality_model.held_out(F.col("doc_id"), 1, 3).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and near-duplicate component of every whole text."""
    found = simhash.components_of(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@_query("op5_url_filter", url_filter.SQL)
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return url_filter.judged(_read(spark, sf_dir, "pages"), keep=("page_id",)).drop("score")


@_query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of all documents with its place in a sequence of at most 1024 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query("op7_nearest")
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others found for every vector whose id is divisible by 100."""
    return nearest.search(_read(spark, sf_dir, "embeddings"), lambda key: key % 100 == 0)


ARRIVALS = 8


@_query("op8_sharding", "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, lang, source, true AS merged, true AS rows_agree, true AS in_bounds, true AS settled, "
        "(SELECT count(*) FROM documents) AS manifest_rows FROM documents")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, appended in several arrivals and compacted, as the newest manifest gives them back, and whether the manifest keeps its promises.

    merged: whether the row's shard came out of a merge, as all do where the arrivals are far below the target. rows_agree: the shard holds as
    many rows as the manifest says. in_bounds: it has at most three times the target's bytes. settled: no tier has enough shards left to merge.
    """
    store = sharding.ShardStore(spark, scratch.fresh_path(spark, "shards"))
    docs = _read(spark, sf_dir, "documents")
    dealt = own_name(docs.columns, "arrival")
    store.append_each(docs.withColumn(dealt, F.coalesce(F.crc32(F.col("doc_id").cast("string")) % ARRIVALS, F.lit(0))), dealt)
    done = store.compact()
    columns = ["doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "lang", "source"]
    rows = sharding.placed(store, done, columns, docs.schema)
    counted = rows.groupBy("shard_id").agg(F.count(F.lit(1)).alias("held"))
    rows = rows.join(counted, "shard_id")
    return rows.select("doc_id", "text_md5", "lang", "source", (F.col("level") > 0).alias("merged"), (F.col("held") == F.col("shard_rows")).alias("rows_agree"),
                       (F.col("shard_bytes") <= 3 * store.target).alias("in_bounds"), F.lit(not store.merges(done)).alias("settled"), F.lit(sum(s.rows for s in done.shards)).cast("long").alias("manifest_rows"))


@_query("op9_revisits", revisits.SQL)
def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the pages' capture records with the response it repeats and the merged headers."""
    found = revisits.resolve(revisits.records_of_pages(_read(spark, sf_dir, "pages")))
    head = lambda k: F.element_at("headers", k)
    return found.select("record_id", "canonical", "status", "response_id", "response_time", head("etag").alias("etag"),
                        head("content-type").alias("content_type"), head("content-length").alias("content_length"), head("date").alias("date"),
                        F.size(F.coalesce(F.map_keys("headers"), F.array().cast("array<string>"))).alias("n_headers"))


@_query("op10_mixing", mixing.SQL)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what the mix takes of each."""
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
