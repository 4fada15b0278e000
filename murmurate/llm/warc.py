"""WARC files as capture records. DataFrame functions only; no Python on executors.

A record ends with two empty lines and the next one starts with its version line, so files are read as lines that end
there: plain files are split among tasks wherever a record starts, and compressed ones (a gzip member a record) are
read as one stream. Only the record's header and the header of the HTTP message inside are looked at, so a body's
bytes never have to be text.

Of each record: file, record_id, kind (``response`` for a full HTTP response, ``revisit``), profile, url, time (seconds), digest
of the payload, refers_to, status and headers of the HTTP message; what ``revisits.resolve`` takes.

Defined cases: records of other kinds, and responses that are not HTTP, are left out; a revisit of any profile is a
revisit; a status other than a full 200 makes no response to repeat; missing fields are null; of header lines with one name the last counts; lines without
a colon are ignored; a file without records gives no rows; texts that hold the separator are cut there, and what follows is no
record unless it has a record's header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "\r\n\r\nWARC/1."


def header_map(block: Column) -> Column:
    """The fields of a header block, names in lower case."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value")))
    last = F.filter(pairs, lambda p, k: ~F.exists(F.slice(pairs, k + 2, F.greatest(F.size(pairs), F.lit(1))), lambda o: o["key"] == p["key"]))
    return F.map_from_entries(last)


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """The responses and revisits of WARC files."""
    rows = spark.read.option("lineSep", SEPARATOR).text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    head = F.split("value", "\r\n\r\n", 3)
    rows = rows.select("file", header_map(F.get(head, F.lit(0))).alias("warc"), F.coalesce(F.get(head, F.lit(1)), F.lit("")).alias("http"))
    field = lambda n: F.element_at("warc", n)
    kind = field("warc-type")
    status = F.regexp_extract("http", r"^HTTP/[0-9.]+ ([0-9]{3})", 1).try_cast("int")
    rows = rows.select(
        "file", field("warc-record-id").alias("record_id"), kind.alias("kind"), field("warc-profile").alias("profile"), F.regexp_replace(field("warc-target-uri"), "^<|>$", "").alias("url"),
        F.unix_timestamp(F.try_to_timestamp(field("warc-date"))).alias("time"), field("warc-payload-digest").alias("digest"), field("warc-refers-to").alias("refers_to"),
        status.alias("status"), F.when(F.col("http") != "", header_map(F.col("http"))).alias("headers"))
    return rows.where((F.col("kind") == "revisit") | (F.col("kind") == "response") & (F.col("status") == 200))
