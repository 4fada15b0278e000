"""Files in and out: tables as CSV and JSON for people, labels, kept texts, and label batches."""

from __future__ import annotations

import codecs
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurate.functions.formats import decimal_cell

LABELS = ("review_id string, index int, app_id long, language string, subset string, start long, end long, taxonomy string, produced_by string, subject string, polarity string, "
          "ironic boolean, confidence string, ambiguous boolean, split_wrong boolean, also array<struct<subject:string,polarity:string>>")
SAMPLE = "id string, app_id long, language string, subset string, claims array<struct<index:int,start:long,end:long,text:string>>, asked array<int>"
KEPT = "review_id string, language string, text string"
ANNOUNCEMENTS = "asked long, posts array<struct<gid:string,title:string,posted:long,patch_notes:boolean>>"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def guarded(cell: Column) -> Column:
    """A cell that a spreadsheet won't run as a formula."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def as_text(df: DataFrame) -> DataFrame:
    """Every cell as people read it: decimals to six places, flags as words, text guarded, null empty."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        text = decimal_cell(c) if kind in ("double", "float") else F.when(c, "true").when(~c, "false") if kind == "boolean" else guarded(c) if kind == "string" else c.cast("string")
        out.append(F.coalesce(text, F.lit("")).alias(name))
    return df.select(*out)


def csv_lines(df: DataFrame) -> DataFrame:
    """One column of lines; quotes only where a cell needs them."""
    cells = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        cells.append(F.when(c.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    return df.select(F.concat_ws(",", *cells).alias("line"))


def write_table(df: DataFrame, folder: str, name: str, *order: str) -> None:
    """``name.csv`` (with a byte-order mark, CRLF) and ``name.json`` (an array, a row a line) in a folder.

    Rows are streamed to the files through the driver a partition at a time, as both are one file each for people;
    tables of claims go out as folders of Parquet by ``DataFrame.write`` instead. Files appear whole, by rename.
    """
    spark = df.sparkSession
    df = df.orderBy(*order) if order else df
    heads = ",".join(df.columns)
    csv = (r["line"] for r in csv_lines(as_text(df)).toLocalIterator())
    _write_whole(spark, f"{folder}/{name}.csv", codecs.BOM_UTF8, (f"{x}\r\n" for x in _first(heads, csv)))
    rows = (r["j"] for r in df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator())
    _write_whole(spark, f"{folder}/{name}.json", b"", _array(rows))


def _first(head, rows):
    yield head
    yield from rows


def _array(rows):
    yield "["
    comma = "\n"
    for r in rows:
        yield f"{comma}{r}"
        comma = ",\n"
    yield "\n]\n"


def _write_whole(spark: SparkSession, path: str, start: bytes, parts) -> None:
    """A file that is there whole or not at all."""
    jvm, target, fs = _fs(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}.partial")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(start))
        held, size = [], 0
        for p in parts:
            held.append(p)
            size += len(p)
            if size > 1 << 20:
                out.write(bytearray("".join(held), "utf-8"))
                held, size = [], 0
        out.write(bytearray("".join(held), "utf-8"))
    finally:
        out.close()
    fs.delete(target, False)
    fs.rename(draft, target)


def export(tables: dict[str, DataFrame], folder: str, readme: str) -> None:
    """A dataset in a new folder, which appears whole; an existing one is refused."""
    spark = next(iter(tables.values())).sparkSession
    jvm, target, fs = _fs(spark, folder)
    if fs.exists(target):
        raise FileExistsError(folder)
    draft = f"{target.getParent()}/.{target.getName()}.{uuid.uuid4().hex}.partial"
    for name, df in tables.items():
        write_table(df, draft, name)
    _write_whole(spark, f"{draft}/README.txt", b"", [readme])
    fs.rename(jvm.org.apache.hadoop.fs.Path(draft), target)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files of a glob, with the set and game their folders name."""
    df = spark.read.schema(LABELS).option("multiLine", True).json(path)
    file = F.input_file_name()
    return df.withColumns({"set_name": F.regexp_extract(file, r"/([^/]+)/[^/]+\.json$", 1), "game_folder": F.regexp_extract(file, r"/claims/(\d+)/", 1)})


def drawn(spark: SparkSession, path: str) -> DataFrame:
    """Drawn reviews, a row a claim, with whether it was asked about (all are where none are named)."""
    df = spark.read.schema(SAMPLE).option("multiLine", True).json(path)
    one = df.select("id", "app_id", "language", "subset", "asked", F.explode("claims").alias("c"))
    asked = F.col("asked").isNull() | F.array_contains("asked", F.col("c.index"))
    return one.select("id", "app_id", "language", "subset", "c.index", "c.start", "c.end", "c.text", asked.alias("asked"))


def kept_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KEPT).json(path)


def announcements(spark: SparkSession, path: str) -> DataFrame:
    """Posts that are updates, without reposts within a week of a kept one of the same title."""
    from murmurate.functions.text import is_update

    posts = spark.read.schema(ANNOUNCEMENTS).option("multiLine", True).json(path).select(F.explode("posts").alias("p")).select("p.*")
    return without_reposts(posts.where(is_update(F.col("title"), F.coalesce("patch_notes", F.lit(False)))))


def without_reposts(posts: DataFrame, within: int = 7 * 86_400) -> DataFrame:
    """Greedy: a post goes if its title, letter case aside, is that of an earlier kept one at most ``within`` before."""

    def keep(rows):
        last, out = None, []
        for n, at in enumerate(rows.sort_values(["posted", "gid"])["posted"]):
            if last is None or at - last > within:
                out.append(n)
                last = at
        return rows.sort_values(["posted", "gid"]).iloc[out]

    return posts.groupBy(F.lower("title")).applyInPandas(keep, posts.schema)


def write_batches(df: DataFrame, folder: str, size: int, *order: str) -> None:
    """Rows in batches of a size, a folder a batch."""
    number = F.floor((F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)) - 1) / size)
    df.withColumn("batch", number).write.partitionBy("batch").mode("overwrite").json(folder)


def write_new(df: DataFrame, path: str, key: str, spark: SparkSession) -> int:
    """Appends the rows whose key the table hasn't yet; returns how many. Running it again appends none."""
    jvm, target, fs = _fs(spark, path)
    fresh = df.dropDuplicates([key])
    if fs.exists(target):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n
