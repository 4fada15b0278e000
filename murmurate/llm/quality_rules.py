"""Quality rules: counts of one document's words and lines, and line frequency across a host's documents.

Lines are normalised and hashed; a line that more than ``max_documents`` distinct documents of one host hold is
taken out of them, and a document that keeps less than ``least_kept`` of its words is rejected as depleted.
Distinct documents are distinct texts: equal texts of a host count once, whatever else they share.

Scale: the text is read once, few rows at a time; its counts and line hashes are written to the shared folder. All else moves rows of
hashes: line counts are summed on the map side, so a line that a third of all documents hold is no hot task, and
only lines above the limit are joined. Both sides of each join are written or scanned, never a bare aggregate, so a
hot line or text can be split. DataFrame functions only.

Defined cases: null text has no words and fails the base rules; a null host is a host of its own; repeated rows
get the same verdict; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches, stored
from .words import GAPS, WORD, ascii_lower, md5_long, own_name, text_or_empty

MAX_DOCUMENTS = 20
LEAST_KEPT = 0.3
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Bits that hold a window's place beside its hash, for texts of fewer and of more words than 2 to the first.
SHORT_BITS, LONG_BITS = 20, 31


def _lowered(text: Column) -> Column:
    """ascii_lower; a text of one byte a letter is lowered whole, where translate makes an object a letter."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(ascii_lower(text))


def normalised_line(line: Column) -> Column:
    """A line in lower case with single spaces and every number as 0."""
    return F.regexp_replace(F.trim(F.regexp_replace(_lowered(line), GAPS, " ")), "[0-9]+", "0")


def normalised_lines(text: Column) -> Column:
    """All lines of a text that hold a word, each as ``normalised_line`` gives it, in passes over the whole text."""
    spaced = F.regexp_replace(_lowered(text), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.array_remove(F.transform(F.split(F.regexp_replace(spaced, "[0-9]+", "0"), "\n"), lambda x: F.trim(x)), "")


def _windows(hashed: Column) -> Column:
    """The hash of every run of three words, from the words' hashes: longs, where slices of words are objects by the thousand."""
    count = F.greatest(F.size(hashed) - 2, F.lit(0))
    return F.transform(F.slice(hashed, 1, count), lambda x, i: F.xxhash64(x, F.get(hashed, i + 1), F.get(hashed, i + 2)))


def _repeated(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words to (hashed_words, n_words), taking the words' hashes away.

    Texts whose windows are all distinct, which are most, end there. In others window hashes are cut short to carry their place in
    the same long, so one primitive sort brings equal windows together; the places found are then held against the whole 64 bits.
    Linear passes and a sort, for any length.
    """
    df = df.withColumn("hashes", _windows(F.col("hashed_words"))).drop("hashed_words")
    n, hashes = F.col("n_words"), F.col("hashes")
    df = df.withColumn("some", F.size(F.array_distinct(hashes)) < F.size(hashes))
    df = df.withColumn("bits", F.when(n < (1 << SHORT_BITS), F.lit(SHORT_BITS)).otherwise(F.lit(LONG_BITS)))
    bits = F.col("bits")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    packed = F.sort_array(F.transform(hashes, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))))
    df = df.withColumn("packed", F.when(F.col("some"), packed).otherwise(F.array().cast("array<bigint>")))
    s = F.col("packed")
    alike = lambda x, y: F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)
    near = F.filter(s, lambda x, k: F.coalesce(alike(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(alike(x, F.get(s, k + 1)), F.lit(False)))
    df = df.withColumn("near", F.transform(near, lambda x: x.bitwiseAND(mask).cast("int")))
    exact = F.sort_array(F.transform(F.col("near"), lambda i: F.struct(F.get(hashes, i).alias("h"), i.alias("i"))))
    df = df.withColumn("exact", exact).drop("hashes", "packed", "near")
    e = F.col("exact")
    places = F.filter(e, lambda x, k: F.coalesce(x["h"] == F.get(e, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(e, k + 1)["h"], F.lit(False)))
    df = df.withColumn("places", F.sort_array(F.transform(places, lambda x: x["i"])))
    p = F.col("places")
    covered = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3)))
    return df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))


def _line_runs(lines: Column) -> Column:
    """Each distinct hash of a sorted array of (h, w) once, with the words of all its lines."""
    starts = F.filter(
        F.transform(lines, lambda x, k: F.struct(x["h"].alias("h"), x["w"].alias("w"), k.alias("k"))),
        lambda y: (y["k"] == 0) | (F.get(lines, y["k"] - 1)["h"] != y["h"]))
    return starts


def _measured(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """One pass over the text: the base counts, and (h, w) of every distinct line."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("")).alias("host"), text_or_empty(F.col(text)).alias("t"))
    t = F.col("t")
    raw = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    df = df.select(
        "doc_id", "host", md5_long(t).alias("text_hash"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        raw.alias("raw"), normalised_lines(t).alias("lines"), F.array_remove(F.split(t, GAPS), "").alias("words"))
    hashed = F.sort_array(F.transform(
        F.col("lines"), lambda x: F.struct(md5_long(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w"))))
    df = df.select(
        "doc_id", "host", "text_hash", F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"), "n_symbols",
        F.size("words").cast("long").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashed_words"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"), hashed.alias("hashed"))
    df = _repeated(df)
    df = df.withColumn("starts", _line_runs(F.col("hashed")))
    s = F.col("starts")
    runs = F.transform(s, lambda x, k: F.struct(
        x["h"].alias("h"), (x["w"] * (F.coalesce(F.get(s, k + 1)["k"], F.size("hashed")) - x["k"])).cast("long").alias("w")))
    return df.select("doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", runs.alias("lines"))


def _stored_measures(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    with small_batches(docs.sparkSession):
        return stored(_measured(docs, doc_id, text, host), "quality-measured")


def frequent_lines(measured: DataFrame, max_documents: int) -> DataFrame:
    """(host, text_hash, removed_words, removed): of each distinct text, the words and hashes of its lines above the limit."""
    held = measured.select("host", "text_hash", F.explode("lines").alias("line")).select("host", "text_hash", F.col("line.h").alias("h"), F.col("line.w").alias("w"))
    held = held.groupBy("host", "text_hash", "h").agg(F.max("w").alias("w"))
    often = held.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_documents).select("host", "h")
    # Written, so that its size is known and a line that many documents hold can be split when it is joined.
    often = stored(often, "lines-often")
    removed = held.join(often, ["host", "h"]).groupBy("host", "text_hash").agg(F.sum("w").alias("removed_words"), F.collect_list("h").alias("removed"))
    return stored(removed, "lines-removed")


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
           max_documents: int = MAX_DOCUMENTS, least_kept: float = LEAST_KEPT) -> DataFrame:
    """Each document's counts, removed_words, base_failed, depleted and kept."""
    measured = _stored_measures(docs, doc_id, text, host)
    removed = frequent_lines(measured, max_documents).drop("removed")
    df = measured.drop("lines").join(removed, ["host", "text_hash"], "left")
    df = df.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed_words") < least_kept * F.col("n_words")
    return df.select("doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words",
                     base_failed.alias("base_failed"), depleted.alias("depleted"), (~base_failed & ~depleted).alias("kept"))


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **named) -> DataFrame:
    """The documents that the rules keep, with the columns of docs."""
    at, hashed = own_name(docs.columns, "rule_id"), own_name(docs.columns, "rule_hash")
    refused = judged(docs, doc_id, text, **named).where("NOT kept").select(
        F.col("doc_id").alias(at), F.col("text_hash").alias(hashed)).distinct()
    same = docs[doc_id].eqNullSafe(F.col(at)) & (md5_long(text_or_empty(docs[text])) == F.col(hashed))
    return docs.join(refused, same, "left_anti")


def cleaned_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                      max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """docs with the lines above the limit taken out of their texts; rows and other columns stay."""
    at, hashed, gone = (own_name(docs.columns, n) for n in ("line_host", "line_text", "line_gone"))
    lines = frequent_lines(_stored_measures(docs, doc_id, text, host), max_documents).select(
        F.col("host").alias(at), F.col("text_hash").alias(hashed), F.col("removed").alias(gone))
    own_host = F.coalesce(F.concat(F.lit("="), docs[host]), F.lit(""))
    joined = docs.join(lines, (own_host == F.col(at)) & (md5_long(text_or_empty(docs[text])) == F.col(hashed)), "left")
    left = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(F.col(gone), md5_long(normalised_line(x))))
    cleaned = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    return joined.withColumn(text, cleaned).select(*docs.columns)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS tri
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM g) WHERE n >= 2),
c AS (SELECT rid, count(*) AS n_repeat_words FROM (SELECT DISTINCT rid, i + o AS p FROM r, (SELECT unnest([0, 1, 2]) AS o)) GROUP BY rid),
b AS (SELECT w.rid, doc_id, host, t, lines, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c ON w.rid = c.rid),
x AS (SELECT rid, host, t, n_words, regexp_replace(trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[0-9]+', '0', 'g') AS norm,
             len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS lw
      FROM (SELECT rid, host, t, n_words, unnest(lines) AS line FROM b)),
h AS (SELECT rid, host, t, n_words, CAST('0x' || substr(md5(norm), 1, 15) AS BIGINT) AS h, sum(lw) AS lw FROM x GROUP BY ALL),
held AS (SELECT host, t, h, max(lw) AS lw, max(n_words) AS n_words FROM h GROUP BY host, t, h),
often AS (SELECT host, h FROM held GROUP BY host, h HAVING count(*) > 20),
rw AS (SELECT held.host, t, sum(lw) AS removed FROM held JOIN often ON held.host = often.host AND held.h = often.h GROUP BY held.host, t),
o AS (SELECT b.*, coalesce(removed, 0) AS removed FROM b LEFT JOIN rw ON b.host = rw.host AND b.t = rw.t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - removed < 0.3::DOUBLE * n_words) AS kept,
       CAST(removed AS BIGINT) AS removed_words
FROM o
"""
