"""Search in texts, terms, and figures as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurate.functions import formats as fmt
from murmurate.functions import text as tx
from murmurate.functions.stats import log_odds
from murmurate.plans import adapters as A
from murmurate.registry import register
from murmurate.session import table

PHRASE = "general public"
_FOUND = r"""w AS (SELECT doc_id, lang, source, list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: x <> '') AS words FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, lang, source, words, unnest(range(1, len(words))) AS i FROM w),
h AS (SELECT doc_id, lang, source, i, words[i] || ' ' || words[i + 1] AS form FROM i WHERE starts_with(words[i], 'general') AND starts_with(words[i + 1], 'public'))"""


def said(docs: DataFrame, query: str) -> DataFrame:
    """Documents that say a phrase, with every form it is said in."""
    return docs.withColumn("forms", tx.phrase_forms(F.col("text"), query)).where(F.size("forms") > 0)


@register("search_counts", "WITH " + _FOUND + " SELECT lang, count(DISTINCT doc_id) AS documents, count(*) AS hits FROM h GROUP BY lang")
def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that say a phrase and how often, by language."""
    found = said(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), PHRASE)
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("forms")).alias("hits"))


@register("search_sides", "WITH " + _FOUND + """, q AS (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY doc_id)
SELECT source AS subject, count(DISTINCT doc_id) AS documents, count(*) AS hits, count(DISTINCT doc_id) FILTER (quality = 1) AS good, count(DISTINCT doc_id) FILTER (quality = 0) AS poor FROM h LEFT JOIN q USING (doc_id) GROUP BY source""")
def search_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that say a phrase by subject, and how many of either side say it."""
    found = said(A.documents(spark, sf_dir).select("doc_id", "text", "source", "quality"), PHRASE)
    return found.groupBy(F.col("source").alias("subject")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("forms")).alias("hits"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("poor"))


@register("term_sides", r"""
WITH q AS (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY doc_id),
w AS (SELECT DISTINCT doc_id, lang, source, quality, unnest(list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '[0-9]+'))) AS term FROM documents JOIN q USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL)
SELECT source AS subject, lang, term, count(*) FILTER (quality = 1) AS praised, count(*) FILTER (quality = 0) AS criticised FROM w GROUP BY ALL HAVING count(*) >= 3""")
def term_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of either side use each term, by subject and language."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$")))
    d = A.documents(spark, sf_dir).where(F.col("quality").isNotNull() & F.col("text").isNotNull())
    c = d.select(F.col("source").alias("subject"), "lang", "quality", F.explode(words).alias("term")).groupBy("subject", "lang", "term")
    return c.agg(F.count_if(F.col("quality") == 1).alias("praised"), F.count_if(F.col("quality") == 0).alias("criticised"), F.count(F.lit(1)).alias("n")).where("n >= 3").drop("n")


@register("search_forms", "WITH " + _FOUND + " SELECT form, count(*) AS n FROM h GROUP BY form ORDER BY n DESC, form LIMIT 12")
def search_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve commonest forms of a phrase."""
    found = said(table(spark, sf_dir, "documents").select("doc_id", "text"), PHRASE)
    return found.select(F.explode("forms").alias("form")).groupBy("form").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "form").limit(12)


@register("search_page", "WITH " + _FOUND + " SELECT doc_id, count(*) AS hits FROM h GROUP BY doc_id ORDER BY hits DESC, doc_id LIMIT 10 OFFSET 5")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of what was found, most hits first."""
    found = said(table(spark, sf_dir, "documents").select("doc_id", "text"), PHRASE).select("doc_id", F.size("forms").cast("long").alias("hits"))
    return found.orderBy(F.desc("hits"), "doc_id").offset(5).limit(10)


@register("term_counts", r"""
WITH w AS (SELECT DISTINCT doc_id, lang, unnest(list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '[0-9]+'))) AS term FROM documents WHERE text IS NOT NULL),
c AS (SELECT lang, term, count(*) AS documents FROM w GROUP BY ALL)
SELECT lang, term, documents FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY documents DESC, term) <= 25""")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that most documents of each language use, each counted once a document; exact, with no forgetting."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$")))
    c = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("lang", F.explode(words).alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("documents"))
    return c.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("documents"), "term"))).where("place <= 25").drop("place")


@register("distinctive_terms", r"""
WITH d AS (SELECT doc_id, lang, text, source IN ('src0', 'src1', 'src2') AS here FROM documents WHERE text IS NOT NULL),
w AS (SELECT DISTINCT doc_id, lang, here, unnest(list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: length(x) >= 2)) AS term FROM d),
n AS (SELECT lang, count(*) FILTER (here) AS of_here, count(*) FILTER (NOT here) AS of_there FROM d GROUP BY lang),
c AS (SELECT lang, term, count(*) FILTER (here) AS here, count(*) FILTER (NOT here) AS there FROM w GROUP BY ALL),
o AS (SELECT term, here, there, ln((here + 0.5::DOUBLE) / (of_here - here + 0.5::DOUBLE)) - ln((there + 0.5::DOUBLE) / (of_there - there + 0.5::DOUBLE)) AS delta,
             1 / (here + 0.5::DOUBLE) + 1 / (of_here - here + 0.5::DOUBLE) + 1 / (there + 0.5::DOUBLE) + 1 / (of_there - there + 0.5::DOUBLE) AS v FROM c JOIN n USING (lang)),
p AS (SELECT term, sum(here) AS uses, sum(here + there) AS everywhere, sum(delta / v) / sum(1 / v) AS delta, sum(delta / v) / sum(1 / v) * sqrt(sum(1 / v)) AS z FROM o GROUP BY term)
SELECT term, CAST(uses AS BIGINT) AS uses, round(delta, 6) AS delta, round(z, 6) AS z FROM p WHERE uses >= 5 AND delta >= ln(2) AND z >= 2 AND uses >= 0.25::DOUBLE * everywhere""")
def distinctive_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that some sources use clearly more than the rest: log odds pooled over languages by inverse variance."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("lang", "text", F.coalesce(F.col("source").isin("src0", "src1", "src2"), F.lit(False)).alias("here"))
    n = d.groupBy("lang").agg(F.count_if("here").alias("of_here"), F.count_if(~F.col("here")).alias("of_there"))
    terms = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2))
    c = d.select("lang", "here", F.explode(terms).alias("term")).groupBy("lang", "term").agg(F.count_if("here").alias("h"), F.count_if(~F.col("here")).alias("t"))
    delta, v = log_odds(F.col("h"), F.col("of_here"), F.col("t"), F.col("of_there"))
    o = c.join(F.broadcast(n), "lang").select("term", "h", "t", delta.alias("d"), v.alias("v"))
    p = o.groupBy("term").agg(F.sum("h").alias("uses"), F.sum(F.col("h") + F.col("t")).alias("everywhere"), (F.sum(F.col("d") / F.col("v")) / F.sum(1 / F.col("v"))).alias("delta"), F.sum(1 / F.col("v")).alias("precision"))
    p = p.withColumn("z", F.col("delta") * F.sqrt("precision"))
    return p.where((F.col("uses") >= 5) & (F.col("delta") >= F.log(F.lit(2.0))) & (F.col("z") >= 2) & (F.col("uses") >= 0.25 * F.col("everywhere"))).select("term", "uses", F.round("delta", 6).alias("delta"), F.round("z", 6).alias("z"))


@register("readable_quotes", r"""
SELECT doc_id, len(regexp_extract_all(text, '\S+')) >= 3 AND len(regexp_extract_all(text, '\pL')) * 5 >= len(regexp_extract_all(text, '\S')) * 4 AS readable,
       CASE WHEN length(text) <= 240 THEN text ELSE CASE WHEN regexp_extract(substr(text, 1, 240), '(?s)^(.*\S)\s+\S*$', 1) <> '' THEN regexp_extract(substr(text, 1, 240), '(?s)^(.*\S)\s+\S*$', 1) ELSE substr(text, 1, 240) END || '…' END AS quote
FROM documents WHERE text IS NOT NULL""")
def readable_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as quotes: whether they read as words, and cut to 240 characters."""
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", tx.reads_as_words(F.col("text")).alias("readable"), tx.quote_cut(F.col("text")).alias("quote"))


KEYWORDS = (("licence", ("license", "licensed", "creative commons"), ()), ("contact", ("e-mail", "email", "phone"), ("phone-in",)), ("insult", ("idiot", "idiots"), ()))


@register("keyword_subjects", r"""
WITH k AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN regexp_matches(t, '(^|[^0-9a-z_\x{80}-\x{10ffff}])(license|licensed|creative commons)($|[^0-9a-z_\x{80}-\x{10ffff}])') THEN 'licence'
  WHEN regexp_matches(t, '(^|[^0-9a-z_\x{80}-\x{10ffff}])(e-mail|email|phone)($|[^0-9a-z_\x{80}-\x{10ffff}])') AND NOT regexp_matches(t, '(^|[^0-9a-z_\x{80}-\x{10ffff}])phone-in($|[^0-9a-z_\x{80}-\x{10ffff}])') THEN 'contact'
  WHEN regexp_matches(t, '(^|[^0-9a-z_\x{80}-\x{10ffff}])(idiot|idiots)($|[^0-9a-z_\x{80}-\x{10ffff}])') THEN 'insult' END AS subject FROM k""")
def keyword_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first subject whose keywords a text has; the table of keywords is a parameter."""
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", tx.keyword_subject(F.col("text"), KEYWORDS).alias("subject"))


@register("safe_names", r"""
SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
       regexp_replace(regexp_replace(url, '[\\/:*?"<>|\x00-\x1f\x7f-\x9f]', '-', 'g'), '^[ .]+|[ .]+$', '', 'g') AS file FROM pages""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs as they may stand in a page and in a file name."""
    return table(spark, sf_dir, "pages").select("page_id", tx.html_escaped(F.col("url")).alias("escaped"), tx.file_safe(F.col("url")).alias("file"))


@register("figures", A.with_views("reviews", body=r"""
SELECT review, strftime(make_timestamp(created * 1000000), '%Y-%m-%d') AS day, strftime(make_timestamp(created * 1000000), '%b %Y') AS month, strftime(make_timestamp(created * 1000000), '%-d %B %Y') AS long_day,
       regexp_replace(printf('%.6f', helpfulness), '\.?0+$', '') AS cell, CASE WHEN played < 60 THEN played || ' min' ELSE ((played * 10 + 30) // 60) // 10 || '.' || ((played * 10 + 30) // 60) % 10 || ' h' END AS hours,
       CAST(year(make_timestamp(created * 1000000)) * 12 + month(make_timestamp(created * 1000000)) - 1 AS INT) AS month_index FROM reviews"""))
def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and numbers of every review as text."""
    from murmurate.operators.changes import month_index

    r = A.reviews(spark, sf_dir)
    label = A.month_of(F.col("created"))
    return r.select("review", fmt.iso_day(F.col("created")).alias("day"), fmt.month_name(label).alias("month"), fmt.day_text(F.col("created")).alias("long_day"), fmt.decimal_cell(F.col("helpfulness")).alias("cell"),
                    fmt.hours(F.col("played")).alias("hours"), month_index(label).alias("month_index"))


@register("also_codec", A.with_views("claims", body="""
SELECT review, string_agg(also_subject || ':' || also_polarity, ',' ORDER BY also_subject, also_polarity) AS also, count(also_subject) AS n FROM (SELECT DISTINCT review, also_subject, also_polarity FROM claims) GROUP BY review"""))
def also_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects beside the first as one text, as readings keep them."""
    c = A.claims(spark, sf_dir).groupBy("review").agg(F.collect_set(F.when(F.col("also_subject").isNotNull(), F.struct(F.col("also_subject").alias("subject"), F.col("also_polarity").alias("polarity")))).alias("x"))
    return c.select("review", fmt.also_text(F.col("x")).alias("also"), F.size("x").cast("long").alias("n"))


@register("event_json", """
SELECT event_type, count(*) AS n, count(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS numbers, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS BIGINT) AS total FROM events GROUP BY event_type""")
def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in JSON, whether written as numbers or as text."""
    k = fmt.number_or_text(F.col("props"), "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(k).alias("numbers"), F.sum(k).cast("long").alias("total"))


@register("byte_spans", """
WITH s AS (SELECT doc_id, encode(text) AS b, doc_id % 40 AS s, doc_id % 40 + 25 AS e FROM documents WHERE text IS NOT NULL)
SELECT doc_id, s <= octet_length(b) AND e <= octet_length(b) AS in_range, octet_length(b) AS bytes FROM s""")
def byte_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a span of byte offsets lies in a text."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    size = F.octet_length("text").cast("long")
    return d.select("doc_id", (F.col("doc_id") % 40 + 25 <= size).alias("in_range"), size.alias("bytes"))
