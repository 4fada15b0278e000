"""Row-wise rules as queries: updates and reposts, scripts, names and titles, spans, codecs, lookups and versions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurate import reading
from murmurate.functions import formats as fmt
from murmurate.functions import stats
from murmurate.functions import text as tx
from murmurate.functions import writing
from murmurate.operators.changes import before_after
from murmurate.plans import adapters as A
from murmurate.registry import SQL, register
from murmurate.session import table


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up posts: every document is one, its title put together from words by its id."""
    n = F.col("doc_id")
    pick = lambda of, by: F.element_at(F.array(*map(F.lit, of)), (F.floor(n / by) % len(of) + 1).cast("int"))
    title = F.concat_ws(" ", pick(LEADS, 1), pick(TOPICS, len(LEADS)), pick(TAILS, len(LEADS) * len(TOPICS)))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post"), title.alias("title"), (n % 4 == 0).alias("patch_notes"), (n * 43_201).alias("posted"))


LEADS = ("Small", "Summer sale", "Beta", "Hotfix", "Version", "A word on the", "Free weekend", "Big")
TOPICS = ("update", "patch", "1.2.3", "news", "changelog", "$9.99")
TAILS = ("", "is live", "preview", "20% off", "for all")


def _pick_sql(of: tuple[str, ...], by: int) -> str:
    return f"[{', '.join(repr(x) for x in of)}][CAST(doc_id // {by} % {len(of)} + 1 AS INT)]"


_POSTS = f"""posts AS (SELECT doc_id AS post, {_pick_sql(LEADS, 1)} || ' ' || {_pick_sql(TOPICS, len(LEADS))} || ' ' || {_pick_sql(TAILS, len(LEADS) * len(TOPICS))} AS title, doc_id % 4 = 0 AS patch_notes, doc_id * 43201 AS posted FROM documents)"""


def _says_sql(phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(line, ' {p} ')" for p in phrases) + ")"


_JUDGED = f"""{_POSTS},
w AS (SELECT *, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(title), '[^\\pL\\pN]+'), lambda x: x <> ''), ' ') || ' ' AS line,
             len(list_filter(regexp_split_to_array(title, '[^\\pL\\pN.$€£%]+'), lambda x: regexp_matches(regexp_replace(x, '\\.+$', ''), '^[vV]?[0-9]+(\\.[0-9]+)*\\.[0-9]+[a-z]?$'))) > 0 AS versioned FROM posts),
u AS (SELECT post, title, posted, NOT ({_says_sql(tx.NOT_LIVE)} OR {_says_sql(tx.NOT_A_RELEASE)} OR contains(lower(title), '% off')) AND (patch_notes OR {_says_sql(tx.RELEASE)} OR versioned) AS is_update FROM w)"""


@register("update_posts", f"WITH {_JUDGED} SELECT post, title, is_update FROM u")
def update_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which posts are updates that players received, by title and mark."""
    return _titles(spark, sf_dir).select("post", "title", tx.is_update(F.col("title"), F.col("patch_notes")).alias("is_update"))


@register("updates_without_reposts", f"""WITH RECURSIVE {_JUDGED},
r AS (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY posted, post) AS place FROM u WHERE is_update),
k(title, place, last, kept) AS (SELECT lower(title), place, posted, true FROM r WHERE place = 1
  UNION ALL SELECT k.title, r.place, CASE WHEN r.posted - k.last > 604800 THEN r.posted ELSE k.last END, r.posted - k.last > 604800 FROM k JOIN r ON lower(r.title) = k.title AND r.place = k.place + 1)
SELECT r.title, count(*) AS posts, min(posted) AS first_posted, CAST(sum(posted) AS BIGINT) AS posted_sum FROM r JOIN k ON lower(r.title) = k.title AND r.place = k.place WHERE kept GROUP BY r.title""")
def updates_without_reposts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates less reposts within a week of a kept post of the same title."""
    from murmurate.sources.files import without_reposts

    posts = _titles(spark, sf_dir).where(tx.is_update(F.col("title"), F.col("patch_notes"))).select(F.lpad(F.col("post").cast("string"), 12, "0").alias("gid"), "title", "posted")
    return without_reposts(posts).groupBy("title").agg(F.count(F.lit(1)).alias("posts"), F.min("posted").alias("first_posted"), F.sum("posted").alias("posted_sum"))


@register("wrong_scripts", r"""
SELECT doc_id, len(regexp_extract_all(text, '\pL')) AS letters, len(regexp_extract_all(text, '\pL')) >= 4 AND len(regexp_extract_all(text, '\pL')) - len(regexp_extract_all(text, '\p{Latin}')) > len(regexp_extract_all(text, '\p{Latin}')) AS wrong FROM documents WHERE text IS NOT NULL""")
def wrong_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts mostly in another script than their language's."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", F.regexp_count("text", F.lit(r"\p{L}")).alias("letters"), tx.wrong_script(F.col("text"), "Latin").alias("wrong"))


#: Scripts that need their own treatment, by the characters they are written in; fixed values.
SCRIPTS = {"han": (0x3400, 0x4DBF, 0x4E00, 0x9FFF, 0xF900, 0xFAFF), "kana": (0x3040, 0x30FF), "hangul": (0xAC00, 0xD7AF), "thai": (0x0E00, 0x0E7F)}


def script_letters(text: Column, script: str) -> Column:
    """How many characters of a script a text has."""
    ends = SCRIPTS[script]
    return F.regexp_count(text, F.lit("[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(ends[::2], ends[1::2], strict=True)) + "]"))


def _script_sql(script: str) -> str:
    ends = SCRIPTS[script]
    return f"len(regexp_extract_all(line, '[{''.join(f'{chr(92)}x{{{a:x}}}-{chr(92)}x{{{b:x}}}' for a, b in zip(ends[::2], ends[1::2], strict=True))}]'))"


@register("script_letters", f"""WITH t AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN '漢字かな' WHEN 1 THEN '한글 ก' ELSE '' END AS line FROM documents)
SELECT doc_id, {', '.join(f'{_script_sql(s)} AS {s}' for s in SCRIPTS)} FROM t""")
def script_letters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each script; some are put in, as the texts have none."""
    more = F.when(F.col("doc_id") % 4 == 0, "漢字かな").when(F.col("doc_id") % 4 == 1, "한글 ก").otherwise("")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), more).alias("line"))
    return d.select("doc_id", *[script_letters(F.col("line"), s).alias(s) for s in SCRIPTS])


@register("plain_titles", r"""
SELECT doc_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(substr(text, 1, 300), '[\s\p{Z}\x{85}\x0b]+', ' ', 'g'), '[\x00-\x1f\x7f-\x9f]', '', 'g'), ' +', ' ', 'g'), ' '), 1, 200) AS title FROM documents WHERE text IS NOT NULL""")
def plain_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The start of each text as a title of one line."""
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", tx.plain_title(F.substring("text", 1, 300)).alias("title"))


@register("numbers_in_texts", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '([0-9]+(?:[.,][0-9]+)*%?)', 1), ' ') AS numbers FROM documents WHERE text IS NOT NULL")
def numbers_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number a text names."""
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.array_join(tx.numbers_in(F.col("text")), " ").alias("numbers"))


@register("character_pairs", """
WITH c AS (SELECT lang, string_split(regexp_replace(text, '\\s', '', 'g'), '') AS c FROM documents WHERE text IS NOT NULL),
t AS (SELECT lang, unnest(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) AS pair FROM c)
SELECT lang, pair, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= 100""")
def character_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commoner pairs of neighbouring characters by language."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    pairs = d.select("lang", F.explode(tx.bigrams(F.regexp_replace("text", r"\s", ""))).alias("pair"))
    return pairs.groupBy("lang", "pair").agg(F.count(F.lit(1)).alias("n")).where("n >= 100")


@register("byte_slices", """
WITH s AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS size, doc_id % 40 AS a, doc_id % 40 + 25 AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN b <= size AND NOT contains('89AB', substr(h, 2 * a + 1, 1)) AND (b = size OR NOT contains('89AB', substr(h, 2 * b + 1, 1))) THEN substr(h, 2 * a + 1, 2 * (b - a)) END AS slice FROM s""")
def byte_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands between two byte offsets of each text, in hex; null out of range or inside a character."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    start = (F.col("doc_id") % 40).cast("int")
    return d.select("doc_id", F.hex(F.encode(tx.byte_slice(F.col("text"), start, start + 25), "UTF-8")).alias("slice"))


def moved_onto(source: Column, onto: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """A span of bytes of one text as a span of another with as many characters; null if it cuts a character or the sizes differ."""
    place = lambda at: F.octet_length(F.left(onto, F.length(tx.byte_slice(source, F.lit(0), at))))
    fits = (F.length(source) == F.length(onto)) & tx.byte_slice(source, start, end).isNotNull()
    return F.when(fits, place(start)).cast("long"), F.when(fits, place(end)).cast("long")


@register("spans_moved", """
WITH s AS (SELECT doc_id, text, translate(text, 'aeiou', 'áéíóú') AS onto, hex(encode(text)) AS h, octet_length(encode(text)) AS size, doc_id % 40 AS a, doc_id % 40 + 25 AS b FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, b <= size AND NOT contains('89AB', substr(h, 2 * a + 1, 1)) AND (b = size OR NOT contains('89AB', substr(h, 2 * b + 1, 1))) AS fits,
             len(list_filter(range(0, least(a, size)), lambda i: NOT contains('89AB', substr(h, 2 * i + 1, 1)))) AS ca, len(list_filter(range(0, least(b, size)), lambda i: NOT contains('89AB', substr(h, 2 * i + 1, 1)))) AS cb FROM s)
SELECT doc_id, CASE WHEN fits THEN octet_length(encode(substr(onto, 1, ca))) END AS from_byte, CASE WHEN fits THEN octet_length(encode(substr(onto, 1, cb))) END AS to_byte FROM f""")
def spans_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of bytes moved onto a copy of the text in which vowels have accents."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    a = (F.col("doc_id") % 40).cast("int")
    start, end = moved_onto(F.col("text"), F.translate("text", "aeiou", "áéíóú"), a, a + 25)
    return d.select("doc_id", start.alias("from_byte"), end.alias("to_byte"))


def without_own(found: DataFrame, names: DataFrame, by: str, term: str = "term") -> DataFrame:
    """Terms less the words that their subject is called by; names has a row a subject and word."""
    return found.join(names.select(by, F.col("word").alias(term)), [by, term], "left_anti")


@register("terms_without_own_names", """
WITH w AS (SELECT p_brand AS subject, p_partkey AS part, unnest(string_split(p_name, ' ')) AS term FROM part),
n AS (SELECT DISTINCT p_brand AS subject, lower(unnest(regexp_split_to_array(p_type, '[^A-Za-z0-9]+'))) AS word FROM part WHERE p_partkey % 3 = 0 UNION SELECT p_brand, lower(p_brand) FROM part)
SELECT subject, term, count(DISTINCT part) AS uses FROM w WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.subject = w.subject AND n.word = w.term) GROUP BY subject, term""")
def terms_without_own_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of names by subject, without those that the subject itself is called by."""
    p = table(spark, sf_dir, "part")
    words = p.select(F.col("p_brand").alias("subject"), F.col("p_partkey").alias("part"), F.explode(F.split("p_name", " ")).alias("term"))
    named = p.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("subject"), F.explode(F.split(F.lower("p_type"), "[^a-z0-9]+")).alias("word"))
    names = named.union(p.select("p_brand", F.lower("p_brand"))).distinct()
    return without_own(words, names, "subject").groupBy("subject", "term").agg(F.countDistinct("part").alias("uses"))


@register("figures_shown", A.with_views("reviews", body=r"""--and
g AS (SELECT game, language, count(*) AS n, CAST(floor(sum(helpfulness)) AS BIGINT) AS total FROM reviews GROUP BY ALL), s AS (SELECT *, n % 1001 AS k FROM g)
SELECT game, language, format('{:,}', total) AS shown, CASE WHEN k = 0 THEN '0%' WHEN k = 1000 THEN '100%' WHEN k BETWEEN 100 AND 900 THEN (k * 10 + 50) // 100 || '%' WHEN k % 10 = 0 THEN k // 10 || '%' ELSE k // 10 || '.' || k % 10 || '%' END AS share FROM s"""))
def figures_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with separators, and thousandths as people read shares."""
    g = A.reviews(spark, sf_dir).groupBy("game", "language").agg(F.count(F.lit(1)).alias("n"), stats.floor_of_sum(F.col("helpfulness")).alias("total"))
    return g.select("game", "language", fmt.thousands(F.col("total")).alias("shown"), fmt.percent((F.col("n") % 1001) / 1000).alias("share"))


@register("polarity_codes", A.with_views("claims", body="SELECT CASE polarity WHEN 'praise' THEN 0 WHEN 'complaint' THEN 1 ELSE 2 END AS code, polarity AS name, count(*) AS n FROM claims GROUP BY ALL"))
def polarity_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides as codes and back."""
    c = A.claims(spark, sf_dir).groupBy(fmt.polarity_code(F.col("polarity")).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("code", fmt.polarity_name(F.col("code")).alias("name"), "n")


def sheet_hash(rows: list[tuple[str, str]]) -> str:
    """Six bytes of the SHA-256 of a sheet of (id, label), in hex: what labels are made under."""
    return hashlib.sha256("\n".join(f"{i}: {label}" for i, label in rows).encode()).hexdigest()[:12]


def looked_up(df: DataFrame, subject: str, sheet: DataFrame) -> DataFrame:
    """df with the position and label of its subjects on a sheet (id, position, label), null where it has none; a sheet is some dozens of rows."""
    return df.join(F.broadcast(sheet.select(F.col("id").alias(subject), "position", "label")), subject, "left")


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select("p_brand").distinct().where(F.col("p_brand") != "Brand#55")
    return brands.select(F.col("p_brand").alias("id"), (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("p_brand")) - 1).alias("position"), F.lower("p_brand").alias("label"))


_SHEET = "sheet AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS position, lower(id) AS label FROM (SELECT DISTINCT p_brand AS id FROM part WHERE p_brand <> 'Brand#55'))"


@register("subjects_on_the_sheet", A.with_views("claims", body=f"--and\n{_SHEET}\nSELECT subject, position, label, count(*) AS claims FROM claims LEFT JOIN sheet ON subject = id GROUP BY ALL"))
def subjects_on_the_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by subject with its place and label on the sheet."""
    counts = A.claims(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("claims"))
    return looked_up(counts, "subject", _sheet(spark, sf_dir))


@register("sheet_version", f"WITH {_SHEET} SELECT substr(sha256(string_agg(id || ': ' || label, chr(10) ORDER BY position)), 1, 12) AS version, count(*) AS subjects FROM sheet")
def sheet_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of the sheet in hand; a sheet is some dozens of rows."""
    rows = [(r["id"], r["label"]) for r in _sheet(spark, sf_dir).orderBy("position").collect()]
    return spark.createDataFrame([(sheet_hash(rows), len(rows))], "version string, subjects long")


def version_parts(text: Column) -> Column:
    """The numbers of a version such as v1.20.3, comparable; null where it is none."""
    return F.when(text.rlike(r"^v?[0-9]+(\.[0-9]+)*$"), F.transform(F.split(F.regexp_replace(text, "^v", ""), r"\."), lambda x: x.cast("long")))


@register("newer_versions", """
WITH v AS (SELECT p_partkey AS part, p_size // 10 || '.' || p_size % 10 || '.' || p_partkey % 13 AS had, CASE WHEN p_partkey % 7 = 0 THEN 'next' ELSE 'v' || p_partkey % 5 || '.' || p_size % 7 || '.' || p_partkey % 17 END AS offered FROM part)
SELECT part, had, offered, CASE WHEN regexp_matches(offered, '^v?[0-9]+([.][0-9]+)*$') THEN CAST(string_split(ltrim(offered, 'v'), '.') AS BIGINT[]) > CAST(string_split(had, '.') AS BIGINT[]) END AS newer FROM v""")
def newer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an offered version is newer than the one in hand, number by number."""
    s = lambda c: c.cast("string")
    size, key = F.col("p_size"), F.col("p_partkey")
    had = F.concat_ws(".", s(F.floor(size / 10)), s(size % 10), s(key % 13))
    offered = F.when(key % 7 == 0, "next").otherwise(F.concat(F.lit("v"), F.concat_ws(".", s(key % 5), s(size % 7), s(key % 17))))
    v = table(spark, sf_dir, "part").select(key.alias("part"), had.alias("had"), offered.alias("offered"))
    return v.withColumn("newer", version_parts(F.col("offered")) > version_parts(F.col("had")))


#: Why a crawl of a window ended, and what may be said of a game since a look; fixed values.
STOPPED = {"end": "reached the end", "cap": "reached the cap", "short": "came back short", "error": "failed"}


@register("stop_reasons", A.with_views("reviews", body="""
SELECT game, CASE WHEN count(*) % 4 = 0 THEN 'end' WHEN count(*) % 4 = 1 THEN 'cap' WHEN count(*) % 4 = 2 THEN 'short' ELSE 'error' END AS reason,
       CASE WHEN count(*) % 4 = 0 THEN 'reached the end' WHEN count(*) % 4 = 1 THEN 'reached the cap' WHEN count(*) % 4 = 2 THEN 'came back short' ELSE 'failed' END AS said FROM reviews GROUP BY game"""))
def stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of why a window ended, and what is said of them."""
    n = F.count(F.lit(1)) % 4
    codes = list(STOPPED)
    df = A.reviews(spark, sf_dir).groupBy("game").agg(F.element_at(F.array(*map(F.lit, codes)), (n + 1).cast("int")).alias("reason"))
    return df.withColumn("said", F.element_at(F.create_map(*[F.lit(x) for pair in STOPPED.items() for x in pair]), F.col("reason")))


@register("half_widths", A.with_views("scored", body="""--and
c AS (SELECT predicted, count(*) AS n, avg(CAST(correct AS INT)) AS p FROM scored GROUP BY predicted)
SELECT predicted, n, round(1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96::DOUBLE * 1.96::DOUBLE / (4.0::DOUBLE * n * n)) / (1 + 1.96::DOUBLE * 1.96::DOUBLE / n), 9) AS half FROM c"""))
def half_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the interval around each class's accuracy."""
    c = A.scored(spark, sf_dir).groupBy("predicted").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("p"))
    return c.select("predicted", "n", F.round(stats.half_width(F.col("p"), F.col("n")), 9).alias("half"))


@register("nearly_as_many", A.with_views("sides", body="""--and
c AS (SELECT subject, count(*) AS n FROM sides GROUP BY subject)
SELECT a.subject, b.subject AS other FROM c a JOIN c b ON a.subject < b.subject WHERE a.n * 20 >= b.n * 19 AND b.n * 20 >= a.n * 19"""))
def nearly_as_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that nearly as many reviews raise; subjects are some dozens of rows."""
    c = A.sides(A.claims(spark, sf_dir)).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    o = c.select(F.col("subject").alias("other"), F.col("n").alias("theirs"))
    return c.join(F.broadcast(o), F.col("subject") < F.col("other")).where(stats.nearly(F.col("n"), F.col("theirs"))).select("subject", "other")


@register("answers_above_the_line", A.with_views("claims", body="""--and
l AS (SELECT DISTINCT subject, CASE WHEN subject LIKE '%1' THEN 0.5::DOUBLE WHEN subject LIKE '%2' THEN 0.8::DOUBLE END AS line FROM claims WHERE subject IS NOT NULL)
SELECT review, ord, CASE WHEN confidence >= coalesce(line, 'infinity'::DOUBLE) THEN c.subject END AS answer FROM claims c LEFT JOIN l ON c.subject = l.subject"""))
def answers_above_the_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers kept where they reach their subject's line; a subject without one is never answered."""
    c = A.claims(spark, sf_dir).select("review", "ord", "subject", "confidence")
    lines = c.where(F.col("subject").isNotNull()).select(F.col("subject").alias("name")).distinct().withColumn("line", F.when(F.col("name").endswith("1"), 0.5).when(F.col("name").endswith("2"), 0.8))
    return reading.with_lines(c, subject_lines=lines).select("review", "ord", F.col("subject").alias("answer"))


@register("reused_answers", A.with_views("claims", body="""--and
n AS (SELECT review, ord, CAST(review % 7 AS BIGINT) AS key, ord * 10 AS s, ord * 10 + 5 AS e FROM claims), p AS (SELECT review, ord, CASE WHEN review % 5 = 0 THEN key + 1 ELSE key END AS key, s, e FROM n WHERE review % 3 <> 0 OR ord <> 1),
ns AS (SELECT review, key, list_sort(list({'s': s, 'e': e})) AS spans FROM n GROUP BY ALL), ps AS (SELECT review, key, list_sort(list({'s': s, 'e': e})) AS spans FROM p GROUP BY ALL)
SELECT n.review, n.ord, ps.review IS NOT NULL AS held FROM n JOIN ns ON n.review = ns.review LEFT JOIN ps ON ns.review = ps.review AND ns.key = ps.key AND ns.spans = ps.spans"""))
def reused_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which claims keep an earlier answer: those of reviews whose text and whose every span are as they were."""
    c = A.claims(spark, sf_dir).select(F.col("review").alias("recommendationid"), "ord", (F.col("review") % 7).alias("text_key"), (F.col("ord") * 10).alias("start"), (F.col("ord") * 10 + 5).alias("end"), "subject", "confidence", "polarity", F.lit("").alias("also"))
    prior = c.where("recommendationid % 3 <> 0 OR ord <> 1").withColumn("text_key", F.col("text_key") + (F.col("recommendationid") % 5 == 0).cast("int"))
    held, ask = reading.reused(c.select("recommendationid", "ord", "text_key", "start", "end"), prior)
    return held.select(F.col("recommendationid").alias("review"), "ord", F.lit(True).alias("held")).unionByName(ask.select(F.col("recommendationid").alias("review"), "ord", F.lit(False).alias("held")))


@register("reading_times", A.with_views("reviews", body="""--and
t AS (SELECT CASE WHEN deck THEN 'small' ELSE 'standard' END AS size, language, CAST(sum(helpfulness) AS DOUBLE) / 1000 AS seconds, count(*) AS reviews FROM reviews WHERE NOT (deck AND language LIKE '%1') AND NOT language LIKE '%7' GROUP BY ALL),
z AS (SELECT * FROM (VALUES ('small', 1.0::DOUBLE, 0), ('standard', 8.0::DOUBLE, 1)) v(size, cost, place)),
r AS (SELECT size, language, sum(seconds) / sum(reviews) AS rate FROM t WHERE reviews > 0 AND seconds > 0 GROUP BY ALL), u AS (SELECT language, first(rate / cost ORDER BY place) AS unit FROM r JOIN z USING (size) GROUP BY language),
w AS (SELECT size, language, reviews FROM z, (SELECT language, count(*) AS reviews FROM reviews GROUP BY language))
SELECT w.size, w.language, w.reviews, round(coalesce(r.rate, unit * cost) * w.reviews, 6) AS seconds FROM w JOIN z USING (size) LEFT JOIN r ON r.size = w.size AND r.language = w.language LEFT JOIN u ON u.language = w.language"""))
def reading_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About how long each language takes to read with either reader."""
    r = A.reviews(spark, sf_dir).withColumn("size", F.when(F.col("deck"), "small").otherwise("standard"))
    taken = r.where(~(F.col("deck") & F.col("language").endswith("1")) & ~F.col("language").endswith("7")).groupBy("size", "language").agg((F.sum("helpfulness") / 1000).alias("seconds"), F.count(F.lit(1)).alias("reviews"))
    sizes = spark.createDataFrame([("small", 1.0, 0), ("standard", 8.0, 1)], "size string, cost double, place int")
    wanted = r.groupBy("language").agg(F.count(F.lit(1)).alias("reviews")).join(F.broadcast(sizes.select("size"))).select("size", "language", "reviews")
    return writing.reading_seconds(taken, sizes, wanted).withColumn("seconds", F.round("seconds", 6))


@register("kept_clear", f"""WITH b AS ({SQL['before_after']})
SELECT name, subject, greatest(abs(z_praise), abs(z_complaint)) AS clearest, round((praise_before + praise_after + complaint_before + complaint_after) / (of_before + of_after), 9) AS raised FROM b WHERE enough AND (abs(z_praise) >= 1 OR abs(z_complaint) >= 1)""")
def kept_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of an update with a clear change: its greatest size on either side, and how often the subject is raised at all."""
    b = before_after(spark, sf_dir).where("enough AND (abs(z_praise) >= 1 OR abs(z_complaint) >= 1)")
    raised = (F.col("praise_before") + F.col("praise_after") + F.col("complaint_before") + F.col("complaint_after")) / (F.col("of_before") + F.col("of_after"))
    return b.select("name", "subject", F.greatest(F.abs("z_praise"), F.abs("z_complaint")).alias("clearest"), F.round(raised, 9).alias("raised"))


@register("whole_texts", r"SELECT lang, count(*) AS texts, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents WHERE regexp_matches(text, '[^\s\p{Z}\x0b\x{85}]') GROUP BY lang")
def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as one claim each, the shallow depth, by language."""
    from murmurate.functions import splitter

    rows = splitter.exploded(table(spark, sf_dir, "documents"), "text", "doc_id", "lang", deep=False)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.sum("end").alias("bytes"))
