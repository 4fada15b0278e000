"""Not-modified revisits of web captures, resolved to the full response they repeat.

A revisit record says that a URL still answered as before. It is joined to the latest earlier full response of the
same canonical URL; its validators must agree with that response (entity tag, modification time, payload digest, as
far as both have them, at least one in common), and then its headers update the stored ones, except those that
describe one connection or one body.

The as-of join: responses of one URL and time are one entry (made on the map side), and so are the questions of all
revisits of one URL and time, so a burst costs one row. Times of one URL are cut into ranges of ``range_span`` units,
which hold at most that many entries; the latest response of each
range is carried to the ranges after it on a small table, and only entries of one range are ordered together. A URL
with a third of all records is thus spread over many tasks. The answers are written, and each revisit fetches its own. Bodies do
not move: ids, validators and headers do, and the payload is fetched by id at the end.

Defined cases: a null or unparsable URL, and a null time, resolve to nothing (``no_url``, ``no_time``); a revisit
with no earlier full response is ``unresolved``; one whose validators disagree or have none in common is
``mismatch``; of responses at the same URL and time the greatest id counts; a response at the revisit's own time is
not earlier; null headers are no headers; repeated rows are resolved alike; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import stored
from .words import ascii_lower

RANGE_SPAN = 20_000
#: Query parameters that name a visit, not a page.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "sessionid")
#: Headers that a 304 answer must not change in the stored response.
FIXED_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
                 "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """A URL in one spelling: no scheme, ``www.``, default port, fragment, tracking parameters or closing slash; host in lower case, parameters sorted."""
    parts = lambda n: F.regexp_extract(F.trim(url), r"^(?i:https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?", n)
    host = F.regexp_replace(F.regexp_replace(ascii_lower(F.regexp_replace(parts(1), r"^[^@]*@", "")), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(parts(2), r"/+$", "")
    query = F.array_sort(F.filter(F.split(parts(3), "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(*TRACKING)))
    joined = F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))
    return F.when(host != "", joined)


def lowered(headers: Column) -> Column:
    """Headers with names in lower case; of names that differ in case the last counts."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(ascii_lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, k: ~F.exists(F.slice(entries, k + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def merged_headers(stored_headers: Column, fresh: Column) -> Column:
    """The stored headers updated by those of a not-modified answer that may change them."""
    allowed = F.map_filter(fresh, lambda k, _: ~k.isin(*FIXED_HEADERS))
    kept = F.map_filter(stored_headers, lambda k, _: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def strong(tag: Column) -> Column:
    """An entity tag without its weak mark, as not-modified answers compare them."""
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def resolve(records: DataFrame, range_span: int = RANGE_SPAN) -> DataFrame:
    """One row a revisit: record_id, canonical, status, response_id, response_time, headers.

    records: record_id, url, time (a whole number), kind (``response`` or ``revisit``), digest, and headers
    (map). headers of the result are the merged ones; null unless resolved.
    """
    name = records.schema["record_id"].dataType
    df = records.select("record_id", canonical_url(F.col("url")).alias("url"), F.col("time").cast("long").alias("time"), "kind", "digest", lowered(F.col("headers")).alias("headers"))
    df = df.where(F.col("kind").isin("response", "revisit"))
    ok = F.col("url").isNotNull() & F.col("time").isNotNull()
    lost = df.where(~ok & (F.col("kind") == "revisit")).select(
        "record_id", F.col("url").alias("canonical"), F.when(F.col("url").isNull(), "no_url").otherwise("no_time").alias("status"),
        F.lit(None).cast(name).alias("response_id"), F.lit(None).cast("long").alias("response_time"), F.lit(None).cast("map<string,string>").alias("headers"))
    df = df.where(ok)

    is_response = F.col("kind") == "response"
    answer = F.struct(F.col("time").alias("time"), F.col("record_id").alias("id"), "digest", "headers")
    # Maps have no order, so what orders goes in beside: the greatest id of those that answered at one time.
    times = df.groupBy("url", "time").agg(F.max_by(F.when(is_response, answer), F.when(is_response, F.struct("record_id"))).alias("answer"),
                                          F.bool_or(~is_response).alias("asked"))
    times = times.withColumn("range", F.floor(F.col("time") / range_span))
    ends = times.groupBy("url", "range").agg(F.max_by("answer", F.when(F.col("answer").isNotNull(), F.col("time"))).alias("end"))
    before = W.partitionBy("url").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(F.col("url").alias("e_url"), F.col("range").alias("e_range"), F.last("end", ignorenulls=True).over(before).alias("carried"))
    within = W.partitionBy("url", "range").orderBy("time").rowsBetween(W.unboundedPreceding, -1)
    times = times.withColumn("latest", F.last("answer", ignorenulls=True).over(within)).where("asked")
    times = times.join(ends, (F.col("url") == F.col("e_url")) & (F.col("range") == F.col("e_range")), "left")
    found = stored(times.select(F.col("url").alias("f_url"), F.col("time").alias("f_time"), F.coalesce("latest", "carried").alias("found")), "revisit-answers")
    df = df.where(~is_response).join(found, (F.col("url") == F.col("f_url")) & (F.col("time") == F.col("f_time")), "left")

    def agree(mine: Column, theirs: Column) -> Column:
        return F.when(mine.isNotNull() & theirs.isNotNull(), mine == theirs)

    get = lambda m, k: F.element_at(m, k)
    checks = F.array(
        agree(strong(get(F.col("headers"), "etag")), strong(get(F.col("found.headers"), "etag"))),
        agree(get(F.col("headers"), "last-modified"), get(F.col("found.headers"), "last-modified")),
        agree(F.col("digest"), F.col("found.digest")))
    held = F.array_compact(checks)
    status = F.when(F.col("found").isNull(), "unresolved").when((F.size(held) > 0) & F.forall(held, lambda c: c), "resolved").otherwise("mismatch")
    df = df.withColumn("status", status)
    done = F.col("status") == "resolved"
    out = df.select("record_id", F.col("url").alias("canonical"), "status", F.when(done, F.col("found.id")).alias("response_id"),
                    F.when(done, F.col("found.time")).alias("response_time"), F.when(done, merged_headers(F.col("found.headers"), F.col("headers"))).alias("headers"))
    return out.unionByName(lost)


def with_payload(resolved: DataFrame, payloads: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """resolved with the payload of the response each row was resolved to."""
    held = payloads.select(F.col(key).alias("payload_of"), F.col(payload).alias("payload"))
    return resolved.join(held, F.col("response_id") == F.col("payload_of"), "left").drop("payload_of")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records for a table of pages, made by rule, as a crawl that returns to each page would leave them.

    A page is a full response at hour page_id, by its own URL, with an entity tag from its body. A second visit, one
    hour to some days on, is a not-modified answer by another spelling of the URL; every fifth has a changed tag,
    every seventh has only its payload digest, every eleventh comes an hour before the response.
    """
    digest = F.md5(F.coalesce("html", F.lit("")))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 12), F.lit('"'))
    hour = F.col("page_id").cast("long") * 3600
    first = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", hour.alias("time"), F.lit("response").alias("kind"), digest.alias("digest"),
        F.create_map(F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), hour.cast("string"), F.lit("Content-Length"), F.length("html").cast("string")).alias("headers"))
    later = F.when(F.col("page_id") % 11 == 0, hour - 3600).otherwise(hour + 3600 * (1 + F.col("page_id") % 97))
    spelled = F.regexp_replace(F.regexp_replace("url", "^http:", "https:"), "#.*$", "")
    other_tag = F.when(F.col("page_id") % 5 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), spelled.alias("url"), later.alias("time"), F.lit("revisit").alias("kind"),
        F.when(F.col("page_id") % 7 == 0, digest).alias("digest"),
        F.when(F.col("page_id") % 7 == 0, F.create_map(F.lit("Date"), later.cast("string"))).otherwise(
            F.create_map(F.lit("etag"), other_tag, F.lit("date"), later.cast("string"), F.lit("Connection"), F.lit("close"), F.lit("content-length"), F.lit("0"))).alias("headers"))
    return first.unionByName(again)


SQL = r"""
WITH p AS (SELECT page_id, url, md5(coalesce(html, '')) AS dg, length(html) AS len FROM pages),
v AS (
  SELECT page_id * 2 AS id, url, page_id * 3600 AS t, true AS full_response, dg, '"' || substr(dg, 1, 12) || '"' AS tag, CAST(len AS VARCHAR) AS clen, CAST(page_id * 3600 AS VARCHAR) AS dt FROM p
  UNION ALL
  SELECT page_id * 2 + 1, regexp_replace(regexp_replace(url, '^http:', 'https:'), '#.*$', ''), CASE WHEN page_id % 11 = 0 THEN page_id * 3600 - 3600 ELSE page_id * 3600 + 3600 * (1 + page_id % 97) END AS t2, false,
         CASE WHEN page_id % 7 = 0 THEN dg END, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '"changed"' ELSE '"' || substr(dg, 1, 12) || '"' END, NULL, CAST(t2 AS VARCHAR) FROM p),
h AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(trim(url), '^(?i:https?)://([^/?#]+)', 1), '^[^@]*@', '')), ':(80|443)$', ''), '^www\.', '') AS host,
             regexp_replace(regexp_extract(trim(url), '^(?i:https?)://[^/?#]+([^?#]*)', 1), '/+$', '') AS path,
             list_sort(list_filter(string_split(regexp_extract(trim(url), '^(?i:https?)://[^/?#]+[^?#]*\?([^#]*)', 1), '&'),
               lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref', 'sessionid'))) AS q FROM v),
c AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical FROM h),
r AS (SELECT canonical, t, id, dg, tag, clen FROM c WHERE full_response AND canonical IS NOT NULL QUALIFY row_number() OVER (PARTITION BY canonical, t ORDER BY id DESC) = 1),
j AS (SELECT a.id, a.canonical, a.dg AS adg, a.tag AS atag, a.dt, r.id AS rid, r.t AS rt, r.dg, r.tag, r.clen
      FROM (SELECT * FROM c WHERE NOT full_response) a ASOF LEFT JOIN r ON a.canonical = r.canonical AND a.t > r.t),
s AS (SELECT *, CASE WHEN canonical IS NULL THEN 'no_url' WHEN rid IS NULL THEN 'unresolved'
             WHEN (atag IS NOT NULL OR adg IS NOT NULL) AND coalesce(atag = tag, true) AND coalesce(adg = dg, true) THEN 'resolved' ELSE 'mismatch' END AS status FROM j)
SELECT id AS record_id, canonical, status, CASE WHEN status = 'resolved' THEN rid END AS response_id, CASE WHEN status = 'resolved' THEN rt END AS response_time,
       CASE WHEN status = 'resolved' THEN CASE WHEN atag IS NULL THEN tag ELSE 'W/' || atag END END AS etag,
       CASE WHEN status = 'resolved' THEN 'text/html' END AS content_type, CASE WHEN status = 'resolved' THEN clen END AS content_length,
       CASE WHEN status = 'resolved' THEN dt END AS date, CASE WHEN status = 'resolved' THEN 4 ELSE 0 END AS n_headers FROM s
"""
