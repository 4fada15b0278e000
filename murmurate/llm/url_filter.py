"""URL filters: host and path rules, and for other URLs a logistic regression on hashed character n-grams.

The model learns from a small labelled table of URLs. It is trained by DataFrame functions alone: the n-grams of
the table's URLs are hashed, a join gives the products of all pairs of its rows, and gradient descent with weight
decay runs on one coefficient a row, which is the same as on the weights, in one fold over the steps. The weights,
at most ``BUCKETS`` numbers, then stand as a literal in the scoring expression.

Scale: judging a URL is a projection of its own row; no shuffle, no Python. The labelled table and the rules are
parameters of bounded size (``MOST_LABELLED`` rows; more are refused) and do not grow with the pages.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule, and gets the model's
verdict on the empty text; repeated rows get the same verdict; an empty table gives an empty result; without
labelled URLs the model allows all; labelled rows without a URL or with another label than 0 and 1 teach nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .words import ascii_lower

#: (verdict, host, path), fixed values.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Names that sites of either kind take, made up for the labelled table; label 1 is for block.
NAMES = {
    1: ("casino-club", "royal-casino", "slots-win", "poker-win", "bets-now", "live-bets", "free-spins", "free-cash", "cheap-watches", "cheap-meds", "buy-pills", "pills-shop", "adult-cams",
        "adult-chat", "x-tube", "xxx-x", "spam-net", "link-farm", "seo-farm", "ads-click", "ads-server", "click-track", "track-pixel", "win-prize", "crack-free", "loan-cash", "spam-mail", "content-farm", "x-adult"),
    0: ("gardens", "museum", "library", "townhall", "weather", "physics", "recipes", "history", "rivers", "schools", "theatre", "station", "tionen", "therin", "thaner", "ering", "ontion",
        "readon", "thhes", "nesting", "lighthouse", "stone-age", "north-sea", "old-town", "open-source", "city-news",
        "thather", "another", "hinter", "thister", "thatten", "erthat", "thintor", "restand", "edthen", "athere", "inthere", "ationer", "thething", "landing", "thingen", "waters",
        "theand", "thisto", "hathat", "tiontor", "bleand", "shorten", "reston", "thereth", "anthat", "thtall"),
}


def shaped(names: dict[int, tuple[str, ...]]) -> tuple[tuple[str, int], ...]:
    """A URL for every name in the shapes that pages have: scheme, a label before the host or none, ending, language, number and tail, each in turn.

    The names of each label go through the same shapes, so that only names tell labels apart.
    """
    turn = lambda k, *of: of[k % len(of)]
    return tuple(
        (f"{turn(k, 'https', 'http', 'https')}://{turn(k, '', 'www.', 'blog.', 'm.')}{name}.example.{turn(k + k // 4, 'com', 'org', 'net')}/{turn(k + k // 3, 'en', 'de', 'fr', 'es')}/"
         f"{(k * 7919 + 13) % 9973}{turn(k, '', '/', '.html', '?page=2&ref=x', '#top')}", label)
        for label in (1, 0) for k, name in enumerate(names[label]))


LABELLED = shaped(NAMES)
MOST_LABELLED = 5000

BUCKETS = 4096
SIZES = (3, 4)
STEPS = 400
RATE, DECAY = 4.0, 0.001
LEAST = 0.5


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as (rule, verdict), null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, r_host, r_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == r_host) | host.endswith("." + r_host)) & path.startswith(r_path)
        found = F.when(fits, F.struct(F.lit(r_host + r_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the character n-grams of host and path between marks, repeats included."""
    whole = F.concat(F.lit("^"), host, path, F.lit("$"))

    def of_size(n: int) -> Column:
        starts = F.when(F.length(whole) >= n, F.sequence(F.lit(1), F.length(whole) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: (F.conv(F.substring(F.md5(F.substr(whole, i, F.lit(n))), 1, 8), 16, 10).cast("long") % buckets).cast("int"))

    return F.concat(*[of_size(n) for n in SIZES])


def labelled_rows(spark: SparkSession, labelled) -> DataFrame:
    """(k, url, y) of a labelled table: a DataFrame with url and label, or (url, label) pairs, which become literals."""
    if not isinstance(labelled, DataFrame):
        pairs = [F.struct(F.lit(k + 1).alias("k"), F.lit(u).alias("url"), F.lit(y).alias("y")) for k, (u, y) in enumerate(labelled)]
        rows = spark.range(1).select(F.explode(F.array(*pairs)).alias("r")).select("r.*") if pairs else spark.range(0).select(F.lit(1).alias("k"), F.lit("").alias("url"), F.lit(0).alias("y"))
    else:
        rows = labelled.select("url", F.col("label").cast("int").alias("y")).where("url IS NOT NULL AND y IN (0, 1)")
        rows = rows.select(F.row_number().over(W.partitionBy(F.lit(0)).orderBy("url", "y")).alias("k"), "url", "y")  # MOST_LABELLED rows
    return rows


def trained(spark: SparkSession, labelled=LABELLED, buckets: int = BUCKETS, steps: int = STEPS,
            rate: float = RATE, decay: float = DECAY) -> tuple[list[float], float]:
    """(weight of each bucket, bias) of the logistic regression on mean-valued n-grams."""
    rows = labelled_rows(spark, labelled)
    count = rows.count()
    if not count:
        return [0.0] * buckets, -1.0
    if count > MOST_LABELLED:
        raise ValueError(f"{count} labelled URLs; at most {MOST_LABELLED} are learned from")
    rows = rows.select("k", "y", grams(host_of(F.col("url")), path_of(F.col("url")), buckets).alias("g"))
    # Values are scaled so that a row's product with itself is about one.
    cells = rows.select("k", F.explode("g").alias("b"), F.size("g").alias("n")).groupBy("k", "b").agg(
        (F.count(F.lit(1)) / F.sqrt(F.first("n"))).alias("x"))
    left, right = cells.alias("l"), cells.alias("r")
    products = left.join(right, F.col("l.b") == F.col("r.b")).groupBy(F.col("l.k").alias("k"), F.col("r.k").alias("j")).agg(
        F.sum(F.col("l.x") * F.col("r.x")).alias("p"))
    # One row: the labels in order, and each row's products with all, those without a shared n-gram being 0.
    products = products.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("j", "p"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda j: F.coalesce(F.element_at("m", j), F.lit(0.0)))
    one = rows.select("k", "y").join(products, "k", "left").agg(F.sort_array(F.collect_list(F.struct("k", F.col("y").cast("double").alias("y"), dense.alias("p")))).alias("t"))
    start = F.struct(F.array_repeat(F.lit(0.0), count).alias("a"), F.lit(0.0).alias("b"))

    def step(state, _):
        slope = F.transform(F.col("t"), lambda r: r["y"] - 1 / (1 + F.exp(-(F.aggregate(
            F.zip_with(r["p"], state["a"], lambda p, a: p * a), F.lit(0.0), lambda s, v: s + v) + state["b"]))))
        moved = F.zip_with(state["a"], slope, lambda a, s: a + rate * (s / count - decay * a))
        bias = state["b"] + rate * F.aggregate(slope, F.lit(0.0), lambda s, v: s + v) / count
        return F.struct(moved.alias("a"), bias.alias("b"))

    end = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("e"))
    pieces = end.select(F.posexplode("e.a").alias("at", "a"), F.col("e.b").alias("bias")).select((F.col("at") + 1).alias("k"), "a", "bias")
    weights = pieces.join(cells, "k", "left").groupBy("b").agg(F.sum(F.col("x") * F.col("a")).alias("w"), F.first("bias").alias("bias")).collect()  # at most `buckets` rows and one
    table = [0.0] * buckets
    for r in weights:
        if r["b"] is not None:
            table[r["b"]] = r["w"]
    return table, weights[0]["bias"]


def score_of(host: Column, path: Column, model: tuple[list[float], float]) -> Column:
    """How likely the model holds a URL to be one to block."""
    weights, bias = model
    found = grams(host, path, len(weights))
    table = F.lit(weights)
    total = F.aggregate(found, F.lit(0.0), lambda s, b: s + F.get(table, b))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.size(found), F.lit(1))) + bias)))


def judged(pages: DataFrame, url: str = "url", rules=RULES, model: tuple[list[float], float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each page's host, path, rule, verdict and score, besides the columns in keep."""
    model = model or trained(pages.sparkSession)
    df = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    df = df.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)).withColumn("score", score_of(F.col("host"), F.col("path"), model))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") > LEAST, F.lit("block")).otherwise(F.lit("allow")))
    return df.select(*keep, "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")


def allowed_pages(pages: DataFrame, url: str = "url", rules=RULES, model=None) -> DataFrame:
    """The pages whose URL is allowed, with the columns of pages."""
    model = model or trained(pages.sparkSession)
    host, path = host_of(F.col(url)), path_of(F.col(url))
    fit = rule_for(host, path, rules)
    return pages.where(F.coalesce(fit["verdict"] == "allow", score_of(host, path, model) <= LEAST))


def sql(labelled=LABELLED, rules=RULES) -> str:
    """The query in SQL, with the training as a recursive table: a step is one row of coefficients."""
    table = ", ".join(f"({k + 1}, '{u}', {y})" for k, (u, y) in enumerate(labelled))
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    lower = f"translate(regexp_extract({rest}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams_of = " || ".join(f"list_transform(range(1, greatest(1, length(whole) - {n - 2})), lambda i: CAST('0x' || substr(md5(substr(whole, i, {n})), 1, 8) AS BIGINT) % {BUCKETS})" for n in SIZES)
    cases = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'"
        for v, h, p in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1], r[2])))
    n = len(labelled)
    return f"""
WITH RECURSIVE lab(k, url, y) AS (VALUES {table}),
lw AS (SELECT k, y, '^' || {lower} || regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) || '$' AS whole FROM lab),
lg AS (SELECT k, y, {grams_of} AS g FROM lw),
cells AS (SELECT k, b, count(*) / sqrt(any_value(n)) AS x FROM (SELECT k, len(g) AS n, unnest(g) AS b FROM lg) GROUP BY k, b),
prod AS (SELECT l.k, r.k AS j, sum(l.x * r.x) AS p FROM cells l JOIN cells r ON l.b = r.b GROUP BY l.k, r.k),
mat AS (SELECT list(ps ORDER BY k) AS m FROM (SELECT a.k, list(coalesce(p, 0.0::DOUBLE) ORDER BY b.k) AS ps FROM lab a CROSS JOIN lab b LEFT JOIN prod ON prod.k = a.k AND prod.j = b.k GROUP BY a.k)),
ys AS (SELECT list(CAST(y AS DOUBLE) ORDER BY k) AS ys FROM lab),
it(t, a, b) AS (
  SELECT 0, list_transform(range(0, {n}), lambda i: 0.0::DOUBLE), 0.0::DOUBLE
  UNION ALL
  SELECT t + 1, list_transform(range(1, {n} + 1), lambda i: a[i] + {RATE}::DOUBLE * (s[i] / {n} - {DECAY}::DOUBLE * a[i])), b + {RATE}::DOUBLE * list_sum(s) / {n}
  FROM (SELECT t, a, b, list_transform(range(1, {n} + 1), lambda i: ys[i] - 1 / (1 + exp(-(list_dot_product(m[i], a) + b)))) AS s FROM it, mat, ys WHERE t < {STEPS})),
last AS (SELECT a, b FROM it WHERE t = {STEPS}),
w AS (SELECT cells.b, sum(x * last.a[k]) AS w FROM cells, last GROUP BY cells.b),
pg AS (SELECT page_id, host, path, '^' || host || path || '$' AS whole FROM (SELECT page_id, coalesce({lower}, '') AS host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages)),
gr AS (SELECT row_number() OVER () AS rid, page_id, host, path, {grams_of} AS g FROM pg),
sc AS (SELECT rid, sum(w) AS total FROM (SELECT rid, unnest(g) AS b FROM gr) u LEFT JOIN w ON u.b = w.b GROUP BY rid),
fin AS (SELECT page_id, host, path, CASE {cases} END AS fit, 1 / (1 + exp(-(coalesce(total, 0) / sqrt(greatest(len(g), 1)) + last.b))) AS score FROM gr LEFT JOIN sc USING (rid), last)
SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule, coalesce(split_part(fit, ' ', 1), CASE WHEN score > {LEAST}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict FROM fin"""


SQL = sql()
