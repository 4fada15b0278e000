"""The questions people ask of a corpus, over any reviews and readings.

reviews: review, created (Unix seconds), language, voted_up, helpfulness, played (minutes or null), deck, early, free,
and text and game where a question needs them. claims: review, ord, start, end, subject (null: declined), polarity,
confidence, also (a map from further subjects to their side).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurate.functions import text as tx
from murmurate.functions.stats import dot, errors_apart, ratio, wilson
from murmurate.operators import changes, rollups
from murmurate.operators.sampling import hash_rank, page
from murmurate.plans.adapters import month_of
from murmurate.sources import capture, files


class Corpus:
    def __init__(self, reviews: DataFrame, claims: DataFrame):
        self.reviews, self.claims = reviews, claims

    @classmethod
    def from_capture(cls, spark: SparkSession, snapshot: str, readings: str, as_of: int | None = None) -> Corpus:
        """A snapshot's newest copies (as a reading of that time saw them) with its readings."""
        rows = capture.counting_rows(capture.newest(capture.scan(spark, snapshot), as_of=as_of))
        reviews = rows.select(F.col("recommendationid").alias("review"), "created", "language", "voted_up", "helpfulness", F.col("played_minutes").alias("played"),
                              F.col("primarily_steam_deck").alias("deck"), F.col("written_during_early_access").alias("early"), F.col("received_for_free").alias("free"), "author", F.col("review").alias("text"))
        found = capture.readings(spark, readings)
        # Readings of one span, as copies of a review have, are in one place.
        place = F.dense_rank().over(W.partitionBy("recommendationid").orderBy("start", "end")) - 1
        claims = found.select(F.col("recommendationid").alias("review"), place.alias("ord"), "start", "end", "subject", "polarity", F.col("confidence").cast("double").alias("confidence"), F.col("also_map").alias("also"))
        return cls(reviews, claims.join(reviews.select("review"), "review", "left_semi"))

    def in_language(self, language: str) -> Corpus:
        chosen = self.reviews.where(F.col("language") == language)
        return Corpus(chosen, self.claims.join(chosen.select("review"), "review", "left_semi"))

    def of_kind(self, kind: str) -> Corpus:
        """The reviews one kind of reviewer wrote."""
        chosen = self.reviews.where(F.array_contains(rollups.kinds_of(), kind))
        return Corpus(chosen, self.claims.join(chosen.select("review"), "review", "left_semi"))

    @cached_property
    def named(self) -> DataFrame:
        """Every (claim, subject it names): the first one and those beside it."""
        return self.named_with()

    def named_with(self, *more: str) -> DataFrame:
        """The same with more columns of the claim."""
        own = F.array(F.struct(F.col("subject").alias("s"), F.col("polarity").alias("p")))
        beside = F.transform(F.map_entries(F.coalesce("also", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("s"), e["value"].alias("p")))
        rows = self.claims.select("review", "ord", *more, F.explode(F.filter(F.concat(own, beside), lambda x: x["s"].isNotNull())).alias("x"))
        return rows.select("review", "ord", F.col("x.s").alias("subject"), F.col("x.p").alias("polarity"), *more)

    @cached_property
    def sides(self) -> DataFrame:
        return self.named.groupBy("review", "subject").agg(F.bool_or(F.col("polarity") == "praise").alias("praise"), F.bool_or(F.col("polarity") == "complaint").alias("complaint"), F.count(F.lit(1)).alias("n_claims"))

    def totals(self) -> DataFrame:
        """One row: reviews, positive, claims, unclassified, silent, claimless."""
        per = self.claims.groupBy("review").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("subject").isNull()).alias("declined"),
                                                F.bool_and(F.col("subject").isNull() & (F.size(F.map_keys(F.coalesce("also", F.create_map().cast("map<string,string>")))) == 0)).alias("silent"))
        df = self.reviews.join(per, "review", "left")
        return df.agg(F.count(F.lit(1)).alias("reviews"), F.count_if("voted_up").alias("positive"), F.coalesce(F.sum("n"), F.lit(0)).alias("claims"), F.coalesce(F.sum("declined"), F.lit(0)).alias("unclassified"),
                      F.count_if(F.coalesce("silent", F.lit(True))).alias("silent"), F.count_if(F.col("n").isNull()).alias("claimless"))

    def subjects(self, top: int = rollups.TOP) -> DataFrame:
        """Every subject's counts, rate with its interval, and how far the most helpful reviews overstate it."""
        counts = rollups.per_subject(self.sides, self.reviews.select("review", "voted_up"))
        pile = rollups.most_helpful(self.reviews.select("review", "helpfulness"), top).select("review")
        in_pile = self.sides.join(F.broadcast(pile), "review", "left_semi").groupBy("subject").agg(F.count(F.lit(1)).alias("top_mentions"))
        n = self.reviews.agg(F.count(F.lit(1)).alias("reviews"))
        df = counts.join(in_pile, "subject", "left").fillna(0, ["top_mentions"]).join(F.broadcast(n))
        low, high = wilson(F.col("mention_reviews"), F.col("reviews"))
        rate = ratio(F.col("mention_reviews"), F.col("reviews"))
        return df.withColumns({"rate": rate, "low": low, "high": high, "positive_share": ratio(F.col("positive_mentions"), F.col("mention_reviews")),
                               "bias": (F.col("top_mentions") / F.least(F.lit(top), F.col("reviews"))) / rate})

    def months(self) -> DataFrame:
        return rollups.monthly(self.reviews, self.sides)

    def recent_moves(self, month: str, recent: int = changes.RECENT, before: int = changes.BEFORE, bar: float = changes.BAR) -> DataFrame:
        """Subjects whose praise or complaints moved clearly in the months that end with one, against those before, clearest first."""
        last = int(month[:4]) * 12 + int(month[5:7]) - 1
        at = changes.month_index(month_of(F.col("created")))
        dated = self.reviews.select("review", F.when(at.between(last - recent + 1, last), 1).when(at.between(last - recent - before + 1, last - recent), 0).alias("side")).where(F.col("side").isNotNull())
        totals = dated.agg(F.count_if(F.col("side") == 1).alias("of_recent"), F.count_if(F.col("side") == 0).alias("of_before"))
        both = F.explode(F.array(F.struct(F.lit("praise").alias("what"), F.col("praise").alias("hit")), F.struct(F.lit("complaint").alias("what"), F.col("complaint").alias("hit"))))
        found = self.sides.join(dated, "review").select("subject", "side", both.alias("x")).groupBy("subject", F.col("x.what").alias("what")).agg(
            F.count_if((F.col("side") == 1) & F.col("x.hit")).alias("hit_recent"), F.count_if((F.col("side") == 0) & F.col("x.hit")).alias("hit_before"))
        df = found.join(F.broadcast(totals)).where((F.col("of_recent") >= changes.RECENT_FLOOR) & (F.col("of_before") >= changes.BEFORE_FLOOR))
        df = df.withColumn("z", errors_apart(F.col("hit_before"), F.col("of_before"), F.col("hit_recent"), F.col("of_recent")))
        gap = F.col("hit_recent") / F.col("of_recent") - F.col("hit_before") / F.col("of_before")
        return df.where(changes.clear(F.col("z"), gap, bar)).orderBy(F.desc(F.abs("z")), "subject", "what")

    def around(self, updates: DataFrame) -> DataFrame:
        """Each subject's reviews in the 28 days before and after every update (name, posted)."""
        met = changes.around(self.reviews.select("review", "created"), updates)
        totals = met.groupBy("name").agg(F.count_if(~F.col("after")).alias("of_before"), F.count_if("after").alias("of_after"))
        found = met.join(self.sides, "review").groupBy("name", "subject").agg(*[F.count_if((F.col("after") if when == "after" else ~F.col("after")) & F.col(s)).alias(f"{s}_{when}") for s in ("praise", "complaint") for when in ("before", "after")])
        return found.join(totals, "name")

    def compare(self, these: str, others: str | None = None) -> DataFrame:
        """One kind of reviewer beside another of its split, or beside everyone else of it, subject by subject."""
        if these not in rollups.SPLIT_OF or (others is not None and rollups.SPLIT_OF.get(others) != rollups.SPLIT_OF[these]) or these == others:
            raise ValueError("kinds must be two different ones of the same split")
        heads, found = rollups.segment_heads(self.reviews), rollups.segment_subjects(self.reviews, self.sides)
        mine = F.col("kind") == these
        rest = (F.col("kind") == others) if others else ((F.col("split") == rollups.SPLIT_OF[these]) & ~mine)
        n = heads.agg(F.sum(F.when(mine, F.col("reviews"))).alias("reviews"), F.sum(F.when(rest, F.col("reviews"))).alias("other_reviews"))
        cells = {"raised": F.col("raised"), "praises": F.col("praised") + F.col("mixed"), "complains": F.col("criticised") + F.col("mixed")}
        sums = [F.coalesce(F.sum(F.when(who, c)), F.lit(0)).alias(f"{name}{end}") for name, c in cells.items() for who, end in ((mine, ""), (rest, "_other"))]
        df = found.groupBy("subject").agg(*sums).join(F.broadcast(n))
        return df.withColumns({f"z_{c}": errors_apart(F.col(f"{c}_other"), F.col("other_reviews"), F.col(c), F.col("reviews")) for c in cells}).withColumn(
            "enough", (F.col("reviews") >= rollups.SEGMENT_FLOOR) & (F.col("other_reviews") >= rollups.SEGMENT_FLOOR))

    def claims_behind(self, subject: str, side: str | None = None, term: str | None = None, kind: str | None = None, start: int = 0, count: int = 25) -> DataFrame:
        """A page of the claims behind a figure, in the order of reviews, with their words and the total of all pages."""
        found = self.named_with("start", "end", "confidence").where(F.col("subject") == subject)
        found = found if side is None else found.where(F.col("polarity") == side)
        reviews = self.reviews if kind is None else self.reviews.where(F.array_contains(rollups.kinds_of(), kind))
        rows = found.join(reviews.select("review", "text", "language", "helpfulness"), "review")
        rows = rows.withColumn("claim", tx.byte_slice(F.col("text"), F.col("start"), F.col("end"))).where(F.col("claim").isNotNull())
        if term is not None:
            rows = rows.where(F.size(tx.phrase_forms(F.col("claim"), term)) > 0)
        total = rows.agg(F.count(F.lit(1)).alias("total"))
        # Ids that are numbers written as text stand in the order of the numbers.
        return page(rows.drop("text"), start, count, F.col("review").try_cast("decimal(38,0)").asc_nulls_last(), "review", "ord").join(F.broadcast(total))

    def search(self, query: str) -> DataFrame:
        """Claims that say a phrase, with its forms: reviews are tested first, then their claims."""
        said = self.reviews.select("review", "text", "helpfulness").where(F.size(tx.phrase_forms(F.col("text"), query)) > 0)
        rows = said.join(self.claims, "review").withColumn("claim", tx.byte_slice(F.col("text"), F.col("start"), F.col("end")))
        rows = rows.withColumn("forms", tx.phrase_forms(F.col("claim"), query)).where(F.size("forms") > 0)
        return rows.select("review", "ord", "subject", "polarity", "helpfulness", "claim", "forms").orderBy(F.desc("helpfulness"), "review", "ord")

    def shortlist(self, each: int = 8, seed: int = 1) -> DataFrame:
        """Claims of each subject and side by hash rank, sides in turn."""
        key = F.concat_ws(":", F.col("review").cast("string"), F.col("ord").cast("string"), F.col("subject"))
        w = W.partitionBy("subject", "polarity").orderBy(hash_rank(seed, "report", key), "review", "ord")
        few = self.named.withColumn("place", F.row_number().over(w)).where(F.col("place") <= 2 * each)
        turn = F.row_number().over(W.partitionBy("subject").orderBy("place", F.when(F.col("polarity") == "praise", 0).when(F.col("polarity") == "complaint", 1).otherwise(2)))
        return few.withColumn("turn", turn).where(F.col("turn") <= each).drop("place")

    def export(self, folder: str) -> None:
        """Subjects, months and points as files for people, in a new folder."""
        points = self.named_with("start", "end", "confidence")
        files.export({"subjects": self.subjects(), "months": self.months(), "points": points}, folder, "subjects: a row a subject. months: a row a month and subject. points: a row a claim and subject.\n")


def search_by_meaning(vectors: DataFrame, query: list[float], skip: DataFrame | None = None, rerank=None, most: int = 100, least: float = 0.1, shown: int = 50) -> DataFrame:
    """The claims nearest to a query vector, less those a word search found; with ``rerank`` (texts -> scores) cut again.

    vectors: review, ord, claim, vector. Top-k by similarity without a sort of all; reranking sees ``most`` rows.
    """
    rest = vectors if skip is None else vectors.join(skip.select("review", "ord"), ["review", "ord"], "left_anti")
    q = F.lit([float(x) for x in query])
    near = rest.withColumn("similarity", dot(F.col("vector"), q) / F.sqrt(dot(F.col("vector"), F.col("vector")) * dot(q, q)))
    near = near.orderBy(F.desc("similarity"), "review", "ord").limit(most)
    if rerank is None:
        return near

    def run(batches):
        for b in batches:
            yield b.assign(score=rerank(b["claim"].tolist()))

    schema = near.select("review", "ord", "claim", "similarity").schema.add("score", "double")
    return near.select("review", "ord", "claim", "similarity").mapInPandas(run, schema).where(F.col("score") >= least).orderBy(F.desc("score"), F.desc("similarity"), "review", "ord").limit(shown)
