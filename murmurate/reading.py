"""Reading a corpus: claims cut, classified once for each distinct question, lines applied, earlier answers reused."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurate.functions import formats, splitter

#: What a model returns for each claim.
ANSWER = "subject string, confidence double, polarity string, also map<string,string>"
#: model(texts of claims, languages) -> one (subject or None, confidence, polarity, also) a claim.
Model = Callable[[list[str], list[str]], list[tuple]]


def claims_of(reviews: DataFrame, deep: bool = True) -> DataFrame:
    """(recommendationid, language, text_key, ord, start, end, claim) of reviews with id, language and text."""
    keyed = reviews.withColumn("text_key", formats.text_key(F.col("text")))
    return splitter.exploded(keyed, "text", "recommendationid", "language", "text_key", deep=deep)


def answered(claims: DataFrame, model: Model) -> DataFrame:
    """claims with the model's answer, which is asked once for each distinct (review text, place, claim, language).

    Batches are sorted by length, so that a model that pads wastes little.
    """
    question = F.sha2(F.concat_ws("\x1f", F.col("text_key").cast("string"), F.col("ord").cast("string"), "claim", F.coalesce("language", F.lit(""))), 256)
    asked = claims.withColumn("question", question)
    once = asked.select("question", "claim", F.coalesce("language", F.lit("")).alias("language")).dropDuplicates(["question"])
    once = once.repartition("question").sortWithinPartitions(F.length("claim"))

    def run(batches):
        for b in batches:
            found = model(b["claim"].tolist(), b["language"].tolist())
            subject, confidence, polarity, also = zip(*found, strict=True) if found else ((), (), (), ())
            yield pd.DataFrame({"question": b["question"], "subject": list(subject), "confidence": list(confidence), "polarity": list(polarity), "also": [a or {} for a in also]})

    answers = once.mapInPandas(run, f"question string, {ANSWER}")
    return asked.join(answers, "question").drop("question")


def with_lines(df: DataFrame, subject_lines: DataFrame | None = None, language_lines: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """Answers under their line become declined: subject and language lines (name, line), the higher one counting.

    A name without a line, or with a null one, is never answered; without any lines one threshold holds for all.
    """
    never = F.lit(float("inf"))
    line = F.lit(threshold if threshold is not None else 0.0)
    if subject_lines is not None:
        s = subject_lines.select(F.col("name").alias("line_subject"), F.col("line").alias("subject_line"))
        df = df.join(s, F.col("subject") == F.col("line_subject"), "left").drop("line_subject")
        line = F.coalesce("subject_line", never)
    if language_lines is not None:
        s = language_lines.select(F.col("name").alias("line_language"), F.col("line").alias("language_line"))
        df = df.join(s, F.col("language") == F.col("line_language"), "left").drop("line_language")
        line = F.greatest(line, F.coalesce("language_line", never))
    kept = F.col("confidence") >= line
    return df.withColumn("subject", F.when(kept, F.col("subject"))).drop("subject_line", "language_line")


def reused(claims: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims with an earlier answer, claims to ask about).

    An earlier answer holds only for a review whose text key agrees and that is cut into exactly the same spans.
    """
    spans = lambda df: df.groupBy("recommendationid", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    same = spans(claims).join(spans(prior), ["recommendationid", "text_key", "spans"]).select("recommendationid")
    held = claims.join(same, "recommendationid", "left_semi").join(prior.select("recommendationid", "start", "end", "subject", "confidence", "polarity", "also"), ["recommendationid", "start", "end"])
    return held, claims.join(same, "recommendationid", "left_anti")


def read(reviews: DataFrame, model: Model, prior: DataFrame | None = None, deep: bool = True, **lines) -> DataFrame:
    """Readings of reviews (recommendationid, language, text): one row a claim, with earlier answers where they still hold."""
    claims = claims_of(reviews, deep)
    columns = ["recommendationid", "language", "text_key", "ord", "start", "end", "claim", "subject", "confidence", "polarity", "also"]
    if prior is None:
        return with_lines(answered(claims, model), **lines).select(columns)
    held, new = reused(claims, prior)
    return held.select(columns).unionByName(with_lines(answered(new, model), **lines).select(columns))


def stored_form(readings: DataFrame) -> DataFrame:
    """Readings as files keep them, with ``also`` as text."""
    pairs = F.transform(F.map_entries("also"), lambda e: F.struct(e["key"].alias("subject"), e["value"].alias("polarity")))
    return readings.select("recommendationid", "start", "end", "subject", F.col("confidence").cast("float").alias("confidence"), "polarity", formats.also_text(pairs).alias("also"), "text_key")


def polarity_on(subject: Column, wanted: str, polarity: Column, also: Column) -> Column:
    """The side a reading takes on a subject: its own if it names it first, else the one beside; null if it names it not."""
    return F.when(subject == wanted, polarity).otherwise(F.element_at(also, F.lit(wanted)))
