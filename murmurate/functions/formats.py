"""Figures, dates and codes as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(count: Column) -> Column:
    return F.format_number(count, 0)


def percent(share: Column, tenths: bool = False) -> Column:
    """A share as people read it: whole points from 10% to 90%, tenths nearer the ends, half up on its shortest decimal text."""
    text = F.format_string("%s", share)
    exact = F.when(text.contains("E"), F.format_string("%.17f", share)).otherwise(text)
    fraction = F.rpad(F.regexp_extract(exact, r"\.(\d+)", 1), 6, "0")
    digit = lambda k: F.substring(fraction, k, 1).cast("int")
    points = digit(1) * 10 + digit(2) + (digit(3) >= 5).cast("int")
    finer = digit(1) * 100 + digit(2) * 10 + digit(3) + (digit(4) >= 5).cast("int")
    fine = F.when(finer % 10 == 0, F.concat(F.floor(finer / 10).cast("string"), F.lit("%"))).otherwise(F.concat(F.floor(finer / 10).cast("string"), F.lit("."), (finer % 10).cast("string"), F.lit("%")))
    middle = F.lit(not tenths) & share.between(0.1, 0.9)
    return (F.when(share.isNull() | F.isnan(share) | (share <= 0), "0%").when(share >= 1, "100%").when(share < 0.001, "<0.1%").when(share > 0.999, ">99.9%")
            .when(middle, F.concat(points.cast("string"), F.lit("%"))).otherwise(fine))


def percent_range(rate: Column, low: Column, high: Column) -> Column:
    """A rate with its interval at one precision, such as ``12% [10%, 14%]``; without the ends where they read alike."""
    fine = percent(rate).contains(".") | percent(low).contains(".") | percent(high).contains(".")
    fine = fine | (percent(low) == percent(high))
    pair = lambda t: F.concat(percent(rate, t), F.lit(" ["), percent(low, t), F.lit(", "), percent(high, t), F.lit("]"))
    return F.when(~fine, pair(False)).when(percent(low, True) == percent(high, True), percent(rate)).otherwise(pair(True))


def decimal_cell(value: Column) -> Column:
    """Six places without closing zeros."""
    return F.when(value.isNotNull(), F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", ""))


def hours(minutes: Column) -> Column:
    """Minutes under an hour, else hours to a tenth, half up."""
    tenths = F.floor((minutes * 10 + 30) / 60)
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).when(minutes.isNotNull(), F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" h")))


def month_name(label: Column) -> Column:
    return F.date_format(F.to_date(F.concat(label, F.lit("-01"))), "MMM yyyy")


def day_text(unix: Column) -> Column:
    return F.when(unix > 0, F.date_format(F.timestamp_seconds(unix), "d MMMM yyyy")).otherwise("unknown")


def iso_day(unix: Column) -> Column:
    return F.when(unix > 0, F.date_format(F.timestamp_seconds(unix), "yyyy-MM-dd"))


def polarity_name(code: Column) -> Column:
    return F.when(code == 0, "praise").when(code == 1, "complaint").otherwise("neutral")


def polarity_code(name: Column) -> Column:
    return F.when(name == "praise", 0).when(name == "complaint", 1).otherwise(2)


def also_text(pairs: Column) -> Column:
    """An array of (subject, polarity) as ``audio:praise,controls:complaint``, in order of subject; null when empty."""
    parts = F.transform(F.array_sort(pairs), lambda p: F.concat(p["subject"], F.lit(":"), p["polarity"]))
    return F.when(F.size(parts) > 0, F.array_join(parts, ","))


def also_map(text: Column) -> Column:
    """The map that an ``also`` text stands for; empty for null."""
    return F.when(text.isNull() | (text == ""), F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(text, F.lit(","), F.lit(":")))


def text_key(text: Column) -> Column:
    """The first eight bytes of a text's SHA-256 as a little-endian number."""
    pairs = F.reverse(F.regexp_extract_all(F.substring(F.sha2(text, 256), 1, 16), F.lit("(..)"), F.lit(1)))
    return F.conv(F.array_join(pairs, ""), 16, 10).cast("decimal(20,0)")


def number_or_text(raw: Column, path: str) -> Column:
    """A JSON number, or a string that holds one; else null."""
    return F.get_json_object(raw, path).try_cast("double")
