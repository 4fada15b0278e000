"""Words, lines and hashes as column expressions that DuckDB computes alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
GAPS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(text_or_empty(text), GAPS), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words a text has, without building them."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def md5_long(text: Column) -> Column:
    """The first 60 bits of a text's MD5 as a long, which any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def own_name(columns: list[str], wanted: str) -> str:
    """A column name that no column of the caller has, letter case aside."""
    taken = {c.lower() for c in columns}
    name = wanted
    while name.lower() in taken:
        name += "_"
    return name
