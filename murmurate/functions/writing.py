"""Text around claims and about them: windows for a reader, checks on a paragraph, and a page of figures."""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "**"
#: Tokens that every pair of texts costs beside its own.
PAIR_TOKENS = 4
LEAST_SENTENCES = 2

_SENTENCE = re.compile(r"""[^.!?]*(?:[.!?](?!["”'’)]*(?:\s|$))[^.!?]*)*[.!?]["”'’)]*(?=\s|$)""")
_NUMBER = re.compile(r"\d+(?:[.,]+\d+)*%?", re.ASCII)
_QUOTED = re.compile(r'["“](.*?)["”]', re.DOTALL)


def window_around(review: str, offsets: list[tuple[int, int]], at: int, length: int, budget: int, mark: bool = False) -> str:
    """What of a review a reader can afford, as many tokens before a claim as after it, the claim marked if asked.

    offsets are the UTF-8 byte spans of the review's tokens, in order. The claim is paid for twice, once on its own. A
    review without tokens, or spans that cut a character, leave the review whole.
    """
    raw = review.encode()
    if not offsets:
        return review
    ends = at + length
    first = min(bisect_right([e for _, e in offsets], at), len(offsets))
    first = 0 if first == len(offsets) else first
    last = bisect_left([s for s, _ in offsets], ends)
    spare = max(0, budget - (2 * max(0, last - first) + PAIR_TOKENS)) // 2
    opens = offsets[max(0, first - spare)][0]
    closes = offsets[min(max(1, last + spare), len(offsets)) - 1][1]
    try:
        kept = raw[opens:closes].decode() if opens <= closes <= len(raw) else review
        if not mark or not opens <= at <= ends <= closes:
            return kept
        return f"{raw[opens:at].decode()}{MARK} {raw[at:ends].decode()} {MARK}{raw[ends:closes].decode()}"
    except UnicodeDecodeError:
        return review


def sentences(text: str) -> list[str]:
    """Finished sentences with their closing marks."""
    return [s for s in (m.group().strip() for m in _SENTENCE.finditer(text)) if s]


def numbers(sentence: str) -> list[str]:
    return _NUMBER.findall(sentence)


def quotations(sentence: str) -> list[str]:
    return _QUOTED.findall(sentence)


def _plain(text: str) -> str:
    return " ".join(text.split()).lower().replace("’", "'").replace("‘", "'")


def checked(paragraph: str, told: str, quotable: list[str], least: int = LEAST_SENTENCES) -> str | None:
    """The sentences whose numbers were told and whose quotations were given; None where fewer than ``least`` are left."""
    told, given = _plain(told), [_plain(q) for q in quotable]
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def holds(s: str) -> bool:
        quoted = [_plain(q.strip(marks)) for q in quotations(s)]
        return all(n in told for n in numbers(s)) and all(q and any(q in g for g in given) for q in quoted)

    kept = [s for s in sentences(paragraph) if holds(s)]
    return " ".join(kept) if len(kept) >= least else None


def checked_column(paragraph: Column, told: Column, quotable: Column) -> Column:
    @F.pandas_udf("string")
    def run(p: pd.Series, t: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([checked(a, b or "", list(c) if c is not None else []) if isinstance(a, str) else None for a, b, c in zip(p, t, q, strict=True)])

    return run(paragraph, told, quotable)


def brief(points: DataFrame, each: int = 8) -> DataFrame:
    """One line a side, its most raised points first: what a writer is told. points: side, label, reviews."""
    told = F.array_join(F.transform(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("reviews", "label")))), 1, each),
                                    lambda p: F.concat(p["label"], F.lit(" ("), F.format_number(p["reviews"], 0), F.lit(" reviews)"))), "; ")
    return points.groupBy("side").agg(told.alias("told"))


def page(title: str, tables: dict[str, DataFrame], rows: int = 200) -> str:
    """A self-contained page of tables of figures, each of a bounded number of rows."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else f'{v:.4g}' if isinstance(v, float) else str(v))}" for v in r) for r in df.limit(rows).collect())
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}{body}</table>")
    return "\n".join(parts)


def reading_seconds(taken: DataFrame, sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """About how long readings take: from the same size's earlier ones in a language, else another size's, scaled.

    taken: size, language, seconds, reviews. sizes: size, cost (of the same claims on one processor), place. wanted: size, language, reviews.
    """
    rate = taken.where("reviews > 0 AND seconds > 0").groupBy("size", "language").agg((F.sum("seconds") / F.sum("reviews")).alias("rate"))
    own = rate.select(F.col("size").alias("o_size"), F.col("language").alias("o_language"), F.col("rate").alias("own"))
    other = rate.join(F.broadcast(sizes), "size").groupBy("language").agg(F.min_by(F.col("rate") / F.col("cost"), "place").alias("unit")).withColumnRenamed("language", "u_language")
    df = wanted.join(own, (F.col("size") == F.col("o_size")) & F.col("language").eqNullSafe(F.col("o_language")), "left").join(other, F.col("language").eqNullSafe(F.col("u_language")), "left")
    df = df.join(F.broadcast(sizes.drop("place")), "size")
    return df.select("size", "language", "reviews", (F.coalesce("own", F.col("unit") * F.col("cost")) * F.col("reviews")).alias("seconds"))


def rebuilt(kept: str, claims: list[str]) -> str | None:
    """The kept text cut down to the claims drawn from it, in order, with what stands between them; None if one is missing."""
    at, spans = 0, []
    for c in claims:
        found = kept.find(c, at)
        if found < 0:
            return None
        spans.append((found, found + len(c)))
        at = found + len(c)
    return kept[spans[0][0] : spans[-1][1]] if spans else ""
