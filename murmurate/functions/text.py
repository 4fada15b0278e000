"""Text functions: phrases, titles, quotes, names and scripts, as column expressions wherever Spark has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX_FROM = 4
#: Scripts written without blanks between words.
SPACELESS = "\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\u0E00-\\u0E7F"
#: Titles that say a post is not live yet, is another kind of post, or names a release. Fixed values.
NOT_LIVE = ("public test", "test server", "test branch", "stress test", "playtest", "beta", "experimental", "ptr", "delay", "delayed", "delays", "upcoming",
            "incoming", "coming", "sneak peek", "preview", "roadmap", "release date", "launch date", "revealed", "pre patch", "not an update")
NOT_A_RELEASE = ("sale", "discount", "free weekend", "bundle", "preorder", "preorders", "pre order", "pre orders", "merch", "merchandise", "community update",
                 "state of the game", "development update", "dev update", "progress update", "status update", "update history", "update news")
RELEASE = ("patch", "patches", "hotfix", "hotfixes", "update", "changelog", "patchnotes", "release notes")
_VERSION = r"^[vV]?[0-9]+(\.[0-9]+)*\.[0-9]+[a-z]?$"


def search_words(text: Column) -> Column:
    """Lower-cased words; letters of spaceless scripts end a word."""
    return F.filter(F.split(F.lower(text), f"[^\\p{{IsAlphabetic}}\\p{{N}}]+|[{SPACELESS}]+"), lambda w: w != "")


def phrase_forms(text: Column, query: str) -> Column:
    """Every form a text says a phrase in: words in order, long ones by their start; runs for spaceless scripts."""
    import re

    lowered = query.strip().lower()
    if re.search(f"[{SPACELESS.encode().decode('unicode_escape')}]", lowered):
        run = re.sub(r"\s", "", lowered)
        return F.when(F.lower(text).contains(run), F.array(F.lit(run))).otherwise(F.array().cast("array<string>"))
    wanted = [w for w in re.split(r"[\W_]+", lowered) if w]
    if not wanted:
        return F.array().cast("array<string>")
    n = len(wanted)
    none = F.array().cast("array<string>")

    def said(words: Column) -> Column:
        at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))

        def fits(i: Column) -> Column:
            hit = F.lit(True)
            for k, w in enumerate(wanted):
                word = F.get(words, i + k)
                hit = hit & (word.startswith(w) if len(w) >= PREFIX_FROM else word == w)
            return hit

        return F.transform(F.filter(at, fits), lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))

    found = F.element_at(F.transform(F.array(search_words(text)), said), 1)
    return F.when(F.lower(text).contains(wanted[0]), found).otherwise(none)


def says(words: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a list of words holds any phrase as neighbouring words."""
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    hit = F.lit(False)
    for p in phrases:
        hit = hit | line.contains(f" {p} ")
    return hit


def has_version(title: Column) -> Column:
    """Whether a title has a version number; prices and shares are none."""
    tokens = F.split(title, r"[^\p{IsAlphabetic}\p{N}.$€£%]+")
    return F.exists(tokens, lambda t: F.regexp_replace(t, r"\.+$", "").rlike(_VERSION))


def is_update(title: Column, patch_notes: Column) -> Column:
    """Whether a post is an update that players received, by its title and mark."""
    words = F.filter(F.split(F.lower(title), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")
    refused = says(words, NOT_LIVE) | says(words, NOT_A_RELEASE) | F.lower(title).contains("% off")
    return ~refused & (patch_notes | says(words, RELEASE) | has_version(title))


def plain_title(title: Column, most: int = 200) -> Column:
    """A title as one line: no control or direction marks, single blanks, a bounded length."""
    one = F.regexp_replace(F.regexp_replace(title, r"[\s\p{Z}\u0085]+", " "), r"[\p{Cc}‎‏‪-‮⁦-⁩]", "")
    return F.left(F.trim(F.regexp_replace(one, " +", " ")), F.lit(most))


def quote_cut(text: Column, most: int = 240) -> Column:
    """A quote of at most so many characters, cut at its last blank and marked."""
    head = F.left(text, F.lit(most))
    at = F.regexp_extract(head, r"(?s)^(.*\S)\s+\S*$", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(at != "", at).otherwise(head), F.lit("…")))


def html_escaped(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def file_safe(name: Column) -> Column:
    """A name with the characters that files can't have made dashes, trimmed of blanks and dots."""
    return F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|\p{Cc}]', "-"), r"^[ .]+|[ .]+$", "")


def reads_as_words(text: Column) -> Column:
    """At least three words, and letters four fifths of all that is not blank."""
    letters, marks = F.regexp_count(text, F.lit(r"\p{IsAlphabetic}")), F.regexp_count(text, F.lit(r"\S"))
    return (F.regexp_count(text, F.lit(r"\S+")) >= 3) & (letters * 5 >= marks * 4)


def keyword_subject(text: Column, keywords: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]) -> Column:
    """The first subject whose terms a text has and whose exceptions it hasn't; ASCII terms on word edges."""
    import re

    lowered, found = F.lower(text), F.lit(None).cast("string")

    def any_of(terms: tuple[str, ...]) -> Column:
        if not terms:
            return F.lit(False)
        parts = [f"(?<![0-9a-z_\\u0080-\\uFFFF]){re.escape(t)}(?![0-9a-z_\\u0080-\\uFFFF])" if t.isascii() else re.escape(t) for t in terms]
        return lowered.rlike("|".join(parts))

    for subject, terms, unless in reversed(keywords):
        found = F.when(any_of(terms) & ~any_of(unless), F.lit(subject)).otherwise(found)
    return found


def wrong_script(text: Column, own: str) -> Column:
    """At least four letters of scripts, and more of other scripts than of the language's own (a class such as Latin)."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    mine = F.regexp_count(text, F.lit(f"\\p{{Is{own}}}"))
    return (letters >= 4) & (letters - mine > mine)


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The characters between two UTF-8 byte offsets; null out of range or inside a character."""
    raw = F.encode(text, "UTF-8")
    part = F.try_validate_utf8(F.substr(raw, start + 1, end - start).cast("string"))
    return F.when((start >= 0) & (start <= end) & (end <= F.octet_length(text)), part)


def numbers_in(text: Column) -> Column:
    """Numbers with their inner separators and a closing percent sign."""
    return F.regexp_extract_all(text, F.lit(r"([0-9]+(?:[.,][0-9]+)*%?)"), F.lit(1))


def bigrams(text: Column) -> Column:
    """Overlapping pairs of characters, for runs of scripts without blanks."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    pairs = lambda c: F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.element_at(F.transform(F.array(chars), pairs), 1)
