"""Splitting a review into the points it makes, as byte spans and cleaned text.

The text is read once into marks (tags, line ends, sentence ends, quotes); a cut is made after a mark that ends a point.
Pieces are then tidied, lists of short parts are cut at their commas, and fragments join a neighbour. A review that
is a filled-in form is read by its ticked boxes instead. Offsets are UTF-8 bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
BALLOT_BOXES = "☐☑☒□✓✔✅🔲🔳⬜"
TICKED = "☑☒✓✔✅"
CENSORED = "♥"
TERMINATORS = ".!?…。！？۔।"
BREAKING_TAGS = ("*", "hr", "list", "olist", "quote", "table", "tr", "td", "th")
MARKERS = "-+*•·–—>,，、"
ABBREVIATIONS = frozenset((
    "mr", "mrs", "ms", "dr", "prof", "vs", "etc", "eg", "ie", "approx", "max", "vol", "ch", "pp", "st", "inc", "ltd", "jr", "sr", "ca", "bzw", "evtl", "ggf", "usw", "zb", "dh", "uvm", "inkl", "bspw", "eig", "sog",
    "bzgl", "env", "ecc", "def", "ed", "ver", "vers", "esp", "resp", "orig", "hrs", "hr", "min", "sec", "avg", "lvl", "ep", "ect"))
RUSSIAN_ABBREVIATIONS = frozenset(("т.е", "т.к", "т.ч", "напр", "доп"))
RUSSIAN_BEFORE_A_CAPITAL = frozenset(("т.д", "т.п", "тд", "тп", "см", "др", "ч", "мин", "сек", "руб", "р", "тыс", "млн", "млрд", "г"))
BOXES_OF_A_FORM, SHORT_PART, LEAST_PART, SHORT_ANSWER, LEAST_WEIGHT, DENSE = 3, 18, 6, 30, 12, 3

_TAG = re.compile(r"\[(/?)([a-z0-9*]+)(?:=[^\]\n]*)?\]", re.IGNORECASE)
_DENSE = re.compile("[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]")
_OPEN, _CLOSE = "([{（【「『《“«", ")]}）】」』》”»"
_LINK = re.compile(r"(?:https?://|www\.)\S+", re.IGNORECASE)
_BLANKS = re.compile(r"[ \t]*")
_NUMBERING = re.compile(r"\s*\d{1,3}[.)](?=\s)")


@dataclass
class Mark:
    """Something at a place in the text: a tag, a line end or the end of a sentence."""

    kind: str
    start: int
    end: int


def tag_at(text: str, at: int):
    """The tag that starts at a place, at most 200 characters and on one line."""
    found = _TAG.match(text, at)
    return found if found and found.end() - at <= 200 else None


def without_tags(text: str) -> str:
    return _TAG.sub("", text)


def weight(piece: str) -> int:
    """How much a piece says in Latin letters or their like; tags say nothing."""
    bare = without_tags(piece)
    return len(bare) + (DENSE - 1) * len(_DENSE.findall(bare))


def option_mark(line: str) -> bool | None:
    """Whether a line is a ticked option, an unticked one, or none (None)."""
    if not line:
        return None
    if line[0] in BALLOT_BOXES:
        return None if line[1:2] and line[1] in BALLOT_BOXES else line[0] in TICKED
    return True if line[0] in "xX" and line[1:2].isspace() else None


def says_nothing(claim: str) -> bool:
    """No word and no number, one letter alone, or one letter drawn again and again among marks."""
    plain = claim.replace(CENSORED, "")
    words = [c for c in plain if c.isalnum()]
    if not words or (len(words) == 1 and not _DENSE.match(words[0])):
        return True
    runs = re.findall(r"[^\W_]+", plain)
    return len(set(words)) == 1 and all(len(r) == 1 for r in runs) and not words[0].isnumeric() and not _DENSE.match(words[0])


def is_not_a_claim(text: str) -> bool:
    return option_mark(text.lstrip()) is False or says_nothing(text.strip())


def _drawn(line: str) -> bool:
    bare = line.strip()
    return bool(bare) and not any(c.isalnum() for c in bare)


def form_pieces(text: str) -> list[tuple[int, int]] | None:
    """The ticked options of a form, each from its heading on; None where the text isn't one."""
    lines, at = [], 0
    for line in text.splitlines(keepends=True):
        lines.append((at, at + len(line), line.strip()))
        at += len(line)
    if sum(x[:1] != "" and x[0] in BALLOT_BOXES for *_, x in lines if x) < BOXES_OF_A_FORM or not any(option_mark(x) for *_, x in lines):
        return None
    pieces, heading, answered = [], None, False
    for start, end, bare in lines:
        mark = option_mark(bare)
        if mark is None and bare and not _drawn(bare):
            if answered:
                heading, answered = None, False
            heading = start if heading is None else heading
        elif mark:
            pieces.append((start if heading is None else heading, end))
            answered = True
    if heading is not None and not answered:
        pieces.append((heading, len(text)))
    return pieces


def form_text(piece: str) -> str:
    """A form's heading and the last ticked option of the piece."""
    lines = piece.splitlines()
    last = max((k for k, x in enumerate(lines) if option_mark(x.strip())), default=None)
    return "\n".join(x for k, x in enumerate(lines) if x.strip() and not _drawn(x) and (option_mark(x.strip()) is None or k == last))


def _word_before(text: str, at: int) -> str:
    start = at
    while start and (text[start - 1].isalpha() or text[start - 1] == "."):
        start -= 1
    return text[start:at]


def _numbers_a_line(text: str, at: int) -> bool:
    """Whether all of the line before a place is a number of at most three digits."""
    digits = at
    while digits and text[digits - 1].isdigit() and at - digits < 4:
        digits -= 1
    if not 1 <= at - digits <= 3:
        return False
    while digits and text[digits - 1] in " \t":
        digits -= 1
    return not digits or text[digits - 1] == "\n"


def _spaced_word_before(text: str, at: int) -> str:
    """The word before a stop, in lower case, with one that a stop and blanks part from it: "т. е" as "т.е"."""
    word, start = _word_before(text, at), at
    start -= len(word)
    gap = start
    while gap and text[gap - 1] in " \t":
        gap -= 1
    if word and gap < start and gap and text[gap - 1] == ".":
        word = _word_before(text, gap) + word
    return word.lower()


def stop_holds(text: str, at: int) -> bool:
    """Whether the full stop at a place does not end a sentence."""
    nxt = text[at + 1 : at + 2]
    if nxt.isalnum():
        return True
    if nxt.isspace() and _numbers_a_line(text, at):
        return True
    word, spaced = _word_before(text, at), _spaced_word_before(text, at)
    low = word.lower()
    if low.replace(".", "") in ABBREVIATIONS or spaced in RUSSIAN_ABBREVIATIONS:
        return True
    follow = _BLANKS.match(text, at + 1).end()
    if spaced in RUSSIAN_BEFORE_A_CAPITAL:
        return text[follow : follow + 1].islower()
    # The first stop of a spaced form; the second one says whether it ends the sentence.
    if low == "т" and text[follow + 1 : follow + 2] == "." and f"т.{text[follow].lower()}" in RUSSIAN_ABBREVIATIONS | RUSSIAN_BEFORE_A_CAPITAL:
        return True
    return len(word) == 1 and word.isupper() and nxt == " " and text[follow : follow + 1].isupper() and (at == 1 or text[at - 2] in " (.")


def marks_of(text: str) -> list[Mark]:
    """Where points may end, in order."""
    found, at, depth, quoted = [], 0, 0, False
    links = [m.span() for m in _LINK.finditer(text)]
    opened = [a for a, _ in links]
    opens_a_line = True  # whether a heading may start here: after a line end, a sentence end or a breaking tag, blanks and other tags aside
    while at < len(text):
        c = text[at]
        if c == "[" and (tag := tag_at(text, at)):
            name = tag.group(2).lower()
            if name in BREAKING_TAGS or (re.fullmatch(r"h[1-3]", name) and not tag.group(1) and opens_a_line):
                found.append(Mark("tag", at, tag.end()))
            opens_a_line = opens_a_line or name in BREAKING_TAGS
            at = tag.end()
            continue
        if c not in " \t":
            opens_a_line = c == "\n" or c in TERMINATORS
        if c == "\n":
            found.append(Mark("line", at, at + 1))
            depth, quoted = 0, False
        elif c == '"':
            quoted = not quoted
        elif c in "“«„":
            quoted = True
        elif c in "”»":
            quoted = False
        elif c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth = max(0, depth - 1)
        elif c in TERMINATORS and not quoted and not depth and not ((k := bisect_right(opened, at)) and at < links[k - 1][1] - 1):
            end = at + 1
            while end < len(text) and text[end] in TERMINATORS:
                end += 1
            run = text[at:end]
            while end < len(text) and text[end] in _CLOSE + "\"'’":
                end += 1
            opens_a_line = text[end - 1] in TERMINATORS
            follow = without_tags(text[end : end + 40]).lstrip(" \t")
            wide = run[-1] in "。！？۔।"
            spaced = end >= len(text) or text[end].isspace() or text[end] == "[" or wide
            trailing = run in ("...", "…", "..") and follow[:1].islower()
            if spaced and not trailing and not (run == "." and stop_holds(text, at)):
                found.append(Mark("stop", at, end))
            at = end
            continue
        at += 1
    return found


def pieces_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, what ended it) of every piece."""
    out, start = [], 0
    for m in marks_of(text):
        if m.kind == "line" and without_tags(text[start : m.start]).rstrip().endswith((",", "，", "、")):
            continue
        out.append((start, m.start if m.kind == "tag" else m.end, m.kind))
        start = m.start if m.kind == "tag" else m.end
    out.append((start, len(text), "end"))
    return out


def tidied(text: str, start: int, end: int) -> tuple[int, int] | None:
    """A span without the blanks, bullets, numbering and tags around its words; None if nothing is left."""
    while start < end:
        piece = text[start:end]
        cut = len(piece) - len(piece.lstrip().lstrip(MARKERS))
        if not cut and (tag := tag_at(text, start)) and tag.end() <= end:
            cut = tag.end() - start
        if not cut and (number := _NUMBERING.match(piece)) and any(c.isalnum() for c in piece[number.end() :]):
            cut = number.end()
        if not cut:
            break
        start += cut
    while start < end:
        piece = text[start:end]
        short = piece.rstrip()
        if re.search(r"(?:^|\s)[-–—=_*~]{2,}$|[,，、]$", short):
            short = short.rstrip("-–—=_*~,，、 ")
        tags = list(_TAG.finditer(short))
        if tags and tags[-1].end() == len(short):
            short = short[: tags[-1].start()]
        if len(short) == len(piece):
            break
        end = start + len(short)
    return (start, end) if start < end else None


def listed(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """A list of three or more short parts of two words each, one span a part; else the span itself."""
    piece = text[start:end]
    if any(c in piece for c in _OPEN + _CLOSE + '"\n'):
        return [(start, end)]
    bounds, at = [], start
    for m in re.finditer("[,，、]", piece):
        bounds.append((at, start + m.start()))
        at = start + m.end()
    bounds.append((at, end))
    parts = [(a + len(text[a:b]) - len(text[a:b].lstrip()), b) for a, b in bounds]
    if len(parts) < 3:
        return [(start, end)]
    for a, b in parts:
        part = text[a:b]
        if not LEAST_PART <= weight(part) <= SHORT_PART or not (len(part.split()) >= 2 or len(_DENSE.findall(part)) >= 2):
            return [(start, end)]
    return parts


def is_an_emoticon(token: str) -> bool:
    letters = sum(c.isalnum() for c in token)
    aside = token[:1] in "(（" and token[1:2].isalpha() and not any(c in token for c in ")）")
    return 1 <= len(token) <= 4 and not aside and ((letters <= 1 and letters < len(token)) or token.lower() == "xd")


def joined(text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pieces too short to be a point joined to the one they belong to: answers back to their question, the rest forward."""
    out: list[list[int]] = []
    waiting = None
    for start, end in pieces:
        piece = text[start:end].strip()
        bare = without_tags(piece).strip()
        if waiting is None and out:
            before = text[out[-1][0] : out[-1][1]].rstrip()
            first, _, rest = bare.partition(" ")
            if is_an_emoticon(first) and "\n" not in text[out[-1][1] : start]:
                place = start + text[start:end].index(first) + len(first)
                out[-1][1] = place
                if not rest.strip():
                    continue
                start = place
                bare = rest.strip()
            elif before.endswith(("?", "？")) and weight(bare) <= SHORT_ANSWER and not bare.endswith(("?", "？")):
                out[-1][1] = end
                continue
        opening = start if waiting is None else waiting
        introduces = bare.endswith((":", "：")) or bool(re.fullmatch(r"[-*•]|\d{1,3}[.)]", bare))
        if weight(bare) < LEAST_WEIGHT or introduces:
            waiting = opening
            continue
        out.append([opening, end])
        waiting = None
    if waiting is not None:
        if out:
            out[-1][1] = pieces[-1][1]
        else:
            out.append([waiting, pieces[-1][1]])
    return [(a, b) for a, b in out]


def cleaned(text: str) -> str:
    """What a span says: no tags, blank options left out."""
    lines = [x for x in without_tags(text).split("\n") if option_mark(x.strip()) is not False]
    return "\n".join(lines).strip()


def split(text: str) -> list[tuple[int, int, str]]:
    """(start byte, end byte, claim) of every point, in order."""
    form = form_pieces(text)
    if form is not None:
        spans = [(s, form_text(text[s[0] : s[1]])) for s in (tidied(text, a, b) for a, b in form) if s]
    else:
        rough = []
        for start, end, _ in pieces_of(text):
            span = tidied(text, start, end)
            if span and (any(c.isalnum() for c in text[span[0] : span[1]]) or (rough and len(text[span[0] : span[1]]) <= 4)):
                rough.append(span)
        whole = joined(text, rough) if rough else []
        spans = [((a, b), cleaned(text[a:b])) for span in whole if (t := tidied(text, *span)) for a, b in listed(text, *t)]
    bytes_to = _byte_places(text, sorted({p for span, _ in spans for p in span}))
    return [(bytes_to[a], bytes_to[b], claim) for (a, b), claim in spans if claim and not says_nothing(claim)]


def _byte_places(text: str, places: list[int]) -> dict[int, int]:
    """The byte offset of each of some rising places, in one pass."""
    out, at, size = {}, 0, 0
    for place in places:
        size += len(text[at:place].encode("utf-8", "surrogatepass"))
        out[place], at = size, place
    return out


SCHEMA = "array<struct<start:bigint,end:bigint,claim:string>>"


def claims_column(text: Column) -> Column:
    """The claims of a text as an array of (start, end, claim), by Arrow batches."""

    @F.pandas_udf(SCHEMA)
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "claim": c} for a, b, c in split(t)] if isinstance(t, str) else [] for t in texts])

    return cut(text)


def exploded(df: DataFrame, text: str, *keep: str, deep: bool = True) -> DataFrame:
    """A row a claim with its place in the review; shallow takes each trimmed review as one claim."""
    if deep:
        rows = df.select(*keep, F.posexplode(claims_column(F.col(text))).alias("ord", "c"))
        return rows.select(*keep, "ord", "c.start", "c.end", "c.claim")
    whole = F.regexp_replace(F.col(text), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return df.select(*keep, F.lit(0).alias("ord"), F.lit(0).cast("long").alias("start"), F.octet_length(F.col(text)).cast("long").alias("end"), whole.alias("claim")).where("claim <> ''")


def same_words(marked: str, plain: str) -> bool:
    """Whether two texts are the same when each censor mark stands for any character."""
    return len(marked) == len(plain) and all(a == b or a == CENSORED for a, b in zip(marked, plain, strict=True))
