"""Terms of a claim: words and neighbouring pairs, and merging of terms that say the same."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say nothing alone, and words of degree and time that say little; an English default, and a parameter wherever it is used.
FILLER = frozenset((
    *"a am an and any are as at be been but by can could did do does for from game games get got had has have he her his how i i'm i've if in into is it it's its just me my of one or our out she so some than that that's the".split(),
    *"their them then there these they they're this to up us was we were what when which who will with would you you're your".split(),
    *"very really quite pretty even much many most all each every both few such own other another same thing things also like lot lots bit way because while though although since until before after again down back now ever yet far".split()))
# Words that turn what follows, by language (English, German, Russian and Ukrainian, Spanish and Portuguese, French, Italian, Polish and Czech,
# Turkish, Korean), the characters that do so in Chinese, and what Korean writes on the end of a word, particles and endings, longest first.
MODIFIERS = frozenset((
    "no", "not", "never", "without", "too", "on", "off", "less", "more", "only", "still", "always", "can't", "cannot", "don't", "doesn't", "didn't", "won't", "wouldn't", "couldn't", "shouldn't", "isn't", "wasn't",
    "nicht", "kein", "keine", "keinen", "ohne", "nie", "zu", "sehr",
    "не", "нет", "без", "нельзя", "слишком", "очень",
    "sin", "sem", "não", "nunca", "demasiado", "muy", "muito",
    "pas", "sans", "jamais", "trop",
    "non", "senza", "mai", "troppo",
    "bez", "zbyt",
    "değil", "yok", "çok",
    "안", "못"))
HAN_MODIFIERS = frozenset(("不", "没", "无", "太", "很", "更", "最", "超", "不太", "不够", "超级"))
PARTICLES = ("에서는", "에서도", "으로는", "으로도", "에서", "으로", "부터", "까지", "에게", "한테", "처럼", "만큼", "보다", "이나", "라도", "이", "가", "은", "는", "을", "를", "도", "의", "에", "로", "만")
KOREAN_ENDINGS = (
    "했습니다", "됐습니다", "받았습니다", "습니다", "했어요", "됐어요", "합니다", "됩니다", "하네요", "했다가", "하는데", "했는데", "하면서", "하고", "하는", "하다", "했다", "해서", "해요", "하게", "하지",
    "되는", "되다", "됐다", "이다", "네요", "어요", "아요", "었다", "았다")
ENDINGS = frozenset(("", "s", "es", "ed", "ing"))
SHOWN, LEAST_REVIEWS = 8, 5

_WORD = re.compile(r"[^\W_](?:[^\W_]|['’])*")
_HANGUL = re.compile("[가-힣]+")
_SPACELESS = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_HAN = re.compile("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+")
_PIECE = re.compile(rf"(?P<run>[{_SPACELESS}]+)|(?P<word>[^\W_{_SPACELESS}](?:[^\W_{_SPACELESS}]|['’])*)|(?P<gap>[\s\-]+)|(?P<mark>.)", re.DOTALL)
_SMALL_CAPITALS = str.maketrans("ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ", "abcdefghijklmnoprstuvwyz")

Segmenter = Callable[[str], Iterable[str]]


def plain(text: str) -> str:
    """Small capitals as letters."""
    return text.translate(_SMALL_CAPITALS)


def without_suffix(word: str, suffixes: tuple[str, ...]) -> str:
    """A word without the first suffix it ends on that leaves two characters."""
    return next((word[: -len(s)] for s in suffixes if word.endswith(s) and len(word) - len(s) >= 2), word)


def without_particle(word: str) -> str:
    """A Korean word without its particle and then its ending."""
    return without_suffix(without_suffix(word, PARTICLES), KOREAN_ENDINGS) if _HANGUL.fullmatch(word) else word


def by_dictionary(words: Iterable[str]) -> Segmenter:
    """A segmenter for Chinese: from the left the longest word of a dictionary, else one character."""
    known = frozenset(words) | HAN_MODIFIERS
    longest = max(map(len, known))

    def cut(run: str):
        at = 0
        while at < len(run):
            n = next((n for n in range(min(longest, len(run) - at), 1, -1) if run[at : at + n] in known), 1)
            yield run[at : at + n]
            at += n

    return cut


def _character_pairs(run: str, filler: frozenset[str]) -> list[str]:
    """Neighbouring characters; a filler pair is left out, and so is the pair that starts on its second character."""
    out, start = [], 0
    while start + 2 <= len(run):
        pair = run[start : start + 2]
        if pair in filler:
            start += 2
            continue
        out.append(pair)
        start += 1
    return out


def _han_terms(words: Iterable[str], filler: frozenset[str]) -> list[str]:
    """Words of a Chinese run and solid pairs: a modifier leads the pair after it, lone characters are heard in pairs only."""
    out, lead, leads_as = [], "", ""  # leads_as: modifier, lone or word
    for word in words:
        if word in HAN_MODIFIERS:
            lead, leads_as = (lead + word if leads_as == "modifier" else word), "modifier"
            continue
        if word in filler:
            lead = leads_as = ""
            continue
        whole = len(word) >= 2
        if whole:
            out.append(word)
        if lead and not (whole and leads_as == "lone"):
            out.append(lead + word)
        lead, leads_as = word, "word" if whole else "lone"
    return out


def terms(claim: str, filler: frozenset[str] = FILLER, modifiers: frozenset[str] = MODIFIERS, segment: Segmenter | None = None) -> list[str]:
    """Each term once, in order: words, pairs that only blanks or a hyphen part, what a modifier before a pair makes of it, and terms of spaceless scripts.

    A run of Chinese alone goes through ``segment``; without one, and where a run holds kana, its pairs of characters are the terms.
    """
    found: list[str] = []
    before = turning = ""  # the word before, and the modifier before that
    for m in _PIECE.finditer(plain(claim)):
        if m["gap"]:
            continue
        if m["run"]:
            run = m["run"]
            found += _han_terms(segment(run), filler) if segment and _HAN.fullmatch(run) else _character_pairs(run, filler)
        word = without_particle(m["word"].lower().replace("’", "'").strip("'")) if m["word"] else ""
        if len(word) < 2 or (word.isascii() and word.isdigit()):
            before = turning = ""
            continue
        if word in modifiers:
            before, turning = word, ""
        elif word in filler:
            before = turning = ""
        else:
            pair = f"{before} {word}" if before else None
            found += [t for t in (word, pair, f"{turning} {pair}" if pair and turning else None) if t]
            before, turning = word, before if before in modifiers else ""
    return list(dict.fromkeys(found))


def terms_column(text: Column, filler: frozenset[str] = FILLER, segment: Segmenter | None = None) -> Column:
    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([terms(t, filler, MODIFIERS, segment) if isinstance(t, str) else [] for t in texts])

    return of(text)


def mentions(claim: str, term: str) -> bool:
    return term in terms(claim)


def own_names(subject: str, label: str, also: Iterable[str] = ()) -> frozenset[str]:
    """The words that a subject is called by, none of which is one of its terms: those of its label, its id, and its names elsewhere."""
    return frozenset((*(w.lower() for w in re.findall(r"[^\W_]+", label)), subject.lower(), *also))


def one_inflected(left: str, right: str) -> bool:
    """Whether two terms are one word with different endings, after three characters or more that they share."""
    shared = next((n for n, (a, b) in enumerate(zip(left, right, strict=False)) if a != b), min(len(left), len(right)))
    rest = {left[shared:], right[shared:]}
    return left != right and len(left[:shared].encode()) >= 3 and (rest <= ENDINGS or rest == {"y", "ies"})


def alike(left: str, right: str) -> bool:
    """Whether one term is a whole word of the other, or a phrase that the other begins or ends with."""
    if _HAN.fullmatch(left) and _HAN.fullmatch(right):
        return left in right or right in left
    short, long = sorted((left, right), key=lambda t: len(t.encode()))
    return short in long.split(" ") or (" " in short and (long.startswith(short + " ") or long.endswith(" " + short)))


def nearly(left: int, right: int) -> bool:
    """Whether each count is at least nineteen twentieths of the other."""
    return left * 20 >= right * 19 and right * 20 >= left * 19


def turned(term: str) -> bool:
    return term.split(" ")[0] in MODIFIERS


def _paired_script(c: str) -> bool:
    return bool(re.match(f"[{_SPACELESS}가-힣]", c))


def _run_of(kept: str, pair: str) -> str | None:
    """A run of characters with a pair that overlaps one of its ends joined on; None where they don't overlap."""
    if len(pair) != 2 or not all(map(_paired_script, pair)) or _HAN.fullmatch(pair):
        return None
    return kept + pair[1] if kept.endswith(pair[0]) else pair[0] + kept if kept.startswith(pair[1]) else None


class Shown:
    """The terms of one side that are shown, taken from candidates that come most distinctive first."""

    def __init__(self, most: int = SHOWN):
        self.most, self.kept = most, []  # [term, reviews, z]

    @property
    def full(self) -> bool:
        return len(self.kept) >= self.most

    def offer(self, term: str, reviews: int, z: float) -> None:
        for row in self.kept:
            if alike(row[0], term):
                self._phrase(row, term, reviews)
                return
        for row in self.kept:
            if one_inflected(row[0], term):
                if reviews > row[1]:
                    row[:2] = term, reviews
                return
        for row in self.kept:
            if nearly(reviews, row[1]) and (longer := _run_of(row[0], term)):
                row[:2] = longer, min(reviews, row[1])
                return
        self.kept.append([term, reviews, z])

    def _phrase(self, row: list, term: str, reviews: int) -> None:
        """A phrase takes the place of a part of it that is not much commoner; one that a modifier turns, already at half."""
        says_other = turned(term) and (not turned(row[0]) or term.startswith(row[0]))
        if row[0] in term and (nearly(reviews, row[1]) or (says_other and 2 * reviews >= row[1])):
            row[:2] = term, reviews
            self.kept = [r for r in self.kept if r is row or r[0] == term or not alike(r[0], term)]

    def done(self) -> list[tuple[str, int, float]]:
        """What is shown; runs of one word that came out in two pieces are one."""
        rows = list(self.kept)
        for row in rows:
            while row[0] and (tail := next((r for r in rows if r is not row and r[0] and nearly(row[1], r[1]) and _paired_script(r[0][0]) and not _HAN.match(r[0][0]) and row[0].endswith(r[0][0])), None)):
                row[:2] = row[0] + tail[0][1:], min(row[1], tail[1])
                tail[0] = ""
        return [tuple(r) for r in rows if r[0]]


def merged(found: list[tuple[str, int, float]], shown: int = SHOWN) -> list[tuple[str, int, float]]:
    """The terms shown of (term, reviews, z); on a tie more reviews and then the longer term come first."""
    out = Shown(shown)
    for term, reviews, z in sorted(found, key=lambda t: (-t[2], -t[1], -len(t[0].encode()), t[0])):
        if out.full:
            break
        out.offer(term, reviews, z)
    return out.done()


def merged_terms(df: DataFrame, by: list[str], shown: int = SHOWN) -> DataFrame:
    """merged() within each group of (by, term, reviews, z): all candidates pass by in order, and only the terms shown are held."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"{b} {kinds[b]}" for b in by], "term string", "reviews long", "z double", "place int"])
    columns = [*by, "term", "reviews", "z"]

    def run(batches):
        now, out = None, None
        for batch in batches:
            rows = []
            for *group, term, reviews, z in zip(*(batch[c] for c in columns), strict=True):
                if group != now:
                    rows += listing(now, out)
                    now, out = group, Shown(shown)
                if not out.full:
                    out.offer(term, int(reviews), z)
            if rows:
                yield frame(rows)
        if rows := listing(now, out):
            yield frame(rows)

    def listing(group, out):
        return [] if out is None else [(*group, *row, k + 1) for k, row in enumerate(out.done())]

    def frame(rows):
        return pd.DataFrame(rows, columns=[*columns, "place"])

    order = [*by, F.desc("z"), F.desc("reviews"), F.desc(F.octet_length("term")), "term"]
    return df.select(*columns).repartition(*by).sortWithinPartitions(*order).mapInPandas(run, schema)
