"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is parsed against it into phrases, each
the longest stretch that occurs in the labelled text; the fewer phrases, the lower the cross entropy. Phrase counts
are normalised by the text's length and the learned text's length, and the language that needs fewest wins.

Texts are parsed whole. Thousands of them advance together, a letter a step, through one transition table; a missing
transition restarts a phrase, which the table holds too, so a step is one look-up for each language. Every letter of
the learned text is a symbol of its own: the table holds as many of the commonest as its cells allow, and the
transitions of all others are kept sorted and searched, with the same result.

Scale: learning takes a bounded sample (``DOCUMENTS`` documents and ``LETTERS`` letters of every language that has
a row to learn from), cut on the map side by the rank of a hash, so a language with most of the rows is no hot task. Labelled text goes to the
workers, which build the tables once. Prediction is one pass over the documents with no shuffle.

Defined cases: null text and text without a letter get ``und`` and score 0; rows without a language teach nothing;
without any labelled row all get ``und``; ties go to the language first by code point; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DOCUMENTS = 60
LETTERS = 30_000
#: Letters of each text that are laid out at once, and texts that advance together.
BLOCK, TOGETHER = 256, 8192
#: Cells of a worker's table; letters beyond those that fit are searched.
CELLS = 40_000_000
#: Texts times languages below which a text is finished on its own.
ALONE = 64
#: Classes of characters: 0 for all that is no letter, 1 for letters that no labelled text has.
OTHER, UNKNOWN = 0, 1


class SuffixAutomaton:
    """The automaton of all stretches of a sequence of small numbers."""

    def __init__(self, symbols):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            last = cur

    def moves(self) -> np.ndarray:
        """(state, symbol, next state) of every transition."""
        found = [(state, c, to) for state, moves in enumerate(self.next) for c, to in moves.items()]
        return np.array(found, np.int64).reshape(-1, 3)


def is_letter(c: str) -> bool:
    return unicodedata.category(c)[0] == "L"


class Model:
    """Transitions of every language over one alphabet."""

    def __init__(self, learned: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in learned]
        seen = Counter(c for _, text in learned for c in text.lower() if is_letter(c))
        # The commonest letters have the smallest codes.
        codes = {c: k + 2 for k, c in enumerate(sorted(seen, key=lambda c: (-seen[c], c)))}
        self.width = 2 + len(codes)
        # One table for all of Unicode: letters are looked up once here, not a character.
        self.classes = np.full(0x110000, -1, np.int32)
        for c, k in codes.items():
            self.classes[ord(c)] = k
        self.size = np.array([max(2, len(text)) for _, text in learned], dtype=float)
        parts, base, at = [], [], 0
        for _, text in learned:
            machine = SuffixAutomaton(self.encode(text).tolist())
            moves = machine.moves()
            moves[:, 0] += at
            moves[:, 2] += at
            parts.append(moves)
            base.append(at)
            at += len(machine.next)
        self.base = np.array(base, np.int64)
        moves = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
        # The table holds next states multiplied by its width, and a flag where a phrase ends and the symbol starts another.
        d = self.dense = int(min(self.width, max(2, CELLS // max(1, at))))
        self.table = np.empty((at, d), np.int32)
        for k, first in enumerate(base):
            last = base[k + 1] if k + 1 < len(base) else at
            root = np.full(d, first, np.int64)
            own = moves[(moves[:, 0] == first) & (moves[:, 1] < d)]
            root[own[:, 1]] = own[:, 2]
            self.table[first:last] = root * d * 2 + 1
        held = moves[:, 1] < d
        self.table[moves[held, 0], moves[held, 1]] = moves[held, 2] * d * 2
        self.table = self.table.ravel()
        rare = moves[~held]
        keys = rare[:, 0] * self.width + rare[:, 1]
        order = np.argsort(keys)
        self.keys, self.to = np.append(keys[order], np.iinfo(np.int64).max), np.append(rare[order, 2], 0)

    def encode(self, text: str) -> np.ndarray:
        """Classes of a lower-cased text; runs of characters that are no letters become one."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        out = self.classes[points]
        if (new := points[out == -1]).size:
            for p in np.unique(new).tolist():
                self.classes[p] = UNKNOWN if is_letter(chr(p)) else OTHER
            out = self.classes[points]
        return out[~((out == OTHER) & (np.concatenate(([OTHER], out[:-1])) == OTHER))] if out.size else out

    def _searched(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Moves, as the table holds them, by symbols beyond the table: states are (language, text), not multiplied."""
        found = None
        for start in (states, np.broadcast_to(self.base[:, None], states.shape)):
            key = start * self.width + symbols
            at = np.searchsorted(self.keys, key)
            hit = self.keys[at] == key
            move = self.to[at] * (2 * self.dense)
            # First from the state itself, then, a phrase later, from the root; a symbol unknown there leaves the root.
            found = (hit, move) if found is None else np.where(found[0], found[1], np.where(hit, move + 1, self.base[:, None] * (2 * self.dense) + 1))
        return found

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrase counts, (text, language)."""
        counts = np.zeros((len(texts), len(self.names)), np.int64)
        order = sorted((k for k, t in enumerate(texts) if len(t)), key=lambda k: -len(texts[k]))
        for a in range(0, len(order), TOGETHER):
            part = order[a : a + TOGETHER]
            sizes = np.array([len(texts[k]) for k in part])
            state = np.repeat((self.base * self.dense).astype(np.int32)[:, None], len(part), axis=1)
            ends = np.ones((len(self.names), len(part)), np.int64)
            for start in range(0, int(sizes[0]), BLOCK):
                n = int(np.searchsorted(-sizes, -start, side="left"))
                if n * len(self.names) <= ALONE:
                    for j in range(n):
                        self._finish(texts[part[j]][start:], state[:, j], ends[:, j])
                    break
                self._advance([texts[k][start : start + BLOCK] for k in part[:n]], state[:, :n], ends[:, :n])
            counts[part] = ends.T
        return counts

    def _advance(self, pieces: list[np.ndarray], state: np.ndarray, ends: np.ndarray) -> None:
        """Moves all texts, longest first, over a piece of each."""
        sizes = np.array([len(p) for p in pieces])
        grid = np.zeros((sizes[0], len(pieces)), np.int32)
        for j, p in enumerate(pieces):
            grid[: len(p), j] = p
        live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        rare = (grid >= self.dense).any(axis=1) if self.dense < self.width else np.zeros(sizes[0], bool)
        for step in range(sizes[0]):
            n = live[step]
            symbols = grid[step, :n]
            if rare[step]:
                beyond = np.flatnonzero(symbols >= self.dense)
                searched = self._searched((state[:, beyond] // self.dense).astype(np.int64), symbols[beyond].astype(np.int64))
                move = self.table[state[:, :n] + np.where(symbols < self.dense, symbols, 0)]
                move[:, beyond] = searched
            else:
                move = self.table[state[:, :n] + symbols]
            ends[:, :n] += move & 1
            state[:, :n] = move >> 1

    def _finish(self, text: np.ndarray, state: np.ndarray, ends: np.ndarray) -> None:
        """Moves one text to its end, a language at a time."""
        table, d, width, symbols = memoryview(self.table), self.dense, self.width, text.tolist()
        for k, base in enumerate(self.base.tolist()):
            s, n = int(state[k]), 0
            for c in symbols:
                if c < d:
                    move = table[s + c]
                else:
                    move = -1
                    for start, flag in ((s // d, 0), (base, 1)):
                        at = int(np.searchsorted(self.keys, start * width + c))
                        if self.keys[at] == start * width + c:
                            move = int(self.to[at]) * 2 * d + flag
                            break
                    if move < 0:
                        move = base * 2 * d + 1
                n += move & 1
                s = move >> 1
            state[k], ends[k] = s, ends[k] + n


@lru_cache(maxsize=2)
def model_of(learned: tuple[tuple[str, str], ...]) -> Model:
    return Model(learned)


def learned_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", learn=None,
                 documents: int = DOCUMENTS, letters: int = LETTERS) -> tuple[tuple[str, str], ...]:
    """(language, text) of the bounded sample: the documents of smallest hash of each language."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if learn is not None:
        rows = rows.where(learn(F.col("doc_id")))
    draw = F.md5(F.concat(F.lit("lang:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    # Texts that would be most of the sample alone come last, so that no one document is all that is learned.
    most = max(1, letters // 4)
    rows = rows.select("lang", "doc_id", draw.alias("draw"), (F.length("text") > most).alias("long"), F.substring("text", 1, letters).alias("text"))
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("long", "draw", "doc_id", "text")))
    ranked = ranked.where(F.col("place") <= documents)
    # Texts that start past the letters of their language add nothing and are not sent.
    before = F.sum(F.length("text")).over(W.partitionBy("lang").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    ranked = ranked.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < letters)
    found: dict[str, list[str]] = {}
    for r in ranked.select("lang", "place", "text").orderBy("lang", "place").collect():  # under twice `letters` a language
        found.setdefault(r["lang"], []).append(r["text"])
    return tuple((name, "\n".join(found[name])[:letters]) for name in sorted(found))


def identified(docs: DataFrame, learned: tuple[tuple[str, str], ...], text: str = "text") -> DataFrame:
    """docs with ``found``, a struct of lang, score, and the normalised phrase rate of each language."""
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    @F.pandas_udf("struct<lang:string,score:double,rates:array<double>>")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        model = model_of(sent.value)
        coded = [model.encode(t) if isinstance(t, str) else np.zeros(0, np.int32) for t in texts]
        known = np.array([bool(len(model.names)) and bool((c != OTHER).any()) for c in coded], bool)
        coded = [c if k else c[:0] for c, k in zip(coded, known, strict=True)]
        length = np.array([max(1, len(c)) for c in coded], float)
        # Phrases times the bits that name a place in the learned text, for each letter.
        rates = model.phrases(coded) * np.log2(model.size)[None, :] / length[:, None] if model.names else np.zeros((len(coded), 0))
        lang, score = [], []
        for k, r in zip(known, rates, strict=True):
            if not k:
                lang.append("und")
                score.append(0.0)
                continue
            lang.append(model.names[int(np.argmin(r))])
            like = np.exp2(-4.0 * (r - r.min()))
            score.append(float(1.0 / like.sum()))
        return pd.DataFrame({"lang": lang, "score": score, "rates": [r.tolist() if k else [] for k, r in zip(known, rates, strict=True)]})

    return docs.withColumn("found", predicted(F.col(text)))
