"""Words and signs of many texts at once, by code points, with numpy: what toxicity is read from.

A word is a maximal run of letters and decimal digits. Digits and the signs ``@ $ *`` between two
letters belong to the word as disguised letters: see :data:`LEET`; a star stands for none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from ._words import U, _tables, mix, stream

LETTER, DIGIT, UPPER, PUNCT, SYMBOL, DISGUISE = 1, 2, 4, 8, 16, 32
# Signs that stand for letters in disguised words.
LEET = dict(zip("013457@$", "oieastas"))
PUNCTUATION, SYMBOLS, DISGUISES = ".,;:'\"()!?-", "#$%&*@^~|<>+=_", "0123456789@$*"
TOP = 0x30000  # code points from here on are neither letters nor signs
PIECE = 1 << 20  # code points of a text looked at together
OPENINGS = (4, 5, 6)
_OPENING = stream(51, 7)


@dataclass
class Tables:
    kinds: np.ndarray
    lower: np.ndarray
    spread: np.ndarray


@lru_cache(maxsize=1)
def tables() -> Tables:
    kinds, lower = np.zeros(TOP + 1, np.uint8), np.arange(TOP + 1, dtype=np.uint32)
    for i, c in enumerate(map(chr, range(TOP))):
        kinds[i] = (LETTER if c.isalpha() else 0) | (DIGIT if c.isdecimal() else 0) | (UPPER if c.isupper() else 0)
        if kinds[i] & UPPER and len(c.lower()) == 1:
            lower[i] = ord(c.lower())
    for signs, kind in ((PUNCTUATION, PUNCT), (SYMBOLS, SYMBOL), (DISGUISES, DISGUISE)):
        kinds[[ord(c) for c in signs]] |= kind
    return Tables(kinds, lower, stream(50, TOP + 1))


@dataclass
class Letters:
    """Texts one after the other, each followed by a line break."""

    cp: np.ndarray
    kinds: np.ndarray
    low: np.ndarray
    starts: np.ndarray  # of each text
    disguised: np.ndarray  # where disguises between two letters begin
    begin: np.ndarray  # of each word
    end: np.ndarray
    first: np.ndarray  # of each word, among the signs that count
    size: np.ndarray
    sums: np.ndarray
    down: np.ndarray

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def per_text(self, kind: int) -> np.ndarray:
        return np.add.reduceat((self.kinds & kind) > 0, self.starts, dtype=np.int64)

    def hashes(self, opening: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Of all words, or of the first letters of those that are longer; and which words."""
        at = np.flatnonzero(self.size > opening)
        b, n = self.first[at], np.full(len(at), opening) if opening else self.size[at]
        with np.errstate(over="ignore"):
            return mix((self.sums[b + n] - self.sums[b]) * self.down[b] + _OPENING[opening]), at


def letters(texts: list[str]) -> Letters:
    t = tables()
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])[:-1]]).astype(np.int64)
    cp = np.minimum(np.frombuffer("".join(x + "\n" for x in texts).encode("utf-32-le", "surrogatepass"), np.uint32), TOP)
    kinds, low = t.kinds[cp], t.lower[cp]
    letter, disguise = (kinds & LETTER) > 0, np.flatnonzero(kinds & DISGUISE)
    new = np.append(True, np.diff(disguise) > 1)[: len(disguise)]
    a, b = disguise[new], disguise[np.append(new[1:], True)[: len(disguise)]] + 1
    ok = (a > 0) & letter[a - 1] & letter[b]
    a, b = a[ok], b[ok]
    edge = np.zeros(len(cp) + 1, np.int8)
    edge[a], edge[b] = 1, -1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    word = letter | ((kinds & DIGIT) > 0) | inside
    sign = low
    if len(a):
        sign = low.copy()
        for c, stands in LEET.items():
            sign[inside & (cp == ord(c))] = ord(stands)
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    counts = np.flatnonzero(word & ~(inside & (cp == ord("*"))))
    first = np.searchsorted(counts, begin)
    up, down = _tables(len(counts) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[U(0)], np.cumsum(t.spread[sign[counts]] * up[: len(counts)], dtype=U)])
    return Letters(cp, kinds, low, starts, a, begin, end, first, np.diff(np.append(first, len(counts))), sums, down)


def pieces(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Texts cut at spaces into pieces of at most :data:`PIECE` code points, and each one's text."""
    out, of = [], []
    for i, t in enumerate(texts):
        at, t = 0, t or ""
        while len(t) - at > PIECE:
            cut = t.rfind(" ", at + PIECE // 2, at + PIECE)
            cut = at + PIECE if cut < 0 else cut
            out.append(t[at:cut])
            of.append(i)
            at = cut
        out.append(t[at:])
        of.append(i)
    return out, np.array(of, np.int64)


def term_hash(term: str) -> np.ndarray:
    """Of a word, or with ``~`` at the end of the opening of longer ones."""
    x = letters([term.rstrip("~") + ("a" if term.endswith("~") else "")])
    return x.hashes(len(term) - 1 if term.endswith("~") else 0)[0]
