"""Words of many texts at once, as 64-bit hashes, with numpy.

A word is a maximal run of bytes above the space (0x20); ASCII letters count in lower case.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit numbers of the given seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * _STEP + U(seed) * U(0xD1342543DE82EF95))


class Found:
    """Looks 64-bit hashes up among few."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.keys, self.values = hashes[order], values[order]
        bits = min(24, max(12, len(hashes).bit_length() + 4))
        self.shift = U(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(hashes >> self.shift).astype(np.intp)] = True

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are there, and their values."""
        at = np.flatnonzero(self.seen[(h >> self.shift).astype(np.intp)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), max(0, len(self.keys) - 1))
        ok = self.keys[k] == h[at]
        return at[ok], self.values[k[ok]]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = stream(1, 256)[_LOWER]
_BASE = int(stream(2, 1)[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[U(1)], np.full(n, U(base))]), dtype=U)


_cache: dict[str, np.ndarray] = {"up": _powers(_BASE, 1 << 12), "down": _powers(_INVERSE, 1 << 12)}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache["up"]) < n:
        if n > 1 << 24:  # a very long text: not kept
            return _powers(_BASE, n), _powers(_INVERSE, n)
        _cache.update(up=_powers(_BASE, 2 * n), down=_powers(_INVERSE, 2 * n))
    return _cache["up"], _cache["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text begins and the last ends."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Words:
    hashes: np.ndarray  # of all words of all texts
    begins: np.ndarray  # of each word, in the bytes
    ends: np.ndarray
    first: np.ndarray  # of each text: its first word; one more at the end
    raw: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(column: pa.Array) -> Words:
    raw, at = text_bytes(column)
    inside = raw > 32
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = at[:-1][np.diff(at) > 0]
    opens[edges] = inside[edges]
    closes[edges[1:] - 1] = inside[edges[1:] - 1]
    begins, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[U(0)], np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=U)])
        hashes = mix((sums[ends] - sums[begins]) * down[begins])
    return Words(hashes, begins, ends, np.searchsorted(begins, at), raw)


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each text, and each one's text.

    A text of fewer words has one shingle of all its words; one without words has none.
    """
    h, n = w.hashes, len(w.hashes)
    factors = stream(3, size) | U(1)
    owner = w.owner()
    with np.errstate(over="ignore"):
        run = np.zeros(max(0, n - size + 1), U)
        for k in range(size):
            run += h[k : n - size + 1 + k] * factors[k]
        whole = owner[: len(run)] == owner[size - 1 :] if len(run) else np.zeros(0, bool)
        out, of = mix(run[whole]), owner[: len(run)][whole]
        short = np.flatnonzero((w.counts > 0) & (w.counts < size))
        if len(short):
            one = [mix(np.sum(h[w.first[d] : w.first[d + 1]] * factors[: w.counts[d]], dtype=U)[None])[0] for d in short]
            out, of = np.concatenate([out, np.array(one, U)]), np.concatenate([of, short])
            order = np.argsort(of, kind="stable")
            out, of = out[order], of[order]
    return out, of
