"""Anchors of long repeats: positions that two equal strings of a given length must share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ._words import U, _powers, mix, stream, text_bytes, words

BYTES, WORDS = "bytes", "words"
WIDTH = {BYTES: 1, WORDS: 8}  # bytes that stand for one sign

_SPREAD = stream(41, 512).reshape(2, 256)
_SALT = stream(43, 2)
_BASES = [int(x) | 1 for x in stream(42, 2)]
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _scales(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _tables.get(which)
    if got is None or len(got[0]) < n:
        base = _BASES[which]
        got = _powers(base, n), _powers(pow(base, -1, 1 << 64), n)
        if n <= 1 << 23:
            _tables[which] = got
    return got


def signs(column: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """The signs of all texts, where each text begins and the last ends: bytes, or hashes of words."""
    if unit == BYTES:
        return text_bytes(column)
    w = words(column)
    return w.hashes, w.first


class Rolling:
    """Hashes of any runs of signs in constant time."""

    def __init__(self, raw: np.ndarray, which: int):
        up, self.down = _scales(which, len(raw) + 1)
        spread = _SPREAD[which][raw] if raw.dtype == np.uint8 else mix(raw ^ _SALT[which])
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[U(0)], np.cumsum(spread * up[: len(raw)], dtype=U)])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(U))


def least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    done, out = 1, x
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - done :][: len(x) - width + 1]) if done < width else out


REPEATS = 4


def inside_runs(h: np.ndarray, p: np.ndarray, gram: int) -> np.ndarray:
    """For each anchor ``p`` the period of the text around it, if its gram comes again at that
    distance, of at most ``gram``, :data:`REPEATS` times on either side; else 0."""
    gap = np.zeros(len(p), np.int64)
    near = (np.diff(p) <= gram) & (h[p[1:]] == h[p[:-1]])
    gap[:-1][near] = np.diff(p)[near]
    for k in range(1, REPEATS + 1):
        at = np.flatnonzero(gap)
        low, high = p[at] - k * gap[at], p[at] + k * gap[at]
        ok = (low >= 0) & (high < len(h))
        at_low, at_high = np.where(ok, low, 0), np.where(ok, high, 0)
        gap[at[~(ok & (h[at_low] == h[p[at]]) & (h[at_high] == h[p[at]]))]] = 0
    return gap


def anchors(raw: np.ndarray, at: np.ndarray, span: int, gram: int):
    """From :func:`signs`. For texts of ``span`` signs and more: text, place, hash of the anchor's ``gram`` signs, and
    128 bits for its surroundings (``span - gram`` signs before it to ``span`` after its start; 0
    where the text is too short for that). And, of periodic runs: text, begin, end.

    An anchor is the place of the least hash among the grams of some ``span`` signs. Two equal
    strings of ``span`` signs have equal grams, so both have an anchor at the same place.

    Where text repeats itself with a short period, each period has an anchor. Those with
    :data:`REPEATS` equal grams on both sides are left out. Strings of ``span`` signs that have no
    other anchors lie in the run and are equal to their neighbours a period on, so the run stands
    for them; strings that reach over an end of a run hold its first or last grams, and strings
    in a run too short for a shift hold one of its first grams, all of which stay.
    """
    one, two = Rolling(raw, 0), Rolling(raw, 1)
    width = span - gram + 1
    found, runs = [], []
    for d in np.flatnonzero(np.diff(at) >= span):
        begins = np.arange(at[d], at[d + 1] - gram + 1)
        h = one.of(begins, begins + gram)
        # A gram is an anchor if it is the minimum of a window that holds it.
        p = np.flatnonzero(h == _most_in_windows(least_in_windows(h, width), width, len(h)))
        gap = inside_runs(h, p, gram)
        if gap.any():
            left_out = np.flatnonzero(gap)
            new = np.append(True, (np.diff(left_out) > 1) | (np.diff(gap[left_out]) != 0) | (h[p[left_out[1:]]] != h[p[left_out[:-1]]]))
            first, last = left_out[new], left_out[np.append(np.flatnonzero(new)[1:] - 1, len(left_out) - 1)]
            b, e = p[first] - REPEATS * gap[first], p[last] + REPEATS * gap[first] + gram
            long = e - b >= span + gap[first]
            runs.append((np.full(int(long.sum()), d), b[long], e[long]))
            p = p[gap == 0]
        found.append((np.full(len(p), d), p, h[p]))
    z = np.zeros(0, np.int64)
    run = tuple(np.concatenate(x) for x in zip(*runs)) if runs else (z, z, z)
    if not found:
        return z, z, z.view(U), z.view(U), z.view(U), run
    of, p, h = (np.concatenate(x) for x in zip(*found))
    size = np.diff(at)[of]
    whole = (p >= span - gram) & (p + span <= size)
    lo, hi = at[of] + np.where(whole, p - (span - gram), p), at[of] + np.where(whole, p + span, p)
    return of, p, h, np.where(whole, one.of(lo, hi) | U(1), U(0)), np.where(whole, two.of(lo, hi), U(0)), run


def _most_in_windows(low: np.ndarray, width: int, n: int) -> np.ndarray:
    """For each of ``n`` grams the largest of the minima of the windows that hold it."""
    pad = np.zeros(width - 1, U)
    return ~least_in_windows(~np.concatenate([pad, low, pad]), width)[:n]
