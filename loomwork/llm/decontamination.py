"""Benchmark decontamination: pieces with at most one edit, a tree of checks, exact edit distance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import row_slices, written

LEAK = "struct<item_id:long,distance:int,start:int,length:int>"
BASE = 0x9E3779B1
INVERSE = pow(BASE, -1, 1 << 32)
WORD = 64  # signs of the longest part that is checked before the whole item


def normal(text: str | None) -> str:
    """Lower case, with one space for each run of white space."""
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def nearest(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to a substring of ``text``, and where that ends."""
    m = len(pattern)
    if not m:
        return 0, 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (full & ~(xh | up)), up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up, down = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


@dataclass
class Lookup:
    """Strings of one length that pieces become, by hash."""

    size: int  # signs of a window of text
    holes: list[int]  # which sign to leave out
    by_hole: bool  # text and piece leave out the same one
    shift: int
    seen: np.ndarray  # by the upper bits of the hash
    first: np.ndarray  # of these bits: where their hashes begin
    hashes: np.ndarray  # sorted
    piece: np.ndarray


@dataclass
class Index:
    """Benchmark items, their pieces, and the parts of items that are checked from a piece upwards."""

    ids: list[int]
    texts: list[str]
    allowed: np.ndarray  # edits
    length: np.ndarray
    lookups: list[Lookup]
    item: np.ndarray  # of each piece
    place: np.ndarray
    ups: np.ndarray  # level, piece: the part of that level that holds the piece, or -1
    begin: np.ndarray  # of each part, in its item
    width: np.ndarray
    edits: np.ndarray  # of each part at most
    masks: np.ndarray  # part, kind of sign: where the part has it
    rest: np.ndarray  # of each piece: width, edits at most, place in its item, of what the smallest part has besides; width 0: nothing
    rest_masks: np.ndarray  # piece, kind of sign: where the rest has it


def _kind(cp: np.ndarray) -> np.ndarray:
    return ((cp * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.intp)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint32(1)], np.full(n, base, np.uint32)]), dtype=np.uint32)


HOLE = np.uint32(0x27D4EB2F)


def _holed(cp: np.ndarray, size: int, holes: list[int], up: np.ndarray, down: np.ndarray, by_hole: bool = False):
    """Hashes of all windows of ``size`` signs, each without the sign at one place, hole by hole;
    with ``by_hole`` those of different places have nothing in common."""
    v = (cp + np.uint32(1)) * np.uint32(0x85EBCA6B)
    v ^= v >> np.uint32(15)
    n = len(cp) - size + 1
    if n <= 0:
        return
    sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum(v * up[: len(v)], dtype=np.uint32)])
    step = (v[:-1] - v[1:]) * up[: len(v) - 1]
    h = (sums[size : size + n] - sums[1 : 1 + n]) * np.uint32(INVERSE)
    scale = down[:n] * np.uint32(0xC2B2AE35)
    for j in range(max(holes) + 1):
        if j in holes:
            x = h * scale
            if by_hole:
                x += np.uint32(((j + 1) * int(HOLE)) & 0xFFFFFFFF)
            yield x
        if j + 1 < size:
            h += step[j : j + n]


def _tree(lo: int, hi: int, above: list, out: list) -> None:
    """For each of the pieces ``lo`` to ``hi``: the ranges of pieces that hold it, smallest first."""
    if hi - lo == 1:
        out.append(above[::-1])
        return
    mid = (lo + hi) // 2
    _tree(lo, mid, [*above, (lo, hi)], out)
    _tree(mid, hi, [*above, (lo, hi)], out)


def build(items: list[tuple[int, str]], max_edits: float) -> Index:
    """An item of k allowed edits is cut into k // 2 + 1 pieces. A passage within k edits has at most
    2c - 1 of them in the whole of c pieces, so in one of its halves too, and so on down: some piece
    has at most one edit, and each part on the way up to the item at most twice its pieces less one.
    The piece, and what the smallest part holds besides it, are looked at first."""
    texts = [t for _, t in items]
    length = np.array([len(t) for t in texts], np.int64)
    allowed = np.floor(length * max_edits).astype(np.int64)
    item, place, chains, strings, parts, rest = [], [], [], {}, {}, []
    for i, (t, k) in enumerate(zip(texts, allowed.tolist())):
        m = k // 2 + 1
        cut = [j * len(t) // m for j in range(m + 1)]
        size, above = len(t) // m, []
        _tree(0, m, [], above)
        for j in range(m):
            strings.setdefault((size, k > 0), []).append(len(item))
            ranges = [(lo, hi) for lo, hi in above[j] if cut[hi] - cut[lo] <= WORD and hi - lo > 1]
            chains.append([parts.setdefault((i, cut[lo], cut[hi] - cut[lo], 2 * (hi - lo) - 1), len(parts)) for lo, hi in ranges])
            lo, hi = ranges[0] if ranges else (j, j + 1)
            lo, hi = (j + 1, hi) if lo == j else (lo, j)
            rest.append((cut[hi] - cut[lo], 2 * (hi - lo) + 1, cut[lo]))
            item.append(i)
            place.append(cut[j])
    ups = np.full((max(map(len, chains)), len(item)), -1, np.int64)
    for p, chain in enumerate(chains):
        ups[: len(chain), p] = chain
    masks = np.zeros((len(parts), 256), np.uint64)
    for (i, begin, width, _), n in parts.items():
        for j, c in enumerate(_kind(points(texts[i][begin : begin + width])).tolist()):
            masks[n, c] |= np.uint64(1 << j)
    rest = np.array(rest, np.int64)
    lane = np.uint32 if rest[:, 0].max() <= 32 else np.uint64
    rest_masks = np.zeros((len(item), 256), lane)
    for n, (width, _, begin) in enumerate(rest.tolist()):
        for j, c in enumerate(_kind(points(texts[item[n]][begin : begin + width])).tolist()):
            rest_masks[n, c] |= lane(1 << j)
    column = lambda k: np.array([x[k] for x in parts], np.int64)
    lookups = []
    for (size, edit), pieces in strings.items():
        flat = points("".join(texts[item[p]][place[p] : place[p] + size] + "\x00" for p in pieces))
        up, down = _powers(BASE, len(flat)), _powers(INVERSE, len(flat))
        at = np.arange(len(pieces)) * (size + 1)
        holed = lambda n, holes, by_hole=False: np.stack([h[at] for h in _holed(flat, n, holes, up, down, by_hole)])  # noqa: B023, E731
        whole, every = holed(size + 1, [size]), [*range(size)]
        # A sign too many, another sign, one too few; without edits the whole piece.
        wanted = [(size + 1, every[1:], False, whole), (size, every, True, holed(size, every, True)), (size, [size - 1], False, holed(size, every))] if edit else [(size + 1, [size], False, whole)]
        for window, holes, by_hole, h in wanted:
            of, h = np.tile(np.array(pieces, np.int64), len(h)), h.ravel()
            order = np.argsort(h, kind="stable")
            shift = 32 - min(22, max(12, len(h).bit_length() + 4))
            first = np.concatenate([[0], np.cumsum(np.bincount(h >> np.uint32(shift), minlength=1 << (32 - shift)))])
            lookups.append(Lookup(window, holes, by_hole, shift, np.diff(first) > 0, first, h[order], of[order]))
    return Index([i for i, _ in items], texts, allowed, length, lookups, np.array(item, np.int64), np.array(place, np.int64), ups, column(1), column(2), column(3), masks, rest, rest_masks)


def _pieces_at(cp: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray]:
    """Where which pieces occur with at most one edit, once each."""
    block, wide = 1 << 15, max(x.size for x in ix.lookups)
    up, down = _powers(BASE, block + wide), _powers(INVERSE, block + wide)
    found = [np.zeros(0, np.int64)]
    for x in ix.lookups:
        for begin in range(0, len(cp), block):
            for h in _holed(cp[begin : begin + block + x.size - 1], x.size, x.holes, up, down, x.by_hole):
                bits = (h >> np.uint32(x.shift)).astype(np.intp)
                at = np.flatnonzero(x.seen.take(bits, mode="clip"))
                h, lo = h[at], x.first[bits[at]]
                n = x.first[bits[at] + 1] - lo
                k = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                hit = x.hashes[k] == np.repeat(h, n)
                at, piece = np.repeat(at, n)[hit], x.piece[k[hit]]
                found.append((begin + at) * len(ix.item) + piece)
    both = np.unique(np.concatenate(found))
    return both // len(ix.item), both % len(ix.item)


def _rest_near(kinds: np.ndarray, pos: np.ndarray, piece: np.ndarray, ix: Index) -> np.ndarray:
    """Whether the rest of the smallest part may stand beside each piece: within its edits, in a
    stretch that holds every place where it can. Nothing that :func:`_holds` finds is lost."""
    width, edits, begin = ix.rest[piece].T
    after = begin > ix.place[piece]
    start = pos + np.where(after, begin - ix.place[piece] - 2, -2 - width - edits)
    lane = ix.rest_masks.dtype.type
    one, none = lane(1), width == 0
    top = np.maximum(width - 1, 0).astype(lane)
    up, down = np.full(len(piece), ~lane(0)), np.zeros(len(piece), lane)
    score = width.astype(np.int16)
    best, row, flat = score.copy(), piece * 256, ix.rest_masks.ravel()
    for s in range(int((width + edits).max(initial=0)) + 5):
        eq = flat.take(row + kinds.take(start + s, mode="clip"))
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up), up & xh
        score += ((ph >> top) & one).astype(np.int16)
        score -= ((mh >> top) & one).astype(np.int16)
        ph <<= one
        mh <<= one
        up, down = mh | ~(xv | ph), ph & xv
        np.minimum(best, score, out=best)
    return none | (best <= edits)


def _holds(kinds: np.ndarray, pos: np.ndarray, piece: np.ndarray, part: np.ndarray, ix: Index) -> np.ndarray:
    """Whether each part is met within its edits around a piece; signs of one kind count as equal."""
    one = np.uint64(1)
    width, edits = ix.width[part], ix.edits[part]
    start = pos - 1 - (ix.place[piece] - ix.begin[part]) - edits
    span = width + 2 * edits + 1
    top = (width - 1).astype(np.uint64)
    up, down, score = np.full(len(part), ~np.uint64(0)), np.zeros(len(part), np.uint64), width.copy()
    met = np.zeros(len(part), bool)
    for s in range(int(span.max(initial=0))):
        eq = ix.masks[part, kinds.take(start + s, mode="clip")]
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up), up & xh
        score += ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
        ph, mh = ph << one, mh << one
        up, down = mh | ~(xv | ph), ph & xv
        met |= (score <= edits) & (s < span)
    return met


def leaks_of(texts: list[str], ix: Index, chunk: int = 8192) -> list[list[dict]]:
    """For each text the items found in it."""
    plain = [normal(t) for t in texts]
    gap = 3 * WORD + max(x.size for x in ix.lookups)
    sizes = np.array([len(t) for t in plain], np.int64)
    begins = gap + np.concatenate([[0], np.cumsum(sizes + gap)[:-1]]).astype(np.int64)
    cp = points("\x00" * gap + "".join(t + "\x00" * gap for t in plain))
    kinds = _kind(cp)
    at, pieces = _pieces_at(cp, ix)
    found: list[dict[int, tuple]] = [{} for _ in texts]
    keep = np.concatenate([_rest_near(kinds, at[c : c + chunk], pieces[c : c + chunk], ix) for c in range(0, max(1, len(at)), chunk)])
    at, pieces = at[keep], pieces[keep]
    for c in range(0, len(at), chunk):
        pos, pc = at[c : c + chunk], pieces[c : c + chunk]
        for level in ix.ups:
            keep, part = np.ones(len(pc), bool), level[pc]
            some = np.flatnonzero(part >= 0)
            if len(some):
                keep[some] = _holds(kinds, pos[some], pc[some], part[some], ix)
            pos, pc = pos[keep], pc[keep]
        owner = np.searchsorted(begins, pos, "right") - 1
        inside = (owner >= 0) & (pos < begins[owner] + sizes[owner])
        pos, pc, owner = pos[inside], pc[inside], owner[inside]
        start = pos - begins[owner] - ix.place[pc]
        for i, d, st in zip(ix.item[pc].tolist(), owner.tolist(), start.tolist()):
            allowed, size = int(ix.allowed[i]), int(ix.length[i])
            a, b = max(0, st - 1 - allowed), min(int(sizes[d]), st + size + allowed)
            best = found[d].get(i)
            if best is not None and (best[0] == 0 or a <= best[1] and best[2] <= b):
                continue
            dist, end = nearest(ix.texts[i], plain[d][a:b])
            if dist <= allowed and (best is None or dist < best[0]):
                found[d][i] = (dist, max(0, a + end - size), a + end)
    return [[{"item_id": ix.ids[i], "distance": v[0], "start": v[1], "length": v[2] - v[1]} for i, v in sorted(f.items())] for f in found]


def find_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", keep: list[str] | None = None,
    max_edits: float = 0.2, max_item_chars: int = 250_000,
) -> DataFrame:
    """``docs`` with ``leaks``: an array of the items found in each text, :data:`LEAK`.

    Texts and items are compared in lower case with single spaces. An item is found if its edit
    distance to some passage is at most ``max_edits`` of its length (up to 0.5), and every such item
    is found. An item is cut into so many pieces that one of them has at most one edit in any such
    passage; every whole text is searched for pieces with at most one edit, by hashes with one sign
    left out. From each one met, its neighbour and then larger and larger parts of the item are checked
    with the edits that they may have (see :func:`build`), and what is left goes to the exact edit distance of the item
    over its neighbourhood. Of several passages near the item in one text one is given.

    Items are broadcast in blocks of about ``max_item_chars`` signs, so any number of them is
    possible, at a pass over ``docs`` a block. Null or empty items are not looked for; a null or
    empty text has no leaks; items that share a key are looked for each; repeated rows get equal
    answers; no rows give no rows, no items empty arrays. ``start`` and ``length`` count signs of
    the normalised text. Columns: ``keep`` (None: all of ``docs``) and ``leaks``.
    """
    if max_edits > 0.5:
        raise ValueError("max_edits is at most 0.5")
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c != "leaks"]
    wanted = items.select(F.col(f"`{item_key}`").cast("long").alias("k"), F.col(f"`{item_text}`").alias("t")).where("length(trim(t)) > 0")
    total = wanted.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // max_item_chars)
    kind = T.DataType.fromDDL(f"array<{LEAK}>")
    out = docs.select(*(F.col(f"`{c}`") for c in keep), F.array().cast(kind).alias("leaks"), F.col(f"`{text}`").alias("lw_text"))
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).orderBy("k", "t").collect()
        rows = [(r.k, normal(r.t)) for r in rows]
        rows = [r for r in rows if r[1]]
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(build(rows, max_edits))

        def run(batches, shared=shared):
            for batch in batches:
                n = batch.num_columns
                for part in row_slices(batch, n - 1, 1 << 19):
                    more = leaks_of(part.column(n - 1).to_pylist(), shared.value)
                    leaks = [(old or []) + new for old, new in zip(part.column(n - 2).to_pylist(), more)]
                    yield pa.RecordBatch.from_arrays([*part.columns[: n - 2], pa.array(leaks, part.column(n - 2).type), part.column(n - 1)], part.schema.names)

        out = out.mapInArrow(run, out.schema)
        if b % 4 == 3 and b + 1 < blocks:  # a plan of bounded length, and few Python workers at a time
            out = written(out, "leaks")
    return out.drop("lw_text")
