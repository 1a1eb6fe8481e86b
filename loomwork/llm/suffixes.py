"""Exact removal of long repeats: a sparse suffix array over range partitions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._anchors import BYTES, WIDTH, WORDS, anchors, signs
from ._shared import forget, row_slices, workspace, written
from ._words import words

_ID = ["k1", "k2", "pos"]
#: Every passage of over 50 words, also where its first and its last word have grown together with
#: what stands around them: 49 whole words are left.
PASSAGES = {"unit": WORDS, "span": 49, "gram": 24}


def multikey_quicksort(keys: list[bytes]) -> np.ndarray:
    """Order of byte strings: ternary partitions, eight bytes at a time."""
    n = len(keys)
    if n < 2:
        return np.arange(n)
    width = -(-max(map(len, keys)) // 8) * 8 or 8
    m = np.frombuffer(b"".join(k.ljust(width, b"\0") for k in keys), ">u8").reshape(n, width // 8)
    order, stack = np.arange(n), [(0, n, 0)]
    while stack:
        lo, hi, d = stack.pop()
        part = order[lo:hi]
        if hi - lo <= 24 or d >= m.shape[1]:
            order[lo:hi] = sorted(part.tolist(), key=keys.__getitem__)
            continue
        x = m[part, d]
        pivot = np.sort(x[:: max(1, len(x) // 9)])[len(x[:: max(1, len(x) // 9)]) // 2]
        less, same, more = x < pivot, x == pivot, x > pivot
        order[lo:hi] = np.concatenate([part[less], part[same], part[more]])
        a, b = lo + int(less.sum()), lo + int(less.sum() + same.sum())
        stack += [(i, j, e) for i, j, e in ((lo, a, d), (a, b, d + 1), (b, hi, d)) if j - i > 1]
    return order


def _matrix(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width), size


def common(a: list[bytes], b: list[bytes], width: int) -> np.ndarray:
    """Lengths of the common beginnings, pair by pair."""
    if not a:
        return np.zeros(0, np.int64)
    (x, n), (y, m) = _matrix(a, width), _matrix(b, width)
    differ = x != y
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return np.minimum(first, np.minimum(n, m))


_ANCHOR = "k1 long, k2 int, pos int, upto int, h long, c1 long, c2 long"


ANCHOR, LONG = -1, -2


def _find(span: int, gram: int, unit: str):
    """A row for each anchor (``upto`` :data:`ANCHOR`), for each periodic run (its end), and for
    each text of ``span`` signs or more (:data:`LONG`)."""

    def run(batches):
        for batch in batches:
            for part in row_slices(batch, 2):
                raw, at = signs(part.column(2), unit)
                of, p, h, c1, c2, (run_of, begin, end) = anchors(raw, at, span, gram)
                whole = np.flatnonzero(np.diff(at) >= span)
                take = pa.array(np.concatenate([of, run_of, whole]))
                place = lambda *x: pa.array(np.concatenate(x).astype(np.int32))
                long = lambda x: pa.array(np.concatenate([np.ascontiguousarray(x).view(np.int64), np.zeros(len(end) + len(whole), np.int64)]))
                upto = place(np.full(len(p), ANCHOR), end, np.full(len(whole), LONG))
                cols = [part.column(0).take(take), part.column(1).take(take), place(p, begin, np.zeros(len(whole))), upto, long(h), long(c1), long(c2)]
                yield pa.RecordBatch.from_arrays(cols, ["k1", "k2", "pos", "upto", "h", "c1", "c2"])

    return run


def _surroundings(span: int, gram: int, unit: str):
    """The signs around each place (a struct of pos and h) of each text; before it, backwards."""
    far, w = span - gram, WIDTH[unit]

    def run(batches):
        for batch in batches:
            for part in row_slices(batch, 2):
                rows = []
                raw, at = signs(part.column(2), unit)
                raw = raw.astype(f">u{w}")
                for d, (k1, k2, places) in enumerate(zip(*(part.column(i).to_pylist() for i in (0, 1, 3)))):
                    n = int(at[d + 1] - at[d])
                    ahead, back = raw[at[d] : at[d + 1]].tobytes(), raw[at[d] : at[d + 1]][::-1].tobytes()
                    rows += [(k1, k2, x["pos"], x["h"], back[(n - x["pos"]) * w : (n - x["pos"] + far) * w], ahead[x["pos"] * w : (x["pos"] + span) * w]) for x in places]
                cols = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["k1", "k2", "pos", "h", "left", "right"])

    return run


def equal_windows(h: np.ndarray, left: list[bytes], right: list[bytes], span: int, far: int, w: int = 1) -> np.ndarray:
    """For each suffix (a row) and each ``o`` up to ``far``: whether the window from ``o`` signs
    before it, ``span`` long, is also another row's of the same ``h``. A sign has ``w`` bytes.

    Rows are sorted by the signs after and by those before. In either order the rows that share at
    least so many signs are a run between two smaller common beginnings of neighbours, so windows
    are equal if and only if both runs are."""
    n = len(h)
    first = [int(x + (1 << 63)).to_bytes(8, "big") for x in h.tolist()]
    runs = []
    for side, width in ((right, span), (left, far)):
        order = multikey_quicksort([a + b.ljust(width * w, b"\0") for a, b in zip(first, side)])
        same = common([side[i] for i in order[:-1]], [side[i] for i in order[1:]], width * w) // w
        same[h[order[1:]] != h[order[:-1]]] = -1
        best = np.maximum(np.append(-1, same), np.append(same, -1))
        most = np.empty(n, np.int64)
        most[order] = best
        runs.append((order, np.append(-1, same), most))
    (by_r, same_r, most_r), (by_l, same_l, most_l) = runs
    out = np.zeros((n, far + 1), bool)
    r, l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(max(0, span - int(most_r.max())), min(far, int(most_l.max())) + 1):
        able = np.flatnonzero((most_r >= span - o) & (most_l >= o))
        if len(able) < 2:
            continue
        r[by_r] = np.cumsum(same_r < span - o)
        l[by_l] = np.cumsum(same_l < o)
        key = r[able] * (n + 1) + l[able]
        at = np.argsort(key, kind="stable")
        twin = key[at[1:]] == key[at[:-1]]
        out[able[at[1:][twin]], o] = True
        out[able[at[:-1][twin]], o] = True
    return out


_FOUND = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("pos", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("h", pa.int64()), ("side", pa.int32()), ("part", pa.int32())])
_FOUND_DDL = "k1 long, k2 int, pos int, lo int, hi int, h long, side int, part int"


LEAD = 16  # leading bytes that come first in the order of ranges


def _settle(rows: pa.Table, span: int, gram: int, w: int) -> pa.Table:
    """Ranges of ``o`` whose windows occur twice among ``rows``, and the grams at the ends of the rows' order."""
    h, right = rows["h"].to_numpy(), rows["right"].to_pylist()
    twice = equal_windows(h, rows["left"].to_pylist(), right, span, span - gram, w)
    edge = np.diff(np.pad(twice, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, lo = np.nonzero(edge == 1)
    hi = np.nonzero(edge == -1)[1] - 1
    took = rows.select(["k1", "k2", "pos", "h"]).take(pa.array(row))
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    zero = np.zeros(len(row), np.int32)
    found = pa.table([took["k1"], took["k2"], took["pos"], pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), took["h"], pa.array(zero), pa.array(zero)], schema=_FOUND)
    none, ordered = [0, 0], [(b[:LEAD], x) for b, x in zip(right, h.tolist())]
    ends = pa.table([pa.array(x, t) for x, t in zip((none, none, none, none, none, [min(ordered)[1], max(ordered)[1]], [1, 2], [part, part]), _FOUND.types)], schema=_FOUND)
    return pa.concat_tables([found, ends])


def _settle_range(span: int, gram: int, w: int):
    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if rows:
            yield from _settle(pa.Table.from_batches(rows), span, gram, w).to_batches()

    return run


def _neighbours(span: int, gram: int, w: int, rightwards: bool):
    """Sort one range of suffixes and compare each with the next; hand out the ends."""
    far, span = (span - gram) * w, span * w

    def run(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        if not rows:
            return
        keys = [r[5].ljust(span, b"\0") + r[4] if rightwards else (r[3] + (1 << 63)).to_bytes(8, "big") + r[4].ljust(far, b"\0") + r[5] for r in rows]
        rows = [rows[i] for i in multikey_quicksort(keys)]
        right = common([r[5] for r in rows[:-1]], [r[5] for r in rows[1:]], span) // w
        left = common([r[4] for r in rows[:-1]], [r[4] for r in rows[1:]], far) // w
        same = np.array([a[3] == b[3] for a, b in zip(rows, rows[1:])], bool)
        part = TaskContext.get().partitionId()
        out = []
        for i in np.flatnonzero(same):
            out += [(*r[:4], int(left[i]), int(right[i]), 0, part, None, None) for r in (rows[i], rows[i + 1])]
        out += [(*r[:4], 0, 0, side, part, r[4], r[5]) for r, side in ((rows[0], 1), (rows[-1], 2))]
        for i in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_pylist([dict(zip(_PAIR.names, x)) for x in out[i : i + 10_000]], schema=_PAIR)

    return run


_PAIR = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("pos", pa.int32()), ("h", pa.int64()), ("l", pa.int32()), ("r", pa.int32()), ("side", pa.int32()), ("part", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])
_PAIR_DDL = "k1 long, k2 int, pos int, h long, l int, r int, side int, part int, left binary, right binary"


def _edges(span: int, gram: int, w: int):
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            left = common([x["left"] for x in rows], [x["n"]["left"] for x in rows], (span - gram) * w) // w
            right = common([x["right"] for x in rows], [x["n"]["right"] for x in rows], span * w) // w
            out = [{**{c: y[c] for c in ("k1", "k2", "pos", "h")}, "l": int(a), "r": int(b)} for x, a, b in zip(rows, left, right) for y in (x, x["n"])]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(_PAIR)[:6]))

    return run


def _sweep(around: DataFrame, parts: int, span: int, gram: int, w: int, rightwards: bool, table) -> DataFrame:
    """Of each suffix and its neighbours in one order: the common signs before and after."""
    salt = F.xxhash64(*_ID)
    order = [F.col("right"), F.col("left"), salt] if rightwards else [F.col("h"), F.col("left"), F.col("right"), salt]
    ranged = around.select(*_ID, "h", "left", "right").repartitionByRange(parts, *order)
    pairs = table(ranged.mapInArrow(_neighbours(span, gram, w, rightwards), _PAIR_DDL), "suffix-neighbours")
    ends = pairs.where("side > 0")
    following = F.lead(F.struct("k1", "k2", "pos", "h", "left", "right", "side")).over(Window.orderBy("part", "side"))
    across = ends.withColumn("n", following).where("side = 2 and n.side = 1 and h = n.h").select("k1", "k2", "pos", "h", "left", "right", "n")
    return pairs.where("side = 0").select("k1", "k2", "pos", "h", "l", "r").unionByName(across.mapInArrow(_edges(span, gram, w), "k1 long, k2 int, pos int, h long, l int, r int"))


def _settle_large(around: DataFrame, parts: int, span: int, gram: int, w: int, table) -> DataFrame:
    """As :func:`_settle` for grams with more suffixes than a task should hold: neighbours in both
    orders, which ranges of any size give, settle most windows; the others are compared by digest."""
    around = table(around.select(*_ID, "h", "left", "right"), "large-grams")
    seen = _sweep(around, parts, span, gram, w, True, table).unionByName(_sweep(around, parts, span, gram, w, False, table))
    span_of = F.when(F.col("l") + F.col("r") >= span, F.struct((span - F.col("r")).alias("lo"), F.col("l").alias("hi")))
    best = table(seen.groupBy("h", *_ID).agg(F.max("l").alias("l"), F.max("r").alias("r"), F.collect_set(span_of).alias("sure")), "suffix-bounds")
    sure = best.select(*_ID, F.explode("sure").alias("s")).select(*_ID, "s.lo", "s.hi")
    # Between the bounds, outside the sure ones.
    open_ = best.where(F.col("l") + F.col("r") >= span)
    unsure = open_.select("h", F.explode(F.filter(F.sequence(span - F.col("r"), F.col("l")), lambda o: ~F.exists("sure", lambda s: (s.lo <= o) & (o <= s.hi)))).alias("o"))
    asked = table(unsure.distinct(), "open-windows")
    members = open_.join(asked, "h").where((F.col("o") <= F.col("l")) & (F.col("o") >= span - F.col("r"))).select(*_ID, "h", "o")
    whole = members.join(around, [*_ID, "h"]).select(*_ID, "h", "o", F.sha2(F.concat(F.expr(f"substring(left, 1, o * {w})"), F.lit(b"|"), F.expr(f"substring(right, 1, ({span} - o) * {w})")), 256).alias("w"))
    equal = whole.groupBy("h", "o", "w").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return sure.unionByName(whole.join(equal, ["h", "o", "w"], "left_semi").select(*_ID, F.col("o").alias("lo"), F.col("o").alias("hi")))


_REMOVED = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])


def united(ranges: list[dict]) -> list[tuple[int, int]]:
    """Ranges that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for b, e in sorted((x["b"], x["e"]) for x in ranges):
        if out and b <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((b, e))
    return out


def _remove(unit: str):
    """What is left of a text without its ranges, and how much went."""

    def run(batches):
        for batch in batches:
            for part in row_slices(batch, 2):
                out = []
                w = words(part.column(2)) if unit != BYTES else None
                begin = np.concatenate([[0], np.cumsum(pa.compute.binary_length(part.column(2)).to_numpy())])
                for d, (k1, k2, text, ranges) in enumerate(zip(*(c.to_pylist() for c in part.columns))):
                    raw, spans, kept, at = text.encode(), united(ranges), [], 0
                    if w is not None:
                        first = w.first[d]
                        spans = [(int(w.begins[first + b] - begin[d]), int(w.ends[first + e - 1] - begin[d])) for b, e in spans]
                    for b, e in spans:
                        kept.append(raw[at:b])
                        at = e
                    left = b"".join([*kept, raw[at:]])
                    out.append({"k1": k1, "k2": k2, "n_removed": len(raw) - len(left), "n_spans": len(spans), "kept": left.decode(errors="ignore"), "kept_sha256": hashlib.sha256(left).hexdigest()})
                yield pa.RecordBatch.from_pylist(out, schema=_REMOVED)

    return run


def repeats(docs: DataFrame, text: str = "text", span: int = 400, gram: int = 200, unit: str = BYTES, in_range: int = 30_000, in_task: int = 2_000) -> DataFrame:
    """For each distinct text (by the hashes ``k1`` and ``k2`` of :func:`identity`) that loses
    bytes: ``n_removed``, ``n_spans``, ``kept`` (what is left) and ``kept_sha256``.

    A sign goes if some ``span`` signs that cover it also start anywhere else in any text. See
    :func:`remove_repeats` for the cases.
    """
    with workspace(docs.sparkSession, "suffixes") as table:
        return written(_repeats(docs, text, span, gram, unit, in_range, in_task, table), "repeats-removed")


def _repeats(docs: DataFrame, text: str, span: int, gram: int, unit: str, in_range: int, in_task: int, table) -> DataFrame:
    texts = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).select(*identity(F.col("t")), "t")
    far, w = span - gram, WIDTH[unit]
    copies = table(texts.groupBy("k1", "k2").agg(F.count("*").alias("n")), "text-copies")
    marked = table(texts.mapInArrow(_find(span, gram, unit), _ANCHOR), "anchors")
    runs = table(marked.where("upto >= 0").select("k1", "k2", F.col("pos").alias("b"), F.col("upto").alias("e")).distinct(), "periodic-runs")
    long = table(marked.where(F.col("upto") == LONG).select("k1", "k2").distinct(), "long-texts")
    found = marked.where(F.col("upto") == ANCHOR).drop("upto")
    # Anchors whose gram also begins at another place; places of equal texts are one.
    place = F.xxhash64(*_ID)
    grams = table(found.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("h"), "repeated-grams")
    both = table(found.join(grams, "h", "left_semi"), "anchors-of-repeated-grams")  # no aggregate over it: Spark can split a hot gram
    forget(marked)
    again = table(both.dropDuplicates(["h", *_ID]), "repeated-anchors")
    forget(both)
    # Surroundings that occur twice settle all windows around the anchor; one stands for them.
    full = again.where("c1 <> 0").groupBy("h", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct(*_ID)).alias("first")).where("n > 1")
    full = table(full, "repeated-surroundings")
    twins = again.join(full, ["h", "c1", "c2"]).select(*_ID, F.lit(0).alias("lo"), F.lit(far).alias("hi"), F.struct(*_ID).eqNullSafe(F.col("first")).alias("stands"))
    twins = table(twins, "twin-anchors")
    open_ = again.select(*_ID, "h").join(twins.where("not stands").select(*_ID), _ID, "left_anti")
    places = open_.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "h")).alias("places"))
    wanted = table(texts.join(places, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("t").alias("t"), F.first("places").alias("places")), "anchored-texts")
    around = table(wanted.select("k1", "k2", "t", "places").mapInArrow(_surroundings(span, gram, unit), "k1 long, k2 int, pos int, h long, left binary, right binary"), "suffixes")
    parts = max(1, -(-around.count() // in_range))
    salt = F.xxhash64(*_ID)
    # Leading bytes, the gram, and the bytes that follow it: short keys, as a sample of them passes the driver.
    lead, after = F.substring("right", 1, LEAD), F.substring("right", gram * w + 1, LEAD)
    ranged = around.select(*_ID, "h", "left", "right").repartitionByRange(parts, lead, "h", after, salt)
    settled = table(ranged.mapInArrow(_settle_range(span, gram, w), _FOUND_DDL), "settled-windows")
    sure = settled.where("side = 0").select(*_ID, "lo", "hi")
    # Grams whose suffixes lie on both sides of a boundary: once more, together.
    ends = settled.where("side > 0").withColumn("next", F.lead("h").over(Window.orderBy("part", "side")))  # two rows a range
    split = table(ends.where("side = 2 and next = h").select("h").distinct().join(around.groupBy("h").agg(F.count("*").alias("n")), "h"), "split-grams")
    together = around.join(split.where(F.col("n") <= in_task).select("h"), "h").select(*_ID, "h", "left", "right")
    again_sure = together.groupBy("h").applyInArrow(lambda t: _settle(t, span, gram, w), _FOUND_DDL).where("side = 0").select(*_ID, "lo", "hi")
    sure = sure.unionByName(again_sure)
    large = split.where(F.col("n") > in_task).select("h")
    if not large.isEmpty():
        sure = sure.unionByName(_settle_large(around.join(large, "h"), parts, span, gram, w, table))
    all_ = twins.select(*_ID, "lo", "hi").unionByName(sure)
    ranges = all_.select("k1", "k2", (F.col("pos") - F.col("hi")).alias("b"), (F.col("pos") - F.col("lo") + span).alias("e"))
    ranges = ranges.unionByName(runs)
    # Windows may overlap in thousands of ways; keep the farthest end for each beginning.
    ranges = ranges.groupBy("k1", "k2", "b").agg(F.max("e").alias("e")).groupBy("k1", "k2").agg(F.collect_list(F.struct("b", "e")).alias("ranges"))
    ranges = table(ranges, "repeat-ranges")
    rest = texts.join(ranges, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("t").alias("t"), F.first("ranges").alias("ranges"))
    once = rest.join(copies.where("n = 1"), ["k1", "k2"], "left_semi")
    cut = once.select("k1", "k2", "t", "ranges").mapInArrow(_remove(unit), "k1 long, k2 int, n_removed long, n_spans long, kept string, kept_sha256 string")
    size = F.octet_length("t").cast("long")
    gone = texts.select("k1", "k2", size.alias("n")).join(copies.where("n > 1").select("k1", "k2"), ["k1", "k2"]).join(long, ["k1", "k2"]).groupBy("k1", "k2").agg(F.max("n").alias("n_removed"))
    gone = gone.select("k1", "k2", "n_removed", F.lit(1).cast("long").alias("n_spans"), F.lit("").alias("kept"), F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"))
    return cut.unionByName(gone)


def identity(text: Column) -> list[Column]:
    """96 bits that stand for a whole text, ``k1`` and ``k2``."""
    return [F.xxhash64(text, F.lit(1)).alias("k1"), F.hash(text, F.lit(2)).alias("k2")]


def remove_repeats(docs: DataFrame, text: str = "text", span: int = 400, gram: int = 200, with_text: bool = True, unit: str = BYTES, **sizes) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``; with ``with_text``
    the column ``text`` becomes what is left.

    Texts are UTF-8. Their signs are bytes, or with ``unit`` :data:`WORDS` words: runs of bytes
    above the space, ASCII letters in lower case. Every sign goes that lies in ``span`` signs
    which also start anywhere else, in the same or another text; overlaps count, and strings are
    judged on the input. Both (all) places go, so an exact copy of ``span`` signs or more takes
    both texts whole. Matches never cross texts. Where words go, so does what lies between them.

    Which suffixes can matter: of every ``span`` signs the place of the least hash of ``gram``
    signs is an anchor, so equal strings have equal anchors; those whose gram occurs once are
    dropped by a join. Text that repeats itself with a short period keeps the anchors at both ends,
    and stands for its own windows. The others carry the signs that a window around them can hold; equal
    surroundings are one suffix. Sampled splitters range-partition them by leading bytes, gram and
    the bytes that follow it (with a salt, so that no range holds more than its share, about
    ``in_range``), each range is sorted by multikey quicksort, after and before the anchor, and the
    common beginnings of neighbours tell which windows are equal. A gram that lies on both sides of
    a boundary is compared across it: up to ``in_task`` suffixes together, more of them by sorted
    ranges in both orders, whose last and first suffixes are compared, and by comparing the windows
    themselves where neighbours leave it open.

    A null or empty text stays as an empty one with nothing removed. Repeated rows are copies.
    Where a cut parts a character, its other bytes go from the text column (not from the hash).
    No rows give no rows; other columns stay, those named like the new ones are replaced.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    done = repeats(docs, text, span, gram, unit, **sizes)
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keep = [c for c in docs.columns if c not in new and (with_text or c != text)]
    k1, k2 = identity(own)
    cols = [F.col(f"`{c}`") for c in keep]
    d = docs.select(*cols, k1.alias("lw_k1"), k2.alias("lw_k2"), F.octet_length(own).cast("long").alias("lw_bytes"), F.sha2(own, 256).alias("lw_sha"))
    got = done.select(F.col("k1").alias("lw_k1"), F.col("k2").alias("lw_k2"), F.col("n_removed").alias("lw_removed"), F.col("n_spans").alias("lw_spans"), F.col("kept_sha256").alias("lw_kept_sha"), *([F.col("kept").alias("lw_kept")] if with_text else []))
    d = d.join(got, ["lw_k1", "lw_k2"], "left")
    zero = F.lit(0).cast("long")
    out = []
    for c in keep:
        x = F.col(f"`{c}`")
        out.append(F.when(F.col("lw_removed") > 0, F.col("lw_kept")).otherwise(own).alias(c) if c == text else x)
    return d.select(*out, F.col("lw_bytes").alias("n_bytes"), F.coalesce("lw_removed", zero).alias("n_removed"), F.coalesce("lw_spans", zero).alias("n_spans"), F.coalesce("lw_kept_sha", "lw_sha").alias("kept_sha256"))

