"""Message frames as column expressions, and the zero-packing of words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encoding import bits_double, double_bits, let, little_endian, read_little_endian

# Limits of a frame.
MAX_SEGMENTS, MAX_WORDS = 512, 8 << 20
LONG = 1 << 12  # packed bytes from which on numpy unpacks faster than a loop


def table_size(segments: Column) -> Column:
    """Bytes of the table before ``segments`` segments: a count and their sizes, in whole words."""
    return 8 * (F.floor(segments / 2) + 1)


def encode_frame(segments: Column) -> Column:
    """A table (count less one, sizes in words, padded to a word), then the segments; null unless
    each segment is whole words, and there are between 1 and the limit."""
    return let(segments, _encoded)


def _encoded(segments: Column) -> Column:
    sizes = F.transform(segments, lambda s: (F.octet_length(s) / 8).cast("long"))
    words = F.concat(F.array(F.size(segments).cast("long") - 1), sizes, F.when(F.size(segments) % 2 == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>")))
    whole = F.forall(segments, lambda s: F.octet_length(s) % 8 == 0) & F.size(segments).between(1, MAX_SEGMENTS)
    return F.when(whole, F.unhex(F.concat(F.array_join(F.transform(words, lambda w: F.hex(little_endian(w, 4))), ""), F.array_join(F.transform(segments, F.hex), ""))))


def parse_frame(raw: Column) -> Column:
    """The segments of the frame that ``raw`` begins with; null if it ends too soon or breaks a limit."""
    return let(raw, _parsed)


def _parsed(raw: Column) -> Column:
    def segments(n: Column) -> Column:
        usable = (F.octet_length(raw) >= 8) & n.between(1, MAX_SEGMENTS) & (F.octet_length(raw) >= table_size(n))
        index = F.sequence(F.lit(0), F.when(usable, n - 1).otherwise(F.lit(0)).cast("int"))
        sizes = F.transform(index, lambda i: read_little_endian(raw, i * 4 + 5, 4))
        return F.when(usable, let(sizes, lambda found: cut(n, found)))

    def cut(n: Column, sizes: Column) -> Column:
        add = lambda a, s: a + s
        total = F.aggregate(sizes, F.lit(0).cast("long"), add)
        fits = (total <= MAX_WORDS) & (F.octet_length(raw) >= table_size(n) + 8 * total)
        before = lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0).cast("long"), add)
        return F.when(fits, F.transform(sizes, lambda s, i: F.substr(raw, (table_size(n) + 8 * before(i) + 1).cast("int"), (8 * s).cast("int"))))

    return let(read_little_endian(raw, 1, 4) + 1, segments)


def pack_words(raw: bytes) -> bytes:
    """Zero bytes left out: for each word a tag with a bit for each other byte, then those bytes.

    After a tag of 0 comes the number of zero words that follow, after one of 255 the number of
    words, of one zero byte at most, that follow as they are; both stop at 255."""
    return pack_many([raw])[0]


def frame_of(record: Column, schema: T.StructType) -> Column:
    """A record of 64-bit integers and doubles as a frame of one segment, a word a field."""
    word = lambda r, f: double_bits(r.getField(f.name)) if isinstance(f.dataType, T.DoubleType) else r.getField(f.name)
    return let(record, lambda r: encode_frame(F.array(F.concat(*(little_endian(word(r, f), 8) for f in schema.fields)))))


def record_of(raw: Column, schema: T.StructType) -> Column:
    """The record in a frame of :func:`frame_of`; fields beyond its segment are null."""

    def read(first: Column) -> Column:
        words = {f.name: F.when(F.octet_length(first) >= 8 * k + 8, read_little_endian(first, 8 * k + 1, 8)) for k, f in enumerate(schema.fields)}
        return F.struct(*((bits_double(words[f.name]) if isinstance(f.dataType, T.DoubleType) else words[f.name]).alias(f.name) for f in schema.fields))

    return let(F.get(parse_frame(raw), F.lit(0)), read)


def _run_heads(member: np.ndarray, row: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that head a run, and how many follow them: a head is the first of ``opens`` in a stretch
    of ``member`` words of one row, 255 at most follow, and then the next one of ``opens`` heads."""
    edge = np.flatnonzero(np.append(True, (member[1:] != member[:-1]) | (row[1:] != row[:-1]) | ~member[1:]))
    ends = np.append(edge[1:], len(member))
    last = np.repeat(ends, ends - edge)  # of each word: the end of its stretch
    heads, counts, at = [], [], 0
    for k in np.flatnonzero(opens).tolist():
        if k >= at:
            at = min(k + 256, int(last[k]))
            heads.append(k)
            counts.append(at - k - 1)
    return np.array(heads, np.int64), np.array(counts, np.int64)


def pack_many(raws: list[bytes]) -> list[bytes]:
    """:func:`pack_words` of many byte strings of whole words at once."""
    words = np.frombuffer(b"".join(raws), np.uint8).reshape(-1, 8)
    sizes = np.array([len(r) // 8 for r in raws], np.int64)
    if not len(words):
        return [b""] * len(raws)
    row, some = np.repeat(np.arange(len(raws)), sizes), words != 0
    zeros = 8 - some.sum(axis=1)
    # A column for the tag, for each byte and for the count, and which of them are written.
    cells = np.zeros((len(words), 10), np.uint8)
    cells[:, 0], cells[:, 1:9] = np.packbits(some, axis=1, bitorder="little")[:, 0], words
    shown = np.zeros((len(words), 10), bool)
    shown[:, 0], shown[:, 1:9] = True, some
    covered = np.zeros(len(words) + 1, np.int64)
    for member, opens in ((zeros <= 1, zeros == 0), (zeros == 8, zeros == 8)):
        heads, counts = _run_heads(member, row, opens)
        if len(heads):
            cells[heads, 9], shown[heads, 9] = counts, True
            covered[heads + 1] += 1
            covered[heads + 1 + counts] -= 1
    inside = np.cumsum(covered[:-1]) > 0
    shown[inside, 0] = False
    shown[inside, 1:9] = zeros[inside, None] != 8
    flat, at = cells[shown].tobytes(), np.concatenate([[0], np.cumsum(shown.sum(axis=1))])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return [flat[at[a] : at[b]] for a, b in zip(ends[:-1], ends[1:])]


_BITS = np.array([t.bit_count() for t in range(256)], np.int64)
_HAS_RUN = np.isin(np.arange(256), (0, 255))


def _spread(first: np.ndarray, counts: np.ndarray, step: int = 1) -> np.ndarray:
    """For each of ``first`` so many numbers from there on, ``step`` apart."""
    before = np.cumsum(counts) - counts
    return np.repeat(first - step * before, counts) + step * np.arange(counts.sum())


def unpack_many(packed: bytes) -> tuple[bytes, int]:
    """:func:`unpack_some` for long inputs: items are found one after the other, and filled together."""
    raw = np.frombuffer(packed, np.uint8)
    n = len(raw)
    ends = np.arange(1, n + 1) + (_BITS + _HAS_RUN)[raw]
    runs = np.flatnonzero((raw == 255) & (ends <= n))
    ends[runs] += 8 * raw[ends[runs] - 1].astype(np.int64)
    starts, i, following = [], 0, ends.tolist()
    while i < n and following[i] <= n:
        starts.append(i)
        i = following[i]
    at = np.array(starts, np.int64)
    tags = raw[at]
    counts, some = _BITS[tags], np.unpackbits(tags[:, None], axis=1, bitorder="little").astype(bool)
    words = np.zeros((len(at), 8), np.uint8)
    words[some] = raw[_spread(at + 1, counts)]
    run = np.zeros(len(at), np.int64)
    run[_HAS_RUN[tags]] = raw[(at + 1 + counts)[_HAS_RUN[tags]]]
    place = np.cumsum(run + 1) - run - 1
    out = np.zeros((int(run.sum()) + len(at), 8), np.uint8)
    out[place] = words
    plain = tags == 255
    out[_spread(place[plain] + 1, run[plain])] = raw[_spread(at[plain] + 10, run[plain], 8)[:, None] + np.arange(8)]
    return out.tobytes(), i


def unpack_some(packed: bytes) -> tuple[bytes, int]:
    """What the whole items at the beginning of ``packed`` stand for, and how many bytes they take."""
    if len(packed) > LONG:
        return unpack_many(packed)
    out, i, n = bytearray(), 0, len(packed)
    while i < n:
        tag = packed[i]
        size = tag.bit_count()
        end = i + 1 + size + (tag in (0, 255))
        if end > n:
            break
        run = packed[end - 1]
        if tag == 0:
            out += bytes(8 + 8 * run)
        elif tag == 255:
            if end + 8 * run > n:
                break
            out += packed[i + 1 : i + 9] + packed[end : end + 8 * run]
            end += 8 * run
        else:
            word, at = bytearray(8), i + 1
            while tag:
                low = tag & -tag
                word[low.bit_length() - 1] = packed[at]
                tag, at = tag ^ low, at + 1
            out += word
        i = end
    return bytes(out), i


def unpack_words(packed: bytes) -> bytes | None:
    """What :func:`pack_words` was given; None where ``packed`` ends within a word."""
    out, used = unpack_some(packed)
    return out if used == len(packed) else None


def _packed(raws: pd.Series) -> pd.Series:
    whole = [bytes(x) if x is not None and len(x) % 8 == 0 else None for x in raws]
    done = iter(pack_many([x for x in whole if x is not None]))
    return pd.Series([None if x is None else next(done) for x in whole], index=raws.index, dtype=object)


def _unpacked(raws: pd.Series) -> pd.Series:
    return raws.map(lambda x: None if x is None else unpack_words(bytes(x)))


def pack(raw: Column) -> Column:
    """Packed words; null where ``raw`` is not a whole number of them."""
    return F.pandas_udf(_packed, "binary")(raw)


def unpack(packed: Column) -> Column:
    return F.pandas_udf(_unpacked, "binary")(packed)


def packed_word_size(word: Column) -> Column:
    """Packed bytes of a single word, given as 16 hexadecimal digits."""
    zeros = sum((F.when(F.substring(word, 2 * k + 1, 2) == "00", 1).otherwise(0) for k in range(8)), F.lit(0))
    return F.when(zeros == 8, 2).when(zeros == 0, 10).otherwise(9 - zeros)
