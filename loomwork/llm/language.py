"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import row_slices

BITS = 16
ORDERS = (2, 3)
BLOCK = 4096
CELLS = 1 << 22
_LETTERS = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return text is not None and any(m.group().isalpha() for m in _LETTERS.finditer(text))


PIECE = 1 << 20  # characters of a text looked at together


def buckets(texts: list[str], bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the bucket of the n-gram that begins at each character; where segments of
    characters begin, and each segment's text.

    Each text is lower-cased and followed by two spaces, at which no n-gram begins, so none spans
    two texts. Longer ones are cut into pieces that overlap by two characters, whose n-grams belong
    to the next piece: the segments of these, and of the spaces, have the text -1.
    """
    pieces, starts, of, at = [], [], [], 0
    for i, t in enumerate(texts):
        low = t.lower()
        for a in range(0, max(1, len(low)), PIECE):
            own = min(PIECE, len(low) - a)
            pieces.append(low[a : a + own + 2].ljust(own + 2))
            if own:
                starts.append(at)
                of.append(i)
            starts.append(at + own)
            of.append(-1)
            at += own + 2
    cp = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.concatenate([cp, np.full(max(ORDERS), 32, np.uint32)])
    n, out = len(cp) - max(ORDERS), []
    for order in ORDERS:
        h = np.full(n, order, np.uint32)
        for k in range(order):
            h = (h ^ cp[k : k + n]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits))
    return out, np.array(starts, np.int64), np.array(of, np.int64)


@dataclass
class LanguageModel:
    """``table``: log-probabilities, a row for each bucket, a column for each language."""

    langs: list[str]
    table: np.ndarray
    prior: np.ndarray
    bits: int = BITS
    extra: dict = field(default_factory=dict)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Posterior of each language for each text. ``CELLS`` numbers of the table at a time."""
        grams, starts, of = buckets(texts, self.bits)
        s = np.tile(self.prior, (len(texts), 1))
        step = max(1024, CELLS // max(1, len(self.langs)))
        for c in range(0, len(grams[0]), step):
            lo, hi = np.searchsorted(starts, [c, c + step], "right")
            inside = starts[lo:hi][starts[lo:hi] < c + step]
            begin, text = np.concatenate([[c], inside]) - c, of[lo - 1 : lo + len(inside)]
            sums = sum(np.add.reduceat(self.table[g[c : c + step]], begin, axis=0, dtype=np.float64) for g in grams)
            np.add.at(s, text[text >= 0], sums[text >= 0])
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)


def fit(train: DataFrame, text: str = "text", lang: str = "lang", max_docs: int = 50_000, max_langs: int = 256, bits: int = BITS, smooth: float = 0.5) -> LanguageModel:
    """Fit on about ``max_docs`` rows of ``train`` with a language, picked by a hash of the text.

    Tasks count n-grams into arrays of fixed size, Spark adds them up by language and block; what
    reaches the driver is the model: a table of as many columns as there are languages. Rows of
    more than ``max_langs`` languages raise an error instead of leaving one out: give more, at
    ``2**bits`` numbers of 4 bytes each. Rows with a null text or language are left out; no rows
    give a model without languages.
    """
    rows = train.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")).where("t is not null and l is not null")
    found = sorted(((r.n, r.l) for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()), key=lambda x: x[1])
    if len(found) > max_langs:
        raise ValueError(f"there are more than max_langs={max_langs} languages")
    langs, total = [x[1] for x in found], sum(x[0] for x in found)
    if total > max_docs:
        rows = rows.where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < max(1, max_docs * (1 << 20) // total))
    index = {x: i for i, x in enumerate(langs)}

    def count(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in row_slices(batch, 0):
                labels = np.array([index.get(x, -1) for x in part.column(1).to_pylist()])
                grams, starts, text = buckets(part.column(0).to_pylist(), bits)
                of = np.repeat(np.where(text < 0, -1, labels[text]), np.diff(np.append(starts, len(grams[0]))))
                for k in set(labels[labels >= 0].tolist()):
                    mine = of == k
                    got = sum(np.bincount(g[mine], minlength=1 << bits) for g in grams)
                    sums[k] = sums.get(k, 0) + got
        for k, v in sums.items():
            for b in range(0, len(v), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b], pa.int32()), pa.array([v[b : b + BLOCK].astype("<i8").tolist()], pa.list_(pa.int64()))], ["k", "b", "v"])

    counted = rows.mapInArrow(count, "k int, b int, v array<long>")
    by_bucket = counted.select("k", "b", F.posexplode("v").alias("p", "c")).where("c > 0").groupBy("k", "b", "p").agg(F.sum("c").alias("c"))
    summed = by_bucket.groupBy("k", "b").agg(F.collect_list(F.struct("p", "c")).alias("v"))
    table = np.full((1 << bits, len(langs)), smooth, np.float64)
    for r in summed.toLocalIterator():
        at = np.array([(x.p, x.c) for x in r.v], np.int64)
        table[r.b + at[:, 0], r.k] += at[:, 1]
    table = np.log(table / table.sum(axis=0)) if langs else table
    prior = np.log(np.array([x[0] for x in found], np.float64) / max(1, total))
    return LanguageModel(langs, table.astype(np.float32), prior, bits)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (None: all but the text) with ``lang_pred`` and ``score``.

    ``lang_pred`` is the likeliest learned language and ``score`` its posterior, or ``und`` and 0
    where the text is null or has no letter, or the model knows no language. Whole texts are
    scored; repeated rows get the same answer; no rows give no rows.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # max_langs x 2**bits numbers at most

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in row_slices(batch, batch.num_columns - 1):
                texts = part.column(part.num_columns - 1).to_pylist()
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
                at = [i for i, t in enumerate(texts) if m.langs and has_letter(t)]
                if at:
                    p = m.scores([texts[i] for i in at])
                    for i, k, s in zip(at, p.argmax(axis=1), p.max(axis=1)):
                        lang[i], score[i] = m.langs[k], min(1.0, s)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], [*part.schema.names[:-1], "lang_pred", "score"])

    out = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("lw_text")).mapInArrow(run, out)
