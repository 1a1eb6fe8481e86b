"""Quality classifier: importance resampling with hashed n-gram models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import row_slices, written
from ._words import U, Words, mix, stream, words

BITS = 16
BLOCK = 4096
_KINDS = stream(11, 8)


def shapes(w: Words) -> np.ndarray:
    """What each word looks like: capitals, last sign, one sign only, same as the word before."""
    upper = np.concatenate([[0], np.cumsum((w.raw >= 65) & (w.raw <= 90))])
    other = np.concatenate([[0], np.cumsum((w.raw < 48) | ((w.raw > 57) & (w.raw < 65)) | ((w.raw > 90) & (w.raw < 97)) | ((w.raw > 122) & (w.raw < 128)))])
    size = w.ends - w.begins
    capitals = upper[w.ends] - upper[w.begins]
    signs = np.minimum(3, other[w.ends] - other[w.begins])
    last = w.raw[w.ends - 1].astype(np.int64)
    letter = (last >= 128) | ((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90))
    same = np.zeros(len(size), np.int64)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    same[w.first[:-1][w.counts > 0]] = 0
    caps = np.where(capitals == 0, 0, np.where(capitals == 1, 1, np.where(2 * capitals >= size - signs, 3, 2)))
    return (((np.where(letter, 0, last) * 4 + caps) * 4 + signs) * 2 + same) * 2 + (size == 1)


def grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams (words: 1 and 2; shapes: 1, 2 and 3), and each one's text."""
    owner = w.owner()
    with np.errstate(over="ignore"):
        s = mix(shapes(w).astype(U) + _KINDS[7])
        out, of = [w.hashes * _KINDS[0], s * _KINDS[1]], [owner, owner]
        for h, k in ((w.hashes, 2), (s, 3)):
            pair = owner[:-1] == owner[1:]
            out.append((h[:-1] * _KINDS[k] + h[1:] * _KINDS[k + 2])[pair])
            of.append(owner[:-1][pair])
        three = owner[:-2] == owner[2:]
        out.append((s[:-2] * _KINDS[6] + s[1:-1] * _KINDS[2] + s[2:] * _KINDS[0])[three])
        of.append(owner[:-2][three])
        return (mix(np.concatenate(out)) >> U(64 - BITS)).astype(np.int64), np.concatenate(of)


def _count(batches):
    """Rows text, target: for each block of buckets the counts in all texts and in target texts."""
    sums = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for part in row_slices(batch, 0):
            g, of = grams(words(part.column(0)))
            sums[0] += np.bincount(g, minlength=1 << BITS)
            target = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            sums[1] += np.bincount(g[target[of]], minlength=1 << BITS)
    at = np.flatnonzero(sums[0])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "raw", "target"])


def _score(batches, ratio):
    for batch in batches:
        for part in row_slices(batch, batch.num_columns - 1):
            g, of = grams(words(part.column(part.num_columns - 1)))
            n = part.num_rows
            sums = np.bincount(of, weights=ratio[g], minlength=n)
            size = np.bincount(of, minlength=n)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sums), pa.array(size.astype(np.int64))], [*part.schema.names[:-1], "lw_sum", "lw_grams"])


def cut_for(score: np.ndarray, good: np.ndarray, cost: float = 5.0) -> float:
    """The score from which on to keep: a good text lost costs ``cost`` bad ones kept."""
    order = np.argsort(score, kind="stable")
    s, g = score[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) * cost
    kept = np.concatenate([[(~g).sum()], (~g).sum() - np.cumsum(~g)])
    loss = lost + kept
    allowed = np.concatenate([[True], s[1:] > s[:-1], [True]])
    best = np.flatnonzero((loss == loss[allowed].min()) & allowed)[0]
    if best in (0, len(s)):
        return -np.inf if best == 0 else np.inf
    return float((s[best - 1] + s[best]) / 2)


def kth_largest(table: DataFrame, key: str, k: int, bins: int = 4096) -> int | None:
    """The ``k``-th largest value of a long column: histograms of ``bins`` counts, no sort."""
    low, high = table.agg(F.min(key), F.max(key)).first()
    if k <= 0 or low is None:
        return None
    while low < high:
        width = (high - low) // bins + 1
        inside = table.where(F.col(key).between(low, high))
        counts = sorted(((r.b, r.n) for r in inside.groupBy(F.expr(f"({key} - {low}L) div {width}L").alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for b, n in counts:
            if k <= n:
                break
            k -= n
        else:
            return low
        low, high = low + b * width, min(high, low + (b + 1) * width - 1)
    return low


def resample(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
    max_labels: int = 20_000, keep: list[str] | None = None, seed: int = 17, cost: float = 5.0,
) -> DataFrame:
    """``docs`` with ``log_weight``, ``score`` and ``kept``: importance resampling by Gumbel top-k.

    The target model counts hashed n-grams of the texts that ``labels`` calls good (label 1; about
    20,000 labelled ids at most, ``max_labels``, the smallest by a hash), the raw model those of
    all texts. ``log_weight`` is a text's log ratio of the two models, ``score`` the ratio for one
    n-gram, drawn towards 0 in short texts. The sample is drawn without replacement in proportion
    to the ratio: Gumbel noise, fixed by seed, id and text, is added to ``log_weight``, and the
    ``k`` largest are kept. ``k`` is how many of all texts weigh at least as much as the cut that
    best parts good from bad labelled texts, where losing a good one counts ``cost`` times (of
    rows that share an id the least weight counts). Rows that tie with the last kept one are kept.
    Null or empty texts have no n-grams, weight and score 0. Without labels of both kinds
    everything is kept. Repeated rows share their fate; no rows give no rows.

    Texts are read twice, for the counts and for the weights; what comes out is written once.
    Columns: ``keep`` (None: all of ``docs``), then the three.
    """
    new = ("log_weight", "score", "kept")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    some = labels.select(F.col(f"`{key}`").alias("lw_key"), F.col(f"`{label}`").cast("int").alias("lw_label")).where("lw_key is not null and lw_label in (0, 1)")
    some = some.orderBy(F.xxhash64("lw_key"), "lw_label").limit(max_labels).groupBy("lw_key").agg(F.min("lw_label").alias("lw_label"))
    some = F.broadcast(some)  # max_labels rows of two numbers
    own = F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("lw_text")
    marked = docs.select(F.col(f"`{key}`").alias("lw_key"), own).join(some, "lw_key", "left")
    counted = marked.select("lw_text", F.coalesce(F.col("lw_label") == 1, F.lit(False)).alias("t")).mapInArrow(_count, "bucket long, raw long, target long")
    counts = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # 2**BITS rows
    model = np.full((2, 1 << BITS), 0.5)
    model[0, counts.bucket] += counts.raw
    model[1, counts.bucket] += counts.target
    ratio = np.log(model[1] / model[1].sum()) - np.log(model[0] / model[0].sum())
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    cols = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(*cols, F.col(f"`{key}`").alias("lw_key"), F.xxhash64(own).alias("lw_hash"), own)
    fields = [*rows.schema.fields[:-1], T.StructField("lw_sum", T.DoubleType()), T.StructField("lw_grams", T.LongType())]
    scored = rows.mapInArrow(lambda batches: _score(batches, shared.value), T.StructType(fields))
    unit = (F.xxhash64("lw_key", "lw_hash", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) + 0.5) / float(1 << 53)
    noisy = F.floor((F.col("lw_sum") - F.log(-F.log(unit))) * float(1 << 20)).cast("long")
    table = written(scored.withColumn("lw_q", noisy), "quality-weights")
    known = table.join(some, "lw_key").groupBy("lw_key").agg(F.min("lw_sum").alias("w"), F.first("lw_label").alias("y")).toPandas()  # max_labels rows
    cut = cut_for(known["w"].to_numpy(float), known["y"].to_numpy() == 1, cost) if known["y"].nunique() == 2 else -np.inf
    k = table.where(F.col("lw_sum") >= F.lit(float(cut))).count()
    last = kth_largest(table, "lw_q", k)
    kept = F.col("lw_q") >= F.lit(last) if last is not None else F.lit(False)
    return table.select(*cols, F.col("lw_sum").alias("log_weight"), (F.col("lw_sum") / (F.col("lw_grams") + 5.0)).alias("score"), kept.alias("kept"))
