"""Toxicity scores: boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._letters import DIGIT, LETTER, OPENINGS, PUNCT, SYMBOL, UPPER, Letters, letters, pieces, term_hash
from ._shared import row_slices, workspace
from ._words import Found, U

# Second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deiner deinem deinen ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro vuestra".split())
FEATURES = ["words", "lexicon_density", "lexicon_hits", "lexicon_weight", "strongest", "second_person", "proximity", "capitals", "capital_words", "exclamations", "questions", "punctuation", "symbols", "obfuscated", "stretched", "digits"]
NEAR = 5


def _terms(x: Letters) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of the openings of longer ones, and which words they are of."""
    parts = [x.hashes(n) for n in (0, *OPENINGS)]
    return np.concatenate([h for h, _ in parts]), np.concatenate([at for _, at in parts])


class Lexicon:
    """Terms (by hash) and their weights: log ratios of how often toxic and other texts hold them.
    A term is a word, or the first 4, 5 or 6 letters of a longer one."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        self.terms = Found(hashes.astype(U), weights.astype(np.float64))
        you = np.concatenate([term_hash(w) for w in sorted(SECOND_PERSON)])
        self.you = Found(you, np.ones(len(you)))

    @classmethod
    def of(cls, weights: dict[str, float]) -> Lexicon:
        """From terms in plain, openings with ``~`` at their end."""
        return cls(np.concatenate([np.zeros(0, U), *(term_hash(t) for t in weights)]), np.array(list(weights.values())))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row of :data:`FEATURES` for each text. Very long texts are looked at in pieces, whose
        counts add up; a hit and a second person in two pieces are not near each other."""
        parts, of = pieces(texts)
        x, n = letters(parts), len(parts)
        owner = x.owner(x.begin)
        count = lambda at: np.bincount(x.owner(at), minlength=n)
        per_word = lambda at: np.bincount(owner[at], minlength=n)
        weight = np.zeros(len(x.begin))
        for k in (0, *OPENINGS):
            h, at = x.hashes(k)
            i, w = self.terms.of(h)
            np.maximum.at(weight, at[i], w)
        hits, you = np.flatnonzero(weight > 0), self.you.of(x.hashes()[0])[0]
        k = np.searchsorted(you, hits)
        near = np.zeros(len(hits), bool)
        if len(you):
            for peer in (you[np.minimum(k, len(you) - 1)], you[np.maximum(k - 1, 0)]):
                near |= (np.abs(peer - hits) <= NEAR) & (owner[peer] == owner[hits])
        strongest = np.zeros(n)
        np.maximum.at(strongest, owner[hits], weight[hits])
        capitals = np.concatenate([[0], np.cumsum((x.kinds & UPPER) > 0, dtype=np.int64)])
        size = x.end - x.begin
        shouted = np.flatnonzero((size > 1) & (capitals[x.end] - capitals[x.begin] == size))
        same = (x.low[1:] == x.low[:-1]) & ((x.kinds[1:] & LETTER) > 0)
        three = np.flatnonzero(same[1:] & same[:-1])
        stretched = three[np.append(True, np.diff(three) > 1)[: len(three)]]
        sums = [
            np.bincount(owner, minlength=n), per_word(hits), np.bincount(owner[hits], weights=weight[hits], minlength=n), per_word(you), per_word(hits[near]),
            x.per_text(UPPER), per_word(shouted), count(np.flatnonzero(x.cp == ord("!"))), count(np.flatnonzero(x.cp == ord("?"))), x.per_text(PUNCT), x.per_text(SYMBOL),
            count(x.disguised), count(stretched), x.per_text(DIGIT), np.array([len(p) for p in parts]),
        ]
        words, hit, total, second, close, upper, loud, exclaim, ask, punct, symbol, mixed, long, digit, chars = (np.bincount(of, weights=s, minlength=len(texts)) for s in sums)
        most = np.zeros(len(texts))
        np.maximum.at(most, of, strongest)
        w, c = np.maximum(1, words), np.maximum(1, chars)
        columns = [np.log1p(words), hit / w, np.log1p(hit), total / w, most, second / w, close / np.maximum(1, hit), upper / c, loud / w, exclaim / w, ask / w, punct / c, symbol / c, mixed / w, long / w, digit / c]
        return np.stack(columns, axis=1)


def _count_terms(batches):
    """Of rows text, label: for each term the texts of either label that hold it."""
    for batch in batches:
        for part in row_slices(batch, 0):
            texts, of = pieces(part.column(0).to_pylist())
            x = letters(texts)
            h, at = _terms(x)
            owner = of[x.owner(x.begin[at])]
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            once = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)]
            h, label = h[once], part.column(1).to_numpy()[owner[once]]
            if len(h):
                start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                cols = [h[start].view(np.int64), np.add.reduceat(label == 1, start, dtype=np.int64), np.add.reduceat(label == 0, start, dtype=np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["term", "toxic", "other"])


def learn_lexicon(rows: DataFrame, most: int = 400, least: int = 4, ratio: float = 6.0) -> Lexicon:
    """From columns ``t`` and ``y``: the ``most`` terms that toxic texts hold at least ``least``
    times and ``ratio`` times as often as others. Counted in Spark; only those terms are collected."""
    size = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    counts = rows.select("t", "y").mapInArrow(_count_terms, "term long, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    r = ((F.col("toxic") + 0.5) / (size.get(1, 0) + 1.0)) / ((F.col("other") + 0.5) / (size.get(0, 0) + 1.0))
    best = counts.where(F.col("toxic") >= least).withColumn("r", r).where(F.col("r") >= ratio)
    best = best.orderBy((F.col("toxic") * F.log("r")).desc(), "term").limit(most).select("term", F.log("r").alias("w")).collect() if size.get(1) else []
    return Lexicon(np.array([x.term for x in best], np.int64).view(U), np.array([x.w for x in best], np.float64))


def featurize(docs: DataFrame, lexicon: Lexicon, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``lw_features``, an array of :data:`FEATURES`."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # `most` terms

    def run(batches):
        for batch in batches:
            for part in row_slices(batch, batch.num_columns - 1):
                x = shared.value.features(part.column(part.num_columns - 1).to_pylist())
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], rows], [*part.schema.names[:-1], "lw_features"])

    out = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lw_features", T.ArrayType(T.DoubleType()))])
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("lw_text")).mapInArrow(run, out)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: object | None
    isotonic: object | None
    base: float


def fit(train: DataFrame, text: str = "text", label: str = "toxic", max_docs: int = 20_000, rounds: int = 20, depth: int = 4) -> ToxicityModel:
    """Fit on about ``max_docs`` labelled rows (label 0 or 1), picked by a hash of the text; rows
    with equal text and label count once, so that no group of copies fills the sample.

    The rows' texts fall into three parts by another hash: the lexicon is learned from one half,
    the trees from the other half's first two thirds, and the calibration from its last third, so
    no later step sees texts that an earlier one has learned by heart. Rows with a null label are
    left out. With one label only, or no rows, the model gives the share of label 1 (0 if none).
    """
    with workspace(train.sparkSession, "toxicity") as table:
        return _fit(train, text, label, max_docs, rounds, depth, table)


def _fit(train: DataFrame, text: str, label: str, max_docs: int, rounds: int, depth: int, table) -> ToxicityModel:
    rows = train.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"), F.col(f"`{label}`").cast("int").alias("y")).where("y in (0, 1)")
    total = rows.count()
    if total > max_docs:
        rows = rows.where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < max(1, max_docs * (1 << 20) // total))
    rows = table(rows.dropDuplicates(["t", "y"]).withColumn("fold", F.pmod(F.xxhash64("t", F.lit(7)), F.lit(6))), "toxicity-sample")
    lexicon = learn_lexicon(rows.where("fold < 3"))
    features = table(featurize(rows, lexicon, "t", ["y", "fold"]).withColumn("features", array_to_vector("lw_features")).withColumn("label", F.col("y").cast("double")), "toxicity-features")
    counts = {r.y: r.n for r in features.groupBy("y").agg(F.count("*").alias("n")).collect()}
    base = counts.get(1, 0) / max(1, sum(counts.values()))
    grown, held = features.where("fold in (3, 4)"), features.where("fold = 5")
    if grown.select("y").distinct().count() < 2:
        return ToxicityModel(lexicon, None, None, base)
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, minInstancesPerNode=3, seed=1).fit(grown.coalesce(1))
    iso = None
    if held.select("y").distinct().count() == 2:
        raw = trees.transform(held).select("label", vector_to_array("probability")[1].alias("p"))
        iso = IsotonicRegression(featuresCol="p").fit(raw.coalesce(1))
    return ToxicityModel(lexicon, trees, iso, base)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (None: all but the text) with ``score`` and ``predicted``.

    ``score`` is from 0 to 1, higher where label 1 is likelier; ``predicted`` is 1 from 0.5 on.
    The calibrated value counts for 99 parts and the trees' own for 1, so that texts within one
    step of the calibration keep their order. A null text counts as empty and is scored as well;
    repeated rows get the same score, no rows give no rows.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c not in ("score", "predicted")]
    cols = [F.col(f"`{c}`") for c in keep]
    if model.trees is None:
        scored = docs.select(*cols, F.lit(float(model.base)).alias("score"))
    else:
        x = featurize(docs, model.lexicon, text, keep).select(*cols, array_to_vector("lw_features").alias("features"))
        x = model.trees.transform(x).select(*cols, vector_to_array("probability")[1].alias("lw_p"))
        s: Column = F.col("lw_p")
        if model.isotonic is not None:
            x = model.isotonic.setFeaturesCol("lw_p").setPredictionCol("lw_iso").transform(x)
            s = 0.99 * F.col("lw_iso") + 0.01 * F.col("lw_p")
        scored = x.select(*cols, F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
