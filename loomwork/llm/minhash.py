"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._shared import digest, row_slices, workspace, written
from ._words import Found, U, mix, shingles, stream, words

TABLE = 1 << 16


def _uniform(seed: int, n: int) -> np.ndarray:
    return ((stream(seed, n) >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)


@dataclass
class Weights:
    """``common``: the inverse document frequencies of frequent shingles; all others have ``rare``."""

    common: Found
    rare: float
    size: int

    def sets(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles of each text, sorted, their weights, and where each text begins."""
        s, of, count = distinct(column, self.size)
        idf = np.full(len(s), self.rare)
        at, known = self.common.of(s)
        idf[at] = known
        return s, (1 + np.log(count)) * idf, np.searchsorted(of, np.arange(len(column) + 1))


def distinct(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, each one's text and how often it stands there."""
    s, of = shingles(words(column), size)
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return s[at], of[at], np.diff(np.append(at, len(s)))


def idf(share: np.ndarray, least: float, damping: float) -> np.ndarray:
    """From 1 (in every document) to 1 + ``damping`` (in a ``least`` share of them, or fewer)."""
    return 1 + damping * np.log(np.maximum(share, least)) / np.log(least)


@dataclass
class Sampler:
    """Improved consistent weighted sampling (Ioffe): for each hash k and shingle s, r and c from
    Gamma(2, 1) and b uniform; t = floor(ln w / r + b); the shingle with the least
    ln c - r (t + 1 - b) is the sample, with its t. Two texts agree in a sample with the
    probability of their weighted Jaccard similarity. The draws come from tables of 2**16
    entries, reached by a hash of s that differs from k to k."""

    hashes: int

    def __post_init__(self):
        n = TABLE
        self.r = -(np.log(_uniform(31, n)) + np.log(_uniform(32, n)))
        self.log_c = np.log(-(np.log(_uniform(33, n)) + np.log(_uniform(34, n))))
        self.b = _uniform(35, n)
        self.factor = stream(36, self.hashes) | U(1)

    def signatures(self, s: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A row of ``hashes`` 32-bit samples for each text that has a shingle."""
        full = np.flatnonzero(np.diff(first) > 0)
        starts = first[:-1][full]
        of = np.repeat(np.arange(len(full)), np.diff(first)[full])
        log_w, out = np.log(weight), np.empty((len(full), self.hashes), np.int32)
        with np.errstate(over="ignore"):
            for k in range(self.hashes):
                x = s * self.factor[k]
                i = (x >> U(48)).astype(np.intp)
                r, b = self.r[i], self.b[i]
                t = np.floor(log_w / r + b)
                score = self.log_c[i] - r * (t + 1 - b)
                least = np.minimum.reduceat(score, starts)
                at = np.flatnonzero(score == least[of])
                sample = mix(x[at] ^ (t[at].astype(np.int64).astype(U) * U(0x9E3779B97F4A7C15)))
                own = of[at]
                one = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                out[:, k] = (np.minimum.reduceat(sample, one) >> U(32)).astype(np.uint32).view(np.int32)
        return out


BLOCK = 1 << 22  # shingles looked at together
BLOCK_DOCS, BLOCK_BYTES = 1 << 13, 1 << 26  # a task gets about so many texts or bytes at least


def _counts(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(np.concatenate(x))
    at = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
    return s[at], np.diff(np.append(at, len(s)))


def _shingle_counts(s: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n.astype(np.int64))], ["s", "n"])


def _often_here(size: int, share: float):
    """Shingles that more than half of ``share`` of a block's documents hold, and how many do.

    A block is named only when the next one is full, and what is left at the end joins the last: a
    rest of a few texts would name all that they hold."""

    def named(block, docs):
        s, c = _counts(block)
        return _shingle_counts(s[c >= share * docs / 2], c[c >= share * docs / 2])

    def run(batches):
        last, last_docs = [np.zeros(0, U)], 0
        held, n, docs = [np.zeros(0, U)], 0, 0
        for batch in batches:
            for part in row_slices(batch, 0):
                s, _, _ = distinct(part.column(0), size)
                held.append(s)
                n, docs = n + len(s), docs + part.num_rows
                if n >= BLOCK:
                    if last_docs:
                        yield named(last, last_docs)
                    last, last_docs = held, docs
                    held, n, docs = [np.zeros(0, U)], 0, 0
        yield named(last + held, last_docs + docs)

    return run


def _known_here(size: int, known):
    """How many of a task's documents hold each of the ``known`` shingles."""

    def run(batches):
        found = Found(known.value, np.arange(len(known.value)))
        sums = np.zeros(len(known.value), np.int64)
        for batch in batches:
            for part in row_slices(batch, 0):
                s, _, _ = distinct(part.column(0), size)
                sums += np.bincount(found.of(s)[1], minlength=len(sums))
        yield _shingle_counts(known.value[sums > 0], sums[sums > 0])

    return run


def frequent_shingles(texts: DataFrame, n: int, total: int, size: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that at least ``share`` of all ``n`` texts (of ``total`` bytes) hold, and exactly
    how many do.

    Texts are read twice. First each block of texts names the shingles that it holds in half of
    ``share`` or more of its own: what no block names is rarer than half of ``share``, and a sum of
    named counts falls short by less than that. So at most 2 / ``share`` shingles for each one of a mean
    document reach the driver (150,000 at 300 a document), however many documents there are; then
    all texts are counted for these. Blocks of a few texts would name all that they hold, so small
    partitions are read together."""
    spark = texts.sparkSession
    some = texts.coalesce(max(1, n // BLOCK_DOCS, total // BLOCK_BYTES))
    named = some.mapInArrow(_often_here(size, share), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= share * n / 2)
    known = spark.sparkContext.broadcast(np.sort(named.select("s").toPandas()["s"].to_numpy(np.int64).view(U)))
    counted = texts.mapInArrow(_known_here(size, known), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= share * n).toPandas()
    return counted["s"].to_numpy(np.int64).view(U), counted["n"].to_numpy(np.int64)


def _sign(weights, bands: int, rows: int):
    def run(batches):
        sampler, w = Sampler(bands * rows), weights.value
        for batch in batches:
            for part in row_slices(batch, 2):
                s, weight, first = w.sets(part.column(2))
                full = np.flatnonzero(np.diff(first) > 0)
                if not len(full):
                    continue
                sig = sampler.signatures(s, weight, first)
                key = np.empty((len(full), bands), np.int64)
                with np.errstate(over="ignore"):
                    for b in range(bands):
                        h = np.full(len(full), b + 1, U)
                        for k in range(rows):
                            h = mix(h * U(0x9E3779B97F4A7C15) + sig[:, b * rows + k].view(np.uint32).astype(U))
                        key[:, b] = h.view(np.int64)
                take = pa.array(full)
                lists = lambda m, n: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, n, dtype=np.int32)), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), lists(key, bands), lists(sig, bands * rows), pa.array(np.add.reduceat(weight, first[:-1][full])), pc.binary_length(part.column(2).take(take)).cast(pa.int64())], ["node", "lw_digest", "keys", "sig", "total", "bytes"])

    return run


def weighted_jaccard(s: np.ndarray, v: np.ndarray, t: np.ndarray, w: np.ndarray) -> float:
    _, i, j = np.intersect1d(s, t, assume_unique=True, return_indices=True)
    low = np.minimum(v[i], w[j]).sum()
    return float(low / (v.sum() + w.sum() - low))


def _verify(weights, threshold: float):
    def run(batches):
        w = weights.value
        for batch in batches:
            for part in row_slices(batch, 2):
                a, b = w.sets(part.column(2)), w.sets(part.column(3))
                cut = lambda x, k: (x[0][x[2][k] : x[2][k + 1]], x[1][x[2][k] : x[2][k + 1]])
                ok = [k for k in range(part.num_rows) if weighted_jaccard(*cut(a, k), *cut(b, k)) >= threshold]
                take = pa.array(ok, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take)], ["a", "b"])

    return run


def _across(weights, threshold: float, least: int):
    """Links between one block of rows outside the hub's component and one block of all rows.

    Only rows of different components are held against each other, those whose signatures agree
    most first, and what a link joins is one component from then on: so the links are a forest."""

    def run(table: pa.Table) -> pa.Table:
        node, comp, own, total = (table[c].to_numpy() for c in ("node", "comp", "own", "total"))
        sig = np.array(table["sig"].to_pylist(), np.int32)
        s, v, first = weights.value.sets(table["t"].combine_chunks())
        cut = lambda k: (s[first[k] : first[k + 1]], v[first[k] : first[k + 1]])
        p, q = np.flatnonzero(own), np.flatnonzero(~own)
        maybe = []
        for i in p:
            agree = (sig[q] == sig[i]).sum(axis=1)
            sizes = np.minimum(total[q], total[i]) >= threshold * np.maximum(total[q], total[i]) - 1e-9
            at = np.flatnonzero((agree >= least) & sizes & (comp[q] != comp[i]))
            maybe.append(np.stack([agree[at], np.full(len(at), i), q[at]]))
        maybe = np.concatenate(maybe, axis=1) if maybe else np.zeros((3, 0), np.int64)
        maybe = maybe[:, np.argsort(-maybe[0], kind="stable")]
        lead: dict[int, int] = {}

        def root(x: int) -> int:
            while x in lead:
                x = lead[x]
            return x

        links = []
        for i, j in maybe[1:].T.tolist():
            a, b = root(int(comp[i])), root(int(comp[j]))
            if a != b and weighted_jaccard(*cut(i), *cut(j)) >= threshold:
                lead[max(a, b)] = min(a, b)
                links.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8,
    bands: int = 16, rows: int = 3, damping: float = 0.25, frequent: float = 1 / 256, block: int = 256, block_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``class_id`` (the smallest key of its group), ``kept``.

    Two texts are linked if the weighted Jaccard similarity of their shingles of ``size`` words is
    ``threshold`` or more; a shingle weighs (1 + ln count) times an inverse document frequency.
    Shingles that at least ``frequent`` of all texts hold are counted exactly over all texts; their
    idf goes, with the log of that share, from 1 + ``damping`` down to 1 for one in every text. All
    rarer ones have 1 + ``damping``. So a weight depends on shares, not on the size of the corpus,
    and what is broadcast is bounded, see :func:`frequent_shingles`. Groups are connected components.

    Equal texts are one node. Each text gets ``bands * rows`` consistent weighted samples; texts
    that agree in a whole band share a bucket. First every member of a bucket is held against the
    bucket's smallest key, so that a group of copies costs a pair for each member. Then, in
    buckets whose members have not all become one component, members outside the smallest key's
    component are held against all others of other components, in blocks of about ``block`` rows and
    ``block_bytes`` at most, whose tasks return a forest of links, not pairs. A pair's texts are compared only if its signatures agree
    in 2 samples of 5 (at similarity 0.8 all but one pair in a million) and its total weights
    allow the threshold; only the exact similarity of the whole texts makes a link. No bucket, and
    no number of partners, is cut off. At similarity 0.8 a pair of texts misses all 16 bands once
    in 100,000 times.

    A null or empty text, or one without words, has no shingle: it is a group of its own, as is a
    row with a null key (null class, kept). Shorter texts have one shingle of all words. Rows that
    share a key are one document, whose texts are all compared. Repeated rows are all ``kept`` or
    not. Other columns are not read; no rows give no rows.
    """
    with workspace(docs.sparkSession, "minhash") as table:
        return written(_classes(docs, key, text, size, threshold, bands, rows, damping, frequent, block, block_bytes, table), "near-duplicate-classes")


def _classes(docs: DataFrame, key: str, text: str, size: int, threshold: float, bands: int, rows: int, damping: float, frequent: float, block: int, block_bytes: int, table) -> DataFrame:
    spark = docs.sparkSession
    id_ = F.col(f"`{key}`").cast("long")
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows_ = docs.select(id_.alias("id"), digest(own).alias("lw_digest"), own.alias("t"))
    n, total = rows_.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0))).first()
    common, df = frequent_shingles(rows_.select("t"), n, total, size, frequent)
    weights = spark.sparkContext.broadcast(Weights(Found(common, idf(df / max(1, n), frequent, damping)), 1 + damping, size))
    signed = rows_.where("id is not null").mapInArrow(_sign(weights, bands, rows), "node long, lw_digest binary, keys array<long>, sig array<int>, total double, bytes long")
    nodes = signed.groupBy("lw_digest").agg(F.min("node").alias("node"), *(F.first(c).alias(c) for c in ("keys", "sig", "total", "bytes")))
    nodes = table(nodes, "signatures")
    # Buckets of two or more nodes, and their smallest.
    met = nodes.select("node", F.explode("keys").alias("bucket")).distinct()
    hubs = met.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    met = table(met.join(hubs, "bucket"), "buckets")
    least = bands * rows * 2 // 5
    texts = docs.select(id_.alias("id"), digest(own).alias("lw_digest"), own.alias("t"))

    def texts_of(named: DataFrame, name: str) -> DataFrame:
        one = nodes.select("node", "lw_digest").join(named.distinct(), "node")
        whole = texts.join(one, (texts["id"] == one["node"]) & (texts["lw_digest"] == one["lw_digest"]), "left_semi")
        return table(whole.groupBy("id", "lw_digest").agg(F.first("t").alias("t")).select(F.col("id").alias("node"), "t"), name)

    marks = nodes.select("node", "sig", "total")
    pairs = met.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    for x in ("a", "b"):
        pairs = pairs.join(marks.select(F.col("node").alias(x), F.col("sig").alias(f"s{x}"), F.col("total").alias(f"n{x}")), x)
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    sizes = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9
    pairs = table(pairs.where((agree >= least) & sizes).select("a", "b"), "candidates")
    whole = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), "candidate-texts")
    both = pairs.join(whole.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(whole.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
    links = table(both.select("a", "b", "ta", "tb").mapInArrow(_verify(weights, threshold), "a long, b long").distinct(), "links")
    # What is still apart in a bucket of three or more; buckets with the same members are one.
    comp = components(links, table=table)
    placed = met.where("n > 2").join(comp, "node", "left").join(nodes.select("node", "bytes"), "node").select("bucket", "node", "hub", "n", "bytes", F.coalesce("component", "node").alias("comp"))
    hub_comp = placed.where("node = hub").select("bucket", F.col("comp").alias("hub_comp"))
    outside = F.col("comp") != F.col("hub_comp")
    parts = {"nb": F.greatest(F.count_if(outside) / block, F.sum(F.when(outside, F.col("bytes"))) / block_bytes), "mb": F.greatest(F.count("*") / block, F.sum("bytes") / block_bytes)}
    split = placed.join(hub_comp, "bucket").groupBy("bucket", "hub", "hub_comp", "n").agg(F.count_if(outside).alias("out"), *(F.ceil(x).cast("int").alias(c) for c, x in parts.items()), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all")).where("out > 0")
    split = split.groupBy("hub", "n", "all").agg(F.min(F.struct("bucket", "hub_comp", "nb", "mb")).alias("s")).select("s.*")
    placed = table(placed.join(split, "bucket"), "split-buckets")
    if not placed.isEmpty():
        left = texts_of(placed.select("node"), "split-texts").join(marks, "node")
        salt = lambda m: F.pmod(F.xxhash64("node", F.lit(5)), F.col(m)).cast("int")
        cols = ["node", "bucket", "comp"]
        a = placed.where("comp <> hub_comp").select(*cols, F.lit(True).alias("own"), salt("nb").alias("x"), F.explode(F.expr("sequence(0, mb - 1)")).alias("y"))
        b = placed.select(*cols, F.lit(False).alias("own"), F.explode(F.expr("sequence(0, nb - 1)")).alias("x"), salt("mb").alias("y"))
        more = a.unionByName(b).join(left, "node").groupBy("bucket", "x", "y").applyInArrow(_across(weights, threshold, least), "a long, b long")
        comp = components(links.unionByName(table(more, "more-links")), table=table)
    # Copies of a text without words stay apart.
    of = nodes.select("lw_digest", "node").join(comp, "node", "left").select("lw_digest", F.coalesce("component", "node").alias("c"))
    ids = docs.select(id_.alias("id"), digest(own).alias("lw_digest"))
    out = ids.join(of, "lw_digest", "left").select("id", F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("c"))
    return out.select(F.col("id").alias(key), F.col("c").alias("class_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of :func:`near_duplicates` the document with
    the smallest key. Of repeated rows (same key and text) one stays; rows with a null key stay."""
    found = near_duplicates(docs, key, text, **how)
    gone = written(found.where(~F.col("kept")).select(F.col(key).alias("lw_gone")).distinct(), "near-duplicates")
    left = docs.join(gone, F.col(f"`{key}`").cast("long") == F.col("lw_gone"), "left_anti")
    twice = docs.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`")).count().where("count > 1")
    if twice.isEmpty():
        return left
    named = left.where(F.col(f"`{key}`").isNotNull()).dropDuplicates([key, text])
    return named.unionByName(left.where(F.col(f"`{key}`").isNull()))
