"""Near-duplicates among embeddings: spherical k-means cells and blocked cosine products."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._shared import workspace, written

_ROW = "node long, cls long, many long, vec {kind}, home int, cells array<int>"


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """``k`` unit centroids (fewer where ``x`` has fewer rows)."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        a = (x @ c.T).argmax(axis=1)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        n = np.sqrt((s * s).sum(axis=1))
        c[n > 1e-12] = s[n > 1e-12] / n[n > 1e-12, None]
    return c


def assign(x: np.ndarray, c: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest cell of each unit row, and a mask of the cells it belongs to.

    Besides its own cell a row belongs to each one whose bisecting plane with it is no farther
    than ``margin``. The sum's last term covers rounding where two centroids nearly coincide.
    """
    p = x @ c.T
    home = p.argmax(axis=1)
    gap = np.maximum(np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T))), 1e-12)
    belongs = (p[np.arange(len(x)), home][:, None] - p) <= margin * gap[home] + 1e-7
    belongs[np.arange(len(x)), home] = True
    return home, belongs


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal lengths without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.list_value_length(column).to_numpy(zero_copy_only=False)


def _assigner(centroids, margin):
    def run(batches):
        for batch in batches:
            size = _lengths(batch.column(3))
            home, cells = np.zeros(len(size), np.int64), [[0]] * len(size)
            base = 0
            for dim in sorted(centroids.value):
                c = centroids.value[dim]
                at = np.flatnonzero(size == dim)
                if len(at):
                    h, b = assign(unit_rows(_matrix(batch.column(3).take(pa.array(at)))), c, margin)
                    home[at] = base + 1 + h
                    for i, row in zip(at, b):
                        cells[i] = (base + 1 + np.flatnonzero(row)).tolist()
                base += len(c)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], ["node", "cls", "many", "vec", "home", "cells"])

    return run


def _exact(x: np.ndarray, y: np.ndarray) -> float:
    dot = lambda a, b: math.fsum((a * b).tolist())
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def _compare(threshold: float):
    """One block of a cell's own rows against one block of rows that belong to the cell."""

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        own = t.filter(t["own"])
        other = t.filter(pc.invert(t["own"]))
        out = {"node": [], "cls": [], "links": [], "peer": []}
        if own.num_rows and other.num_rows:
            so, sp = _lengths(own["vec"].combine_chunks()), _lengths(other["vec"].combine_chunks())
            for dim in np.unique(so):
                a, b = own.take(pa.array(np.flatnonzero(so == dim))), other.take(pa.array(np.flatnonzero(sp == dim)))
                if b.num_rows:
                    _pairs(a, b, threshold, out)
        kinds = {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in out.items()}
        return pa.table(kinds)

    return run


def _pairs(a: pa.Table, b: pa.Table, threshold: float, out: dict) -> None:
    va, vb = _matrix(a["vec"].combine_chunks()), _matrix(b["vec"].combine_chunks())
    cos = unit_rows(va) @ unit_rows(vb).T
    i, j = np.nonzero(cos >= threshold - 1e-9)
    col = lambda t, n: t[n].to_numpy()
    na, nb, ca, cb = col(a, "node"), col(b, "node"), col(a, "cls"), col(b, "cls")
    ok = (na[i] != nb[j]) | (ca[i] != cb[j])
    edge = np.flatnonzero(ok & (np.abs(cos[i, j] - threshold) <= 1e-9))
    ok[edge] = [_exact(va[i[e]], vb[j[e]]) >= threshold for e in edge]
    i, j = i[ok], j[ok]
    if not len(i):
        return
    # A pair whose other row's own cell also holds this row is met there too, the other way round.
    cells = [set(x) for x in a["cells"].to_pylist()]
    homes = col(b, "home")
    once = np.array([homes[q] not in cells[p] for p, q in zip(i, j)])
    ma, mb = col(a, "many"), col(b, "many")
    la = np.bincount(i, weights=mb[j], minlength=len(na))
    lb = np.bincount(j[once], weights=ma[i[once]], minlength=len(nb))
    # A forest in place of all pairs: each row and the smallest node that pairs here reach.
    names, at = np.unique(np.concatenate([na[i], nb[j]]), return_inverse=True)
    p, q = at[: len(i)], at[len(i) :]
    root = np.arange(len(names))
    while True:
        new = root.copy()
        low = np.minimum(root[p], root[q])
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    peer = dict(zip(names.tolist(), names[root].tolist()))
    for n, c, links in ((na, ca, la), (nb, cb, lb)):
        hit = np.unique(i) if n is na else np.unique(j)
        out["node"].append(n[hit])
        out["cls"].append(c[hit])
        out["links"].append(links[hit])
        out["peer"].append(np.array([peer[x] for x in n[hit].tolist()]))


def near_duplicates(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, cells: int | None = None,
    margin: float | None = None, sample: int = 20_000, own_block: int = 1024, other_block: int = 4096,
) -> DataFrame:
    """One row per row of ``rows``: ``key``, ``n_links``, ``component_id``, ``kept``.

    Two vectors are linked if their cosine, in double precision, is at least ``threshold``.
    Spherical k-means over a sample (``sample`` vectors at most, picked by a hash) makes ``cells``
    centroids (None: the root of the number of vectors, from 8 to a fourth of ``sample``, so that
    each cell is learned from some vectors). A vector is compared as a
    member of its nearest cell with all vectors that belong to that cell, which are also those
    within ``margin`` of the plane that parts it from their own. The default is
    ``sqrt((1 - threshold) / 2)``, half the distance of two unit vectors at the threshold: of a pair
    in two cells one vector is at most that far from the plane between, so no link is lost
    whatever its direction. A smaller margin may lose links. No pair below the threshold is
    ever linked. Equal vectors are one class, compared once with its number of rows; a cell's rows
    are cut into blocks, and a block of own rows meets a block of others in a task of its own,
    which returns counts and a forest instead of the pairs. So neither a hot vector nor a hot
    cell gathers in one task.

    ``component_id`` is the smallest key that links reach, ``kept`` is true for that row. Vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
    vectors of other lengths with each other, nor rows with a null key (null component, kept).
    Rows that share a key are one node of the graph. Other columns are not read; no rows give no
    rows.
    """
    with workspace(rows.sparkSession, "embeddings") as table:
        return written(_classes(rows, key, vector, threshold, cells, margin, sample, own_block, other_block, table), "vector-groups")


def _classes(rows: DataFrame, key: str, vector: str, threshold: float, cells: int | None, margin: float | None, sample: int, own_block: int, other_block: int, table) -> DataFrame:
    spark = rows.sparkSession
    margin = math.sqrt(max(0.0, 1 - threshold) / 2) + 1e-6 if margin is None else margin
    kind = rows.schema[vector].dataType.simpleString()
    v = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    v = v.withColumns({"ok": F.coalesce(F.col("id").isNotNull() & finite, F.lit(False)), "cls": F.xxhash64("vec")})
    classes = v.where("ok").groupBy("cls", "vec").agg(F.min("id").alias("node"), F.count("*").alias("many")).select("node", "cls", "many", "vec")
    classes = table(classes, "vector-classes")
    n = classes.count()
    k = cells or max(8, min(sample // 4, math.isqrt(n)))
    # Spherical k-means on a bounded sample.
    part = classes.where(F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(1 << 20)) < sample * (1 << 20) // max(1, n)) if n > sample else classes
    by_dim: dict[int, list] = {}
    for r in part.select("vec").limit(2 * sample).collect():
        by_dim.setdefault(len(r.vec), []).append(r.vec)
    centroids = {d: spherical_kmeans(unit_rows(np.array(x, np.float64)), k) for d, x in by_dim.items()}
    shared = spark.sparkContext.broadcast(centroids)
    placed = table(classes.mapInArrow(_assigner(shared, margin), _ROW.format(kind=kind)), "vector-cells")
    # Blocks: one row a cell reaches the driver.
    own_n = {r.home: r.n for r in placed.groupBy("home").agg(F.count("*").alias("n")).collect()}
    all_n = {r.c: r.n for r in placed.select(F.explode("cells").alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()}
    plan = [(c, -(-own_n.get(c, 0) // own_block) or 1, -(-m // other_block) or 1) for c, m in all_n.items() if own_n.get(c)]
    blocks = F.broadcast(spark.createDataFrame(plan, "cell int, nb int, mb int"))
    base = ["node", "cls", "many", "vec", "home"]
    none = F.array().cast("array<int>")
    salt = lambda m: F.pmod(F.xxhash64("node", "cls", F.lit(9)), F.col(m)).cast("int")
    a = placed.withColumn("cell", F.col("home")).join(blocks, "cell").select("cell", salt("nb").alias("x"), F.explode(F.expr("sequence(0, mb - 1)")).alias("y"), F.lit(True).alias("own"), *base, "cells")
    b = placed.select(*base, F.explode("cells").alias("cell")).join(blocks, "cell").select("cell", F.explode(F.expr("sequence(0, nb - 1)")).alias("x"), salt("mb").alias("y"), F.lit(False).alias("own"), *base, none.alias("cells"))
    met = a.unionByName(b).groupBy("cell", "x", "y").applyInArrow(_compare(threshold), "node long, cls long, links long, peer long")
    met = table(met, "vector-links")
    links = met.groupBy("node", "cls").agg(F.sum("links").alias("links"))
    graph = components(met.select(F.col("node").alias("a"), F.col("peer").alias("b")), table=table)
    per_class = classes.join(links, ["node", "cls"], "left").select("node", "cls", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    same = classes.select("cls", "vec", "node")
    good = v.where("ok").join(same, ["cls", "vec"]).select("id", "cls", "node").join(per_class, ["node", "cls"])
    # Rows that share a key join their classes' components.
    own = table(good.join(graph, "node", "left").select("id", "cls", "n_links", F.coalesce("component", "node").alias("c")), "vector-components")
    shared_keys = own.groupBy("id").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    if not shared_keys.isEmpty():
        joined = components(own.select(F.col("id").alias("a"), F.col("c").alias("b")), table=table)
        own = own.join(joined, own["id"] == joined["node"], "left").select("id", "cls", "n_links", F.coalesce("component", "c").alias("c"))
    good = own.select(F.col("id").alias(key), "n_links", F.col("c").alias("component_id"), (F.col("id") == F.col("c")).alias("kept"))
    rest = v.where("not ok").select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return good.unionByName(rest)
