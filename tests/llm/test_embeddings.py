"""Embedding near-dedup against all pairs."""

import numpy as np

from loomwork.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, threshold):
    n = len(rows)
    ok, unit = [], []
    for _, v in rows:
        x = None if v is None or any(c is None for c in v) else np.array(v, np.float64)
        good = x is not None and len(x) and np.isfinite(x).all() and x.any()
        ok.append(bool(good))
        unit.append(x / np.linalg.norm(x) if good else None)
    lead = list(range(n))

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][0] is not None and rows[j][0] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                lead[root(j)] = root(i)
    groups = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(rows[i][0])
    return [(rows[i][0], links[i], min((x for x in groups[root(i)] if x is not None), default=None)) for i in range(n)]


def test_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(60):
        c = rng.normal(size=16)
        vectors.append(c)
        for _ in range(rng.integers(0, 5)):
            vectors.append(c + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.25]) * np.linalg.norm(c) / 4)
    hot = rng.normal(size=16)
    vectors += [hot] * 40 + [hot * 3] * 3
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0] * 15 + [float("nan")]), (904, [1.0] * 15 + [None]), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [float("inf")] * 16), (None, hot.tolist())]
    df = spark.createDataFrame([(i, v, None, "x") for i, v in rows], SCHEMA).repartition(4)
    got = embeddings.near_duplicates(df, cells=8, margin=0.32, own_block=16, other_block=24).collect()
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute(rows, 0.95), key=key)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_default_margin_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(table).collect()}
    want = {i: (n, c) for i, n, c in brute([(r.vec_id, r.embedding) for r in table.collect()], 0.95)}
    assert got == want


def test_default_margin_loses_no_direction(spark):
    rng = np.random.default_rng(4)
    flat = rng.normal(size=(200, 3))
    base, way = rng.normal(size=(60, 16)), rng.normal(size=16)
    base[:, 0] *= 3
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    vectors = [*flat, *base, *(base + 0.3 * way / np.linalg.norm(way))]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(i, v, None, "x") for i, v in rows], SCHEMA).repartition(4)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect())
    assert got == sorted(brute(rows, 0.95))


def test_shared_keys_and_no_rows(spark):
    rows = [(1, [1.0, 0.0], 0, ""), (1, [0.0, 1.0], 0, ""), (2, [0.0, 1.0], 0, ""), (3, [1.0, 0.01], 0, "")]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component_id for r in got} == {1} and len(got) == 4
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
