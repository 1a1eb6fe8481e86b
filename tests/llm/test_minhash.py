"""MinHash near-dedup against all pairs."""

import math
import random
import re
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from loomwork.llm import minhash
from loomwork.llm._graph import components

from .common import no_docs, odd_docs

SCHEMA = "doc_id long, text string"


def brute(rows, threshold=0.8, damping=0.25, frequent=1 / 256):
    """Groups by the similarities of all pairs, in plain Python."""
    held = []
    for _, t in rows:
        w = re.findall(rb"[^\x00-\x20]+", (t or "").encode().lower())
        held.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    df = Counter(s for h in held for s in h)
    idf = lambda s: 1 + damping * math.log(max(df[s] / len(rows), frequent)) / math.log(frequent)
    sets = [{s: (1 + math.log(n)) * idf(s) for s, n in h.items()} for h in held]
    lead = {i: i for i, _ in rows}

    def root(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        low = sum(min(x[s], y[s]) for s in x.keys() & y.keys())
        if low and low / (sum(x.values()) + sum(y.values()) - low) >= threshold:
            p, q = root(rows[a][0]), root(rows[b][0])
            lead[max(p, q)] = min(p, q)
    return {i: root(i) for i, _ in rows}


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 60, 150]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            near = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near))
    # A hub whose copies are near it, but not near each other.
    base = [rng.choice(vocabulary) for _ in range(200)]
    for k in range(40):
        near = list(base)
        for _ in range(3):
            near[rng.randrange(200)] = rng.choice(vocabulary)
        texts.append(" ".join(near))
    texts.append(" ".join(base))
    return list(enumerate(texts))


@pytest.mark.parametrize("sizes", [{}, {"block": 8}, {"block_bytes": 4000}])
def test_against_all_pairs(spark, sizes):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, **sizes).collect()}
    assert got == brute(rows) and len(set(got.values())) < len(rows) - 60


def test_frequent_shingles_are_counted_exactly(spark, monkeypatch):
    rng = random.Random(8)
    common = [f"c{k}" for k in range(12)]
    texts = [" ".join(f"u{rng.random()}" for _ in range(6)) + " " + " ".join(common[: rng.choice([3, 5, 8, 12])]) for _ in range(400)]
    monkeypatch.setattr(minhash, "BLOCK", 50)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 50)
    held = Counter(x for t in texts for x in minhash.distinct(pa.array([t]), 5)[0].tolist())
    for parts in (1, 7):
        s, n = minhash.frequent_shingles(spark.createDataFrame([(t,) for t in texts], "t string").repartition(parts), 400, 40_000, 5, 0.05)
        assert dict(zip(s.tolist(), n.tolist())) == {x: c for x, c in held.items() if c >= 20} and len(s) == 8


def test_samples_agree_as_often_as_texts_are_alike():
    rng = random.Random(1)
    a = [str(rng.random()) for _ in range(300)]
    b = a[:250] + [str(rng.random()) for _ in range(50)]
    column = pa.array([" ".join(a), " ".join(b)])
    some = minhash.distinct(column, 5)[0][::3]
    s, v, first = minhash.Weights(minhash.Found(some, np.linspace(1, 2, len(some))), 1.5, 5).sets(column)
    sig = minhash.Sampler(2000).signatures(s, v, first)
    want = minhash.weighted_jaccard(s[: first[1]], v[: first[1]], s[first[1] :], v[first[1] :])
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_odd_rows(spark):
    odd = odd_docs(spark)
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    classes = {}
    for r in got:
        classes.setdefault(r.doc_id, set()).add((r.class_id, r.kept))
    assert classes[1] == {(1, True)} and classes[2] == {(1, False)} and classes[10] == {(9, False)}
    assert all(classes[i] == {(i, True)} for i in (3, 4, 5, 6, 7, 8, 9, 11)) and classes[None] == {(None, True)}
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8, 9, 11]
    assert kept.where("doc_id is null").count() == 2
    assert minhash.near_duplicates(no_docs(spark)).count() == 0


def test_nothing_but_the_result_stays(spark):
    top = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    tables = lambda: {p.parent for p in top.rglob("*.parquet") if p.stat().st_size > 1000}
    before = tables()
    assert minhash.near_duplicates(spark.createDataFrame(corpus()[:60], SCHEMA)).count() == 60
    assert {p.name.rsplit("-", 1)[0] for p in tables() - before} == {"near-duplicate-classes"}


def test_components(spark):
    rng = random.Random(9)
    links = [(k, k + 1) for k in range(100, 130)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, k) for k in range(201, 260)] + [(5, 5)]
    lead = {}

    def root(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            lead[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(lead)}


def test_unfinished_components_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(chain, rounds=1)


def test_the_rest_of_a_task_names_only_frequent_shingles(monkeypatch):
    """Also where the last texts of a task fall into a block that they do not fill."""
    import pyarrow as pa

    monkeypatch.setattr(minhash, "BLOCK", 4000)
    texts = [f"these five words come often w{k} x{k} y{k} z{k} v{k} u{k}" for k in range(590)]
    batches = lambda: (pa.RecordBatch.from_arrays([pa.array(texts[k : k + 10])], ["t"]) for k in range(0, len(texts), 10))
    found = pa.Table.from_batches(list(minhash._often_here(5, 0.05)(batches())))
    named = {}
    for r in found.to_pylist():
        named[r["s"]] = named.get(r["s"], 0) + r["n"]
    assert list(named.values()) == [590]
