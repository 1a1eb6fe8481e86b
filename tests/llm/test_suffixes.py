"""Removal of long repeats against all windows of all texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomwork.llm import suffixes
from loomwork.llm._anchors import anchors, signs

from .common import no_docs, odd_docs, odd_rows

SCHEMA = "doc_id long, text string"


def brute(texts, span):
    raws = [(t or "").encode() for t in texts]
    held = Counter(r[i : i + span] for r in raws for i in range(len(r) - span + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - span + 1):
            if held[r[i : i + span]] > 1:
                gone[i : i + span] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone]) if r else b""
        runs = int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum()) if r else 0
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 8)))
    prose = lambda k: " ".join(word() for _ in range(k))
    hot = prose(40)
    texts = [None, "", "short", "short", "ab" * 150, "abc" * 40]
    for _ in range(n):
        t = prose(rng.randint(3, 90))
        if rng.random() < 0.5:
            at = rng.randrange(len(t) + 1)
            t = t[:at] + hot[rng.randrange(30) : len(hot) - rng.randrange(30)] + t[at:]
        texts.append(t)
        if rng.random() < 0.3:
            other = list(rng.choice(texts[6:]))
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(len(other))] = "#"
            texts.append("".join(other))
    return texts


@pytest.mark.parametrize("sizes", [{}, {"in_range": 25, "in_task": 10_000}, {"in_range": 25, "in_task": 3}])
def test_against_all_windows(spark, sizes):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df, span=64, gram=32, with_text=False, **sizes).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 64)
    assert sum(v[1] for v in got.values()) > 1000


def periodic(seed):
    rng = random.Random(seed)
    units = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(2)]
    texts = []
    for _ in range(rng.randint(2, 6)):
        t = ""
        for _ in range(rng.randint(1, 4)):
            t += "".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30)))
            u = rng.choice(units)
            t += (u * 200)[rng.randrange(len(u)) :][: rng.randint(0, 200)]
        texts.append(t)
    return texts


@pytest.mark.parametrize("span,gram", [(40, 20), (48, 24), (64, 32)])
def test_anchors_of_periodic_texts(span, gram):
    """Every string that occurs twice lies in a run, or shares an anchor's place with another."""
    for seed in range(60):
        texts = periodic(seed)
        of, p, _, _, _, (run_of, begin, end) = anchors(*signs(pa.array(texts), "bytes"), span, gram)
        held, runs, windows = defaultdict(set), defaultdict(list), defaultdict(list)
        for d, x in zip(of.tolist(), p.tolist()):
            held[d].add(x)
        for d, b, e in zip(run_of.tolist(), begin.tolist(), end.tolist()):
            runs[d].append((b, e))
        for d, t in enumerate(texts):
            for s in range(len(t) - span + 1):
                windows[t[s : s + span]].append((d, s))
        for places in windows.values():
            inside = [any(b <= s and s + span <= e for b, e in runs[d]) for d, s in places]
            if len(places) == 1:
                assert not inside[0]
                continue
            at = [{x - s for x in held[d] if s <= x <= s + span - gram} for d, s in places]
            for k in range(len(places)):
                assert inside[k] or any(at[k] & at[j] for j in range(len(places)) if j != k)


def test_periodic_texts_against_all_windows(spark):
    texts = [t for seed in range(12) for t in periodic(seed)]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df, span=64, gram=32, with_text=False).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 64)


def test_equal_windows_by_runs():
    rng = random.Random(2)
    base = [bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(6)]
    rows = [b[k:] + b[:k] for b in base for k in (0, 0, 7)]
    h = np.array([i % 2 for i in range(len(rows))], np.int64)
    left, right = [r[:10] for r in rows], [r[10:30] for r in rows]
    got = suffixes.equal_windows(h, left, right, 20, 10)
    for o in range(11):
        windows = Counter((h[i], left[i][:o], right[i][: 20 - o]) for i in range(len(rows)))
        assert got[:, o].tolist() == [windows[(h[i], left[i][:o], right[i][: 20 - o])] > 1 for i in range(len(rows))]


def test_multikey_quicksort_sorts():
    rng = random.Random(3)
    keys = [bytes(rng.choice(b"\0ab") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    assert [keys[i].ljust(30, b"\0") for i in suffixes.multikey_quicksort(keys)] == sorted(k.ljust(30, b"\0") for k in keys)


def plain_words(text):
    """Each word in lower case, with where it begins and ends."""
    raw = (text or "").encode()
    return [(m.group().lower(), *m.span()) for m in re.finditer(rb"[^\x00-\x20]+", raw)]


def brute_words(texts, span):
    """What is left of each text; a text that occurs twice goes whole."""
    rows = [plain_words(t) for t in texts]
    held = Counter(tuple(x[0] for x in r[i : i + span]) for r in rows for i in range(len(r) - span + 1))
    out = []
    for t, r in zip(texts, rows):
        raw, gone = (t or "").encode(), [False] * (len(r) + 1)
        for i in range(len(r) - span + 1):
            if held[tuple(x[0] for x in r[i : i + span])] > 1:
                gone[i : i + span] = [True] * span
        left, at = b"", 0
        for k, (_, b, e) in enumerate(r):
            if gone[k]:
                left += raw[at:b] if k == 0 or not gone[k - 1] else b""
                at = e
        left = b"" if texts.count(t) > 1 and len(r) >= span else left + raw[at:]
        out.append((len(raw), len(raw) - len(left), left.decode()))
    return out


@pytest.mark.parametrize("sizes", [{}, {"in_range": 25, "in_task": 10_000}, {"in_range": 25, "in_task": 3}])
def test_words_against_all_windows(spark, sizes):
    texts = [t and t.replace("a", "A", 2) if i % 3 else t for i, t in enumerate(corpus(5))]
    texts += ["so so " * 40, "we so so " + "so so " * 30, "one two three " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.text) for r in suffixes.remove_repeats(df, unit="words", span=8, gram=4, **sizes).collect()}
    assert [got[i] for i in range(len(texts))] == brute_words(texts, 8)
    assert sum(v[1] for v in got.values()) > 1000


@pytest.mark.parametrize("unit,span", [("bytes", 400), ("words", 50)])
def test_odd_rows(spark, unit, span):
    odd = odd_docs(spark).selectExpr("*", "'a' as k1", "'b' as k2", "'c' as n_bytes")
    rows = [(r[0], r[1]) for r in odd_rows()]
    out = suffixes.remove_repeats(odd, unit=unit, span=span, gram=span // 2).collect()
    brute_of = {"bytes": lambda t: brute(t, span), "words": lambda t: brute_words(t, span)}[unit]
    want = sorted((str(i), x[0], x[1]) for (i, _), x in zip(rows, brute_of([t for _, t in rows])))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in out) == want
    assert {(r.k1, r.k2, r.score) for r in out} == {("a", "b", "x")}
    assert suffixes.remove_repeats(no_docs(spark), unit=unit, span=span, gram=span // 2).count() == 0


def test_no_passage_of_over_50_words_is_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    left = suffixes.remove_repeats(docs, **suffixes.PASSAGES)
    seen = {}
    for name, df in (("before", docs), ("after", left)):
        where = defaultdict(set)
        for r in df.collect():
            words = [x[0] for x in plain_words(r.text)]
            for k in range(len(words) - 50):
                where[hash(tuple(words[k : k + 51]))].add(r.doc_id)
        seen[name] = sum(len(x) > 1 for x in where.values())
    assert seen["before"] > 1000 and seen["after"] == 0


def test_text_column_and_edge_cases(spark):
    rows = [(1, "x" * 30 + "é" * 40, "k"), (2, "é" * 40 + "y" * 30, "k"), (3, None, None), (None, "alone", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed string")
    got = {r.doc_id: r for r in suffixes.remove_repeats(df, span=64, gram=32).collect()}
    assert got[3].text == "" and got[3].n_bytes == 0 and got[3].n_removed == 0
    assert got[1].text.replace("x", "") == "" and got[1].n_removed == 80
    assert got[None].text == "alone"
    empty = suffixes.remove_repeats(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
