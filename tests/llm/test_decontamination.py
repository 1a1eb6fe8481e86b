"""Leaks against a search of every place, and the recall of edited items."""

import random

from loomwork.llm import decontamination as dc
from loomwork.llm.decontamination import find_leaks

from .common import no_docs, odd_docs

ITEMS = "item_id long, text string, leaks string"


def least(pattern, text):
    """Edit distance to the nearest substring, row by row."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        p, what = rng.randrange(len(t)), rng.random()
        if what < 0.34:
            t[p] = rng.choice("qrstuv")
        elif what < 0.67:
            del t[p]
        else:
            t.insert(p, rng.choice("qrstuv"))
    return "".join(t)


def test_nearest_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(60):
        p, t = words(rng, rng.randint(1, 6)), words(rng, rng.randint(0, 20))
        assert dc.nearest(p, t)[0] == least(p, t)


def test_against_every_place(spark):
    rng = random.Random(2)
    items = [(k, words(rng, rng.randint(12, 40))) for k in range(12)]
    docs, want = [], {}
    for d in range(80):
        k = rng.randrange(12)
        n = rng.choice([0, 0.03, 0.08, 0.12, None])
        middle = edited(rng, items[k][1], int(n * len(items[k][1]))) if n is not None else words(rng, 20)
        docs.append((d, words(rng, 30) + " " + middle.upper() + "\n " + words(rng, 25)))
    for d, t in docs:
        for k, x in items:
            dist = least(dc.normal(x), dc.normal(t))
            if dist <= int(0.2 * len(dc.normal(x))):
                want[d, k] = dist
    out = find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(k, x, "") for k, x in items], ITEMS), max_item_chars=700)
    got = {(r.doc_id, x.item_id): (x.distance, r.text, x.start, x.length) for r in out.collect() for x in r.leaks}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert all(v[0] >= want[k] for k, v in got.items())
    assert sum(got[k][0] == want[k] for k in got) >= 0.95 * len(got)
    exact = [(k, v) for k, v in got.items() if v[0] == 0]
    assert exact and all(dc.normal(v[1])[v[2] : v[2] + v[3]] == dict(items)[k[1]] for k, v in exact)


def test_all_edits_within_the_limit_are_found():
    rng = random.Random(7)
    items = [(k, words(rng, 40)[: n].strip()) for k, n in enumerate([5, 9, 14, 20, 27, 27, 44, 90, 150])]
    docs, want = [], []
    for k, x in items:
        x = dc.normal(x)
        even = "".join("z" if j % 8 == 4 else c for j, c in enumerate(x))
        for middle in (x, even, *(edited(rng, x, int(len(x) * share)) for share in (0.1, 0.15, 0.2, 0.2))):
            docs.append(words(rng, 8) + " " + middle + " " + words(rng, 8))
            docs.append(middle)
    for d in docs:
        want.append({k for k, x in items if least(dc.normal(x), dc.normal(d)) <= int(0.2 * len(dc.normal(x)))})
    got = dc.leaks_of(docs, dc.build([(k, dc.normal(x)) for k, x in items], 0.2))
    assert [{f["item_id"] for f in g} for g in got] == want


def test_clean_texts_stay(spark):
    rng = random.Random(3)
    docs = [(d, words(rng, 80)) for d in range(60)]
    items = [(k, words(rng, 20), "") for k in range(20)]
    out = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS))
    assert out.where("size(leaks) > 0").count() == 0


def test_odd_rows(spark):
    odd = odd_docs(spark)
    items = spark.createDataFrame([(1, "the quick brown FOX  jumps over the lazy dog and runs", ""), (2, None, ""), (3, "  ", ""), (4, "ünïcödé ΑΒΓ 你好 🙂", ""), (None, "xxxxxxxxxxxx", ""), (6, "ab", "")], ITEMS)
    got = {}
    for r in find_leaks(odd, items).collect():
        got.setdefault(r.doc_id, set()).add(tuple(x.item_id for x in r.leaks))
    assert got[1] == {(1,)} and got[2] == {(1,)} and got[8] == {(4,)} and got[7] == {(None,)} and got[3] == {()} and got[4] == {()}
    assert find_leaks(odd, items.where("false")).where("size(leaks) > 0").count() == 0
    assert find_leaks(no_docs(spark), items).count() == 0
