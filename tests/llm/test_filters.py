"""Quality, language and toxicity: held-out accuracy, exact selection, odd rows."""

import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwork.llm import language, quality, toxicity
from loomwork.llm._words import shingles, words

from .common import no_docs, odd_docs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_words_and_shingles_by_hand():
    texts = ["a b c d e f", "A b  c\nd E", "", "x y", "a b c d e", "é \x01 z"]
    w = words(pa.array(texts))
    assert w.counts.tolist() == [len(t.replace("\x01", " ").split()) for t in texts]
    again = words(pa.array(["pad pad", *texts]).slice(1))
    assert (again.hashes == w.hashes).all()
    s, of = shingles(w)
    assert np.bincount(of, minlength=6).tolist() == [2, 1, 0, 1, 1, 1]
    assert s[0] == s[2] == s[4] and len(set(s.tolist())) == 4  # "a b c d e" in any case and spacing


def test_quality_keeps_good_and_drops_bad(docs, labels):
    out = quality.resample(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert good.kept.mean() >= 0.99 and bad.kept.mean() <= 0.05


def test_quality_selection_is_exact(spark):
    rows = [(i, (i * 7919) % 1000 - 500) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, q long")
    ordered = sorted((q for _, q in rows), reverse=True)
    for k in (1, 2, 3, 777, 1999, 2000):
        assert quality.kth_largest(df, "q", k, bins=7) == ordered[k - 1]
    assert quality.kth_largest(df, "q", 0) is None


def test_quality_cut():
    score = np.array([0.0, 1, 2, 3, 4, 5])
    good = np.array([False, False, True, True, True, True])
    assert 1 < quality.cut_for(score, good) < 2


def plain_grams(text):
    """Of words (1 and 2) and of what they look like (1, 2 and 3)."""
    words = [m.group() for m in re.finditer(rb"[^\x00-\x20]+", (text or "").encode())]
    looks, before = [], None
    for w in words:
        capitals, signs = sum(65 <= c <= 90 for c in w), min(3, sum(c < 128 and not chr(c).isalnum() for c in w))
        letter = w[-1] >= 128 or chr(w[-1]).isalpha()
        caps = 0 if capitals == 0 else 1 if capitals == 1 else 3 if 2 * capitals >= len(w) - signs else 2
        looks.append((0 if letter else w[-1], caps, signs, w.lower() == before, len(w) == 1))
        before = w.lower()
    low = [w.lower() for w in words]
    return [*(("w", *low[i : i + n]) for n in (1, 2) for i in range(len(low) - n + 1)), *(("s", *looks[i : i + n]) for n in (1, 2, 3) for i in range(len(looks) - n + 1))]


def test_quality_against_plain_models(spark):
    good, bad = ["The old man reads.", "A man reads the old book", "The book, old and good."], ["BUY NOW $$ !!", "buy $$ now now now", "CLICK!! $$"]
    rows = [(i, t) for i, t in enumerate([*good, *bad, "The man and the book", "NOW $$ $$", "", None, "reads!"])]
    labels = [(i, int(i < 3)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    raw, target = Counter(g for _, t in rows for g in plain_grams(t)), Counter(g for t in good for g in plain_grams(t))
    size = 1 << quality.BITS
    ratio = {g: np.log((target[g] + 0.5) / (sum(target.values()) + size / 2)) - np.log((n + 0.5) / (sum(raw.values()) + size / 2)) for g, n in raw.items()}
    weight = {i: sum(ratio[g] for g in plain_grams(t)) for i, t in rows}
    assert all(np.isclose(got[i].log_weight, w) for i, w in weight.items())
    assert all(np.isclose(got[i].score, weight[i] / (len(plain_grams(t)) + 5)) for i, t in rows)
    cut = quality.cut_for(np.array([weight[i] for i, _ in labels]), np.array([y == 1 for _, y in labels]))
    noise = {r.doc_id: -np.log(-np.log(((r.h & ((1 << 53) - 1)) + 0.5) / (1 << 53))) for r in docs.select("doc_id", F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(17)).alias("h")).collect()}
    best = sorted(weight, key=lambda i: -(weight[i] + noise[i]))[: sum(w >= cut for w in weight.values())]
    assert {i for i in got if got[i].kept} == set(best) and 3 <= len(best) < len(rows)


def test_quality_odd_rows(spark, labels):
    odd = odd_docs(spark).withColumn("log_weight", F.lit("x"))
    few = spark.createDataFrame([(1, 1, None), (2, 1, 0), (6, 0, 0), (7, 0, 1), (1, 1, 1), (None, 1, 0), (99, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.resample(odd, few)
    assert out.count() == odd.count() and set(odd.columns) - {"score", "kept"} <= set(out.columns)
    one = {r.kept for r in out.where("doc_id = 1").collect()}
    assert len(one) == 1
    assert out.where("text is null").select("score").distinct().collect()[0][0] == 0
    unlabelled = quality.resample(odd, few.where("false"))
    assert unlabelled.where("kept").count() == odd.count()
    assert quality.resample(no_docs(spark), labels).count() == 0


def test_language_held_out(docs):
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    model = language.fit(docs.where(part != 2))
    out = language.predict(docs.where(part == 2), model, keep=["doc_id", "lang"]).toPandas()
    assert (out.lang == out.lang_pred).mean() >= 0.97 and out.score.between(0, 1).all()


def test_language_against_plain_counts(spark):
    rows = [("aa ab", "x"), ("ba bb", "y"), ("ab ab", "x"), (None, "x"), ("zz", None)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), bits=12)
    assert model.langs == ["x", "y"]
    counts = np.full((1 << 12, 2), 0.5)
    for t, l in rows[:3]:
        g, _, _ = language.buckets([t], 12)
        for x in g:
            np.add.at(counts[:, "xy".index(l)], x[:-2], 1)  # none begins at the closing spaces
    assert np.allclose(model.table, np.log(counts / counts.sum(axis=0)), atol=1e-5)
    alone, both = model.scores(["abba"]), model.scores(["something", "abba", "bb"])
    assert np.allclose(alone[0], both[1])  # a text's score does not depend on its neighbours


def test_language_against_plain_bayes(spark):
    """Counts of n-grams as strings, in plain Python; no two of these share a bucket."""
    rows = [("Der Hund bellt.", "de"), ("die katze schläft", "de"), ("The dog barks", "en"), ("the cat sleeps", "en"), ("a dog", "en")]
    texts = ["der dog", "KATZE", "the the", "schläft the"]
    grams = lambda t: [f"{t.lower()}  "[i : i + n] for n in (2, 3) for i in range(len(t))]
    held = {x: Counter(g for t, l in rows if l == x for g in grams(t)) for x in ("de", "en")}
    model = language.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    size, want = 1 << language.BITS, []
    for t in texts:
        log = [np.log(sum(l == x for _, l in rows) / len(rows)) + sum(np.log((held[x][g] + 0.5) / (sum(held[x].values()) + size / 2)) for g in grams(t)) for x in ("de", "en")]
        p = np.exp(np.array(log) - max(log))
        want.append(p / p.sum())
    assert model.langs == ["de", "en"] and np.allclose(model.scores(texts), want, rtol=1e-3)
    got = {r.text: r for r in language.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model, keep=["text"]).collect()}
    assert [got[t].lang_pred for t in texts] == [("de", "en")[int(np.argmax(p))] for p in want]
    assert np.allclose([got[t].score for t in texts], [max(p) for p in want], rtol=1e-3)


def test_language_of_long_texts_and_of_many_languages(spark, monkeypatch):
    texts = ["aa ab ba " * 40, "b", "", "zz aa" * 31, "ab" * 50]
    model = language.LanguageModel(["x", "y"], np.random.default_rng(3).normal(size=(1 << 12, 2)).astype(np.float32), np.zeros(2), 12)
    want = model.scores(texts)
    monkeypatch.setattr(language, "PIECE", 7)
    monkeypatch.setattr(language, "CELLS", 1)
    assert np.allclose(model.scores(texts), want)
    many = spark.createDataFrame([("text", f"l{k}") for k in range(6)], "text string, lang string")
    with pytest.raises(ValueError, match="max_langs"):
        language.fit(many, max_langs=5)
    assert len(language.fit(many, max_langs=6).langs) == 6


def test_language_odd_rows(spark):
    odd = odd_docs(spark)
    model = language.fit(odd)
    out = language.predict(odd, model, keep=["doc_id", "text"]).collect()
    assert len(out) == odd.count()
    for r in out:
        assert (r.lang_pred == "und") == (not language.has_letter(r.text)) and 0 <= r.score <= 1
    nothing = language.predict(odd, language.fit(no_docs(spark))).select("lang_pred", "score").distinct().collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
    assert language.predict(no_docs(spark), model).count() == 0


def test_toxicity_held_out(docs, labels):
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    both = docs.join(labels.select("doc_id", "toxic"), "doc_id")
    model = toxicity.fit(both.where(part != 0))
    out = toxicity.score(both.where(part == 0), model, keep=["doc_id", "toxic"]).toPandas()
    toxic, clean = out[out.toxic == 1].score.to_numpy(), out[out.toxic == 0].score.to_numpy()
    auc = np.mean(toxic[:, None] > clean[None, :]) + 0.5 * np.mean(toxic[:, None] == clean[None, :])
    assert auc >= 0.85 and (out.toxic == out.predicted).mean() >= 0.9
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()


def plain_features(text, weights, seconds):
    """By the definitions, a sign at a time."""
    text = text or ""
    letter = lambda i: 0 <= i < len(text) and text[i].isalpha()
    disguised = []
    for m in re.finditer(r"[0-9@$*]+", text):
        if letter(m.start() - 1) and letter(m.end()):
            disguised.append(m.span())
    inside = {i for a, b in disguised for i in range(a, b)}
    found, now, at = [], "", 0
    for i, c in enumerate(text + " "):
        if c.isalpha() or c.isdecimal() or i in inside:
            at, now = (i, " ") if not now else (at, now)
            now += ("" if c == "*" else toxicity_leet.get(c, c)) if i in inside else c.lower()
        elif now:
            found.append((now[1:], text[at:i]))
            now = ""
    terms = lambda w: [w, *(w[:n] + "~" for n in (4, 5, 6) if len(w) > n)]
    weight = [max(weights.get(t, 0) for t in terms(w)) for w, _ in found]
    hits = [i for i, w in enumerate(weight) if w > 0]
    you = [i for i, (w, _) in enumerate(found) if w in seconds]
    near = sum(any(abs(i - j) <= 5 for j in you) for i in hits)
    n, chars = max(1, len(found)), max(1, len(text))
    of = lambda signs: sum(c in signs for c in text)
    low = text.lower()
    stretched = sum(len(m.group()) >= 3 and m.group()[0].isalpha() for m in re.finditer(r"(.)\1*", low, re.S))
    return [
        np.log1p(len(found)), len(hits) / n, np.log1p(len(hits)), sum(weight) / n, max(weight, default=0), len(you) / n, near / max(1, len(hits)),
        sum(c.isupper() for c in text) / chars, sum(len(w) > 1 and all(c.isupper() for c in w) for _, w in found) / n, of("!") / n, of("?") / n,
        of(".,;:'\"()!?-") / chars, of("#$%&*@^~|<>+=_") / chars, len(disguised) / n, stretched / n, sum(c.isdecimal() for c in text) / chars,
    ]


toxicity_leet = dict(zip("013457@$", "oieastas"))


def test_toxicity_features_against_plain_ones(docs):
    weights = {"idiot": 2.0, "moro~": 1.0, "fck": 3.0, "the": 0.5, "xxx": 0.25}
    lex = toxicity.Lexicon.of(weights)
    texts = [r.text for r in docs.limit(60).collect()] + [None, "", "You 1d10t! MORONS### are soooo 7 far, f**ck y0u idi0t", "a@", "$a 5 4a4", "XXX\n\nÜBER straße İ 你好", "🙂 du Idiot", "aaa1111111" * 50]
    got = lex.features(texts)
    assert got.shape == (len(texts), len(toxicity.FEATURES))
    assert np.allclose(got, [plain_features(t, weights, toxicity.SECOND_PERSON) for t in texts])
    assert np.allclose(lex.features(texts[3:4]), got[3:4])  # a row does not depend on its neighbours
    f = dict(zip(toxicity.FEATURES, lex.features(["You 1d10t! MORONS### are soooo 7 far"])[0]))
    assert f["strongest"] == 1.0 and f["proximity"] == 1.0 and f["obfuscated"] > 0 and f["stretched"] > 0 and f["capital_words"] > 0


def test_toxicity_of_long_texts():
    lex = toxicity.Lexicon.of({"idiot": 2.0})
    began = time.time()
    for t in ("x" * 3_000_000, "a1" * 1_000_000, "好" * 1_000_000, "you idiot " * 300_000):
        x = dict(zip(toxicity.FEATURES, lex.features([t])[0]))
        assert x["words"] > 0
    assert time.time() - began < 30
    assert x["proximity"] > 0.999 and abs(x["lexicon_density"] - 0.5) < 1e-4


def test_toxicity_lexicon_against_plain_counts(spark):
    rows = [("bad foo", 1), ("bad bar bad", 1), ("bad baz", 1), ("good bad", 0), ("good foo", 0), ("good bar", 0), ("worthless thing", 1), ("worthwhile", 0)] * 3
    lex = toxicity.learn_lexicon(spark.createDataFrame(rows, "t string, y int").repartition(3), least=3, ratio=2.0)
    held = [Counter(), Counter()]
    for t, y in rows:
        held[y].update({x for w in t.split() for x in (w, *(w[:n] + "~" for n in (4, 5, 6) if len(w) > n))})
    r = {t: ((n + 0.5) / 13) / ((held[0][t] + 0.5) / 13) for t, n in held[1].items() if n >= 3}
    want = {t: np.log(x) for t, x in r.items() if x >= 2}
    assert want and len(lex.terms.keys) == len(want)
    for t, x in want.items():
        at, value = lex.terms.of(toxicity.term_hash(t))
        assert len(at) == 1 and np.isclose(value[0], x)


def test_toxicity_odd_rows(spark):
    odd = odd_docs(spark)
    model = toxicity.fit(odd.withColumn("toxic", F.lit(None).cast("int")))
    out = toxicity.score(odd, model, keep=["doc_id", "source"])
    assert out.count() == odd.count() and {r.score for r in out.collect()} == {0.0}
    one = toxicity.fit(odd.withColumn("toxic", F.lit(1)))
    assert {r.predicted for r in toxicity.score(odd, one).collect()} == {1}
    assert toxicity.score(no_docs(spark), model).count() == 0
