"""The pipeline: what each stage keeps, cuts and drops, on its own input."""

import random
import re
from collections import defaultdict

import corpus_pipeline
from loomwork.llm import decontamination as dc
from loomwork.llm.queries import oracle_sql, queries

from .common import odd_docs, odd_rows

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [dc.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-stage")
        if name == "packing":
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        seen[name] = before, after
    before, after = seen["quality classifier"]
    good = [d for d in before if labels.get(d) == 1]
    assert sum(d in after for d in good) >= 0.98 * len(good)
    assert sum(d in after for d in before if labels.get(d) == 0) <= 2
    before, after = seen["near-duplicates"]
    assert len(set(after.values())) == len(after) and set(after.values()) <= set(before.values())
    before, after = seen["suffix-array dedup"]
    assert set(before) == set(after) and sum(map(len, after.values())) <= sum(map(len, before.values()))
    before, after = seen["benchmark decontamination"]
    assert {d for d, t in before.items() if any(i in dc.normal(t) for i in items)} <= set(before) - set(after)
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(after)
    assert max(r.offset + r.length for r in pieces) <= 1024


def words_of(text):
    return re.findall(r"[^\x00-\x20]+", (text or "").lower())


def test_no_passage_of_over_50_words_stays_twice(spark):
    sf = "/root/testdata/sf0.01"
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4)))
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(400)
    passage, long = " ".join(word() for _ in range(51)), " ".join(word() for _ in range(120))
    own = lambda n: " ".join(word() for _ in range(n))
    rows = [(10_000 + k, f"{own(60 + k)}\n({passage}-{own(70)} {long.upper() if k % 2 else long}. {own(5)}", "en", "planted", None) for k in range(4)] + [(20_000, f"{own(300)}", "en", "clean", 7)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    after = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, sf).collect()}
    seen = defaultdict(set)
    for r in after.values():
        w = words_of(r.text)
        for k in range(len(w) - 50):
            seen[tuple(w[k : k + 51])].add(r.doc_id)
    assert not [x for x in seen.values() if len(x) > 1]
    for i, t, *_ in rows[:4]:
        inner = passage.split(" ", 1)[1].rsplit(" ", 1)[0]
        assert inner not in after[i].text and long not in after[i].text.lower() and after[i].text.startswith(t[:100]) and after[i].n_chars == len(after[i].text)
    assert after[20_000].text == rows[4][1] and after[20_000].n_chars == 7


def test_odd_rows_through_all_stages(spark):
    docs = odd_docs(spark)
    columns, ids = docs.columns, {r[0] for r in odd_rows()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "odd-stage")
        got = docs.collect()
        assert docs.columns == columns and {r.doc_id for r in got} <= ids
        assert all(r[c] == "x" for r in got for c in ("score", "kept", "n_tokens", "leaks", "lang_pred", "predicted", "sequence_id"))
        if name == "near-duplicates":
            assert [r.doc_id for r in got].count(1) <= 1 and 2 not in {r.doc_id for r in got} and 10 not in {r.doc_id for r in got}
    pieces = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in got}


def test_repeated_rows_and_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    twice = corpus_pipeline.keep_distinct(spark, docs.unionByName(docs), SF)
    assert twice.count() == corpus_pipeline.keep_distinct(spark, docs, SF).count() == twice.select("doc_id").distinct().count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11)) and set(oracle_sql()) <= set(queries())
