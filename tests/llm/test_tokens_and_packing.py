"""Counts and ids against the tokenizers library, and packing as an exact round trip."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomwork.llm import tokenizer
from loomwork.llm.packing import pack
from loomwork.llm.token_counts import token_counts

from .common import no_docs, odd_docs, odd_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer.public()[0])


def test_every_safe_sign_is_classed_alike(library):
    bpe = tokenizer.load(*tokenizer.public())
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and tokenizer.SAFE(chr(c))]
    assert len(signs) > 30_000
    texts = [f"a{s}a1{s}1!{s}! {s} {s}{s}\n{s}" for s in signs]
    for k in range(0, len(texts), 4096):
        part = texts[k : k + 4096]
        assert [bpe.fast.encode_ordinary(t) for t in part] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_ids_are_the_library_s(spark, library):
    bpe = tokenizer.load(*tokenizer.public())
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [r[1] or "" for r in odd_rows()]
    texts += ["it's we'll <|endoftext|>x", "՘ new letters ꟏", "a b c　d", "\r\n\r\n  tab\t\tx "]
    for t in texts:
        assert bpe.ids(t) == library.encode(t, add_special_tokens=False).ids


def test_counts_with_and_without_a_cache(spark, library, tmp_path):
    docs = odd_docs(spark)
    cache = f"file://{tmp_path}/cache"
    first = token_counts(docs, cache=cache)
    assert first.columns == [c for c in docs.columns if c != "n_tokens"] + ["n_tokens"]
    got = sorted((r.doc_id or -1, r.text or "", r.n_tokens) for r in first.collect())
    want = sorted((r[0] or -1, r[1] or "", len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in odd_rows())
    assert got == want
    stored = spark.read.parquet(cache)
    distinct = len({r[1] or "" for r in odd_rows()})
    assert stored.count() == distinct == stored.select("lw_digest").distinct().count()
    again = token_counts(docs.unionByName(docs), cache=cache)  # nothing is encoded again
    assert again.count() == 2 * len(want) and spark.read.parquet(cache).count() == distinct
    assert token_counts(no_docs(spark)).count() == 0


def rebuilt(rows):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[(r.doc_id, r.doc_tokens)].append((r.start, r.length, bytes(r.ids)))
        sequences[r.sequence_id].append((r.offset, r.length))
    return docs, sequences


def check_sequences(sequences, length):
    last = max(sequences)
    for s, pieces in sequences.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at == length or (s == last and at <= length)
    assert sorted(sequences) == list(range(last + 1))


def test_packing_is_a_round_trip(spark, library):
    table = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    rows = pack(table.select("doc_id", "text")).collect()
    texts = {r.doc_id: r.text for r in table.collect()}
    docs, sequences = rebuilt(rows)
    assert len(docs) == len(texts)
    for (doc, total), pieces in docs.items():
        want = np.array([*library.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        pieces.sort()
        assert b"".join(p[2] for p in pieces) == want and total == len(want) // 4
        assert [p[0] for p in pieces] == np.cumsum([0] + [p[1] for p in pieces[:-1]]).tolist()
    check_sequences(sequences, 1024)


def test_packing_odd_rows(spark, library):
    rows = pack(odd_docs(spark), keep=["doc_id", "sequence_id"], length=64).collect()
    _, sequences = rebuilt(rows)
    check_sequences(sequences, 64)
    assert sum(r.length for r in rows) == sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in odd_rows())
    assert pack(no_docs(spark)).count() == 0


def test_query_against_the_library(spark, library):
    from loomwork.llm.queries import op4_packing

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in texts.items()}
    rows = op4_packing(spark, SF).collect()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.offset + r.length <= 1024
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
