"""Every record query against its SQL in DuckDB."""

import math
import os

import duckdb
import pandas as pd
import pytest

from loomwork import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(value):
    if hasattr(value, "tolist") and not isinstance(value, bytes | bytearray):
        value = value.tolist()
    if isinstance(value, bytes | bytearray):
        return bytes(value).hex()
    if isinstance(value, list):
        return str([plain(x) for x in value])
    if value is None or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, float) and value == int(value if math.isfinite(value) else 0):
        return str(int(value))
    return str(value)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None) if not any(df.map(lambda x: isinstance(x, list) or hasattr(x, "tolist")).any()) else df
    return sorted(tuple(plain(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_oracle(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_typed_decode_of_odd_events(spark, tmp_path):
    """Nulls, keys below zero, and texts that JSON escapes or that begin with no or several bytes."""
    texts = ["click", None, "", "é1", "€", "😀x", 'a"b', "a\\b", "\nx", "\x01", "\x7f\x85", '"flag":true', "%s", "null", "</x>", "{}"]
    numbers = [5, None, 0, -9, (1 << 63) - 1, -(1 << 63), 40_000_000]
    events = [(i if i else None, numbers[i % len(numbers)], t) for i, t in enumerate(texts * len(numbers), -20)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(queries.SQL["json_typed_decode"])
    got = queries.QUERIES["json_typed_decode"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want.fetchall()))


def test_longest_first_by_hand(spark):
    items = [(r.lang, r.doc_id, r.n_chars, r.bin) for r in queries.longest_first_bins(spark, SF).collect()]
    for lang in {i[0] for i in items}:
        load = [0] * 8
        for _, doc, n, b in sorted((i for i in items if i[0] == lang), key=lambda i: (-i[2], i[1])):
            assert b == min(range(8), key=lambda k: (load[k], k)), doc
            load[b] += n


def test_every_query_is_registered(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
