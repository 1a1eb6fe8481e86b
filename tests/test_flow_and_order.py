"""Orders, folds and flow figures."""

from pyspark.sql import functions as F

from loomwork.operators import ordering as od
from loomwork.streaming import flow


def test_positions_and_ranges(spark):
    df = spark.range(103).select((F.col("id") * 37 % 103).alias("k")).repartition(5)
    got = {r.k: r.position for r in od.positions(df, F.col("k")).collect()}
    assert got == {k: k for k in range(103)}
    sizes = [0] * 7
    for r in od.positions(df, F.col("k")).select(od.balanced_range(F.col("position"), 103, 7).alias("p")).collect():
        sizes[r.p] += 1
    assert sizes == [15] * 5 + [14] * 2


def test_map_reduce_edges(spark):
    df = spark.range(5)
    fold = lambda d, parts: od.ordered_map_reduce(d, [F.col("id")], parts, F.concat_ws("", F.array_sort(F.collect_list(F.col("id").cast("string")))), F.lit("!"), lambda a, x: F.concat(a, x)).first()[0]
    assert fold(df, 2) == "!01234" and fold(df, 1) == "01234" and fold(df.where("id < 0"), 3) == "!"


def test_batch_stops_at_the_first_failure(spark):
    df = spark.range(10)
    assert sorted(r.id for r in od.ordered_batch(df, "id", F.col("id") * 2, F.col("id").isin(6, 4)).collect()) == [0, 1, 2, 3]
    assert od.ordered_batch(df, "id", F.col("id"), F.lit(None).cast("boolean")).count() == 10


def test_batches_of_bytes(spark):
    rows = [(k, (k * 37) % 50) for k in range(90)] + [(90, 500), (91, 1)]
    df = spark.createDataFrame(rows, "seq long, n long").repartition(5)
    got = {r.seq: r.batch for r in od.ordered_batch(df, "seq", F.col("n"), F.lit(False), F.col("n"), 200).collect()}
    before, want = 0, {}
    for k, n in rows[:90]:
        want[k], before = before // 200, before + n
    assert got == want


def test_longest_first_one_by_one(spark):
    import heapq
    import random

    rng = random.Random(4)
    rows = [(f"k{rng.randrange(3)}", i, rng.choice([0, 0, 1, 2, 3, 7, 7, 7, 20, 100, rng.randrange(200)])) for i in range(600)] + [("big", 1000, 10_000), *(("big", 2000 + i, 7) for i in range(900)), (None, 5000, 3), (None, 5001, None)]
    df = spark.createDataFrame(rows, "k string, item long, n long").repartition(4)
    for bins in (1, 5, 8):
        want = {}
        for key in {r[0] for r in rows}:
            heap = [(0, b) for b in range(bins)]
            for k, i, n in sorted((r for r in rows if r[0] == key), key=lambda r: (-(r[2] or 0), r[1])):
                load, b = heapq.heappop(heap)
                want[i] = b
                heapq.heappush(heap, (load + (n or 0), b))
        assert {r.item: r.bin for r in od.longest_first(df, "k", "item", "n", bins).collect()} == want


def _by_window(events):
    seen, want = {}, []
    for e, u, _, b in sorted(events, key=lambda r: (r[2], r[0])):
        n, total = seen.get(u, (0, 0))
        seen[u] = (n + 1, total + b)
        want.append((e, u, *seen[u]))
    return sorted(want)


def test_keyed_stream_in_small_arrow_batches(spark, tmp_path):
    import random

    from loomwork import queries

    rng = random.Random(6)
    events = [(e, e % 3, rng.randint(0, 50), 10 + e % 400) for e in range(60)]
    spark.createDataFrame(events, "event_id long, user_id long, ts long, bytes long").select("event_id", "user_id", F.timestamp_seconds("ts").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = queries.stream_keyed_fifo(spark, str(tmp_path)).select("event_id", "user_id", "turn", "written").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(tuple(r) for r in got) == _by_window(events)


def test_keyed_batches_go_on(spark, tmp_path):
    rows = [(e, e % 3, 40 - e, 5 + e) for e in range(30)]
    store, schema = flow.keyed_batches(str(tmp_path)), "event_id long, user_id long, ts long, bytes long"
    parts = [rows[20:], rows[10:20], rows[:0], rows[:10]]
    for n, part in enumerate(parts):
        store(spark.createDataFrame(part, schema), n)
    store(spark.createDataFrame(parts[3], schema), 3)
    got = spark.read.parquet(f"{tmp_path}/out").select("event_id", "user_id", "turn", "written").collect()
    assert sorted(tuple(r) for r in got) == _by_window(rows)


NODES = "tree int, node int, parent int, side string, op string, value int"


def test_deep_trees_are_whole(spark):
    import pytest

    from loomwork.operators import workloads as wl

    rows, want = [], {2: 7, 3: None}
    n, total = 70, 0
    for k in range(1, n + 1):
        rows.append((1, 2 * k, None if n == 1 else 2 * max(k, 2) + 1, "left" if k == 1 else "right", None, k))
        if k > 1:
            rows.append((1, 2 * k + 1, 2 * k + 3 if k < n else None, "left" if k < n else None, "add", None))
        total += k
    want[1] = total
    rows += [(2, 1, None, None, None, 7), (3, 1, None, None, "add", None), (3, 2, 1, "left", None, None), (3, 3, 1, "right", None, 4)]
    assert {r.tree: r.value for r in wl.evaluate_trees(spark.createDataFrame(rows, NODES)).collect()} == want
    with pytest.raises(ValueError):
        wl.evaluate_trees(spark.createDataFrame([(4, 1, None, None, "add", None), (4, 2, 1, "left", None, 5)], NODES))
