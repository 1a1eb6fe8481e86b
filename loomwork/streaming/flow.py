"""Flow-control figures of a log of sends, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _so_far(stream: str, order: list[str]):
    return Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def flow_log(df: DataFrame, stream: str, order: list[str], sent: Column, acked: Column, window: int, rtt: Column | None = None) -> DataFrame:
    """For each row of a log: bytes in flight, the largest message so far, bytes delivered, the
    least round trip so far, and whether a fixed window lets the next send go: if what is in
    flight is at most one largest message, or less than the window and one such message."""
    w = _so_far(stream, order)
    in_flight = F.sum(F.coalesce(sent, F.lit(0)) - F.coalesce(acked, F.lit(0))).over(w).cast("long")
    largest = F.max(sent).over(w).cast("long")
    out = df.withColumns({"in_flight": in_flight, "largest": largest, "delivered": F.sum(F.coalesce(acked, F.lit(0))).over(w).cast("long")})
    if rtt is not None:
        out = out.withColumn("min_rtt", F.min(rtt).over(w))
    return out.withColumn("ready", (F.col("in_flight") <= F.col("largest")) | (F.col("in_flight") < F.col("largest") + window))


def cut_over(df: DataFrame, stream: str, order: list[str], size: Column, limit: int) -> DataFrame:
    """Bytes written so far, how many of this write fit below ``limit``, and whether it is reached."""
    total = F.sum(size).over(_so_far(stream, order)).cast("long")
    before = total - size
    return df.withColumns({"written": total, "taken": F.greatest(F.lit(0).cast("long"), F.least(size.cast("long"), F.lit(limit).cast("long") - before)), "full": total >= limit})


def stream_totals(events: DataFrame, key: str, size: Column) -> DataFrame:
    """Sends and bytes of each key, for a stream in update or complete mode or for a table."""
    return events.groupBy(key).agg(F.count("*").alias("sends"), F.sum(size).cast("long").alias("bytes"), F.max(size).cast("long").alias("largest"))


_TOTALS = "user_id long, seen long, total long"


def keyed_batches(at: str) -> Callable[[DataFrame, int], None]:
    """First come, first served for each user of a stream, with a running byte count.

    A function for ``foreachBatch`` over rows of ``event_id, user_id, ts, bytes``; the turn and the
    bytes so far go to ``at/out/batch=n``. Within a batch a user's rows go by ``ts, event_id`` in a
    Spark window, whatever parts they arrive in; later batches go on from the user's totals, which
    are kept in ``at/totals/batch=n``. A batch that is repeated replaces what it wrote.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(_TOTALS).parquet(f"{at}/totals/batch={number - 1}") if number else spark.createDataFrame([], _TOTALS)
        w = Window.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id")).rowsBetween(Window.unboundedPreceding, 0)
        rows = batch.select("event_id", F.col("user_id").alias("user"), F.count(F.lit(1)).over(w).alias("n"), F.sum("bytes").over(w).cast("long").alias("b"))
        rows = rows.join(before, F.col("user").eqNullSafe(F.col("user_id")), "left")
        turn, total = F.coalesce("seen", F.lit(0)) + F.col("n"), F.coalesce(F.col("total") + F.col("b"), "total", "b")
        rows.select("event_id", F.col("user").alias("user_id"), turn.alias("turn"), total.alias("written")).write.mode("overwrite").parquet(f"{at}/out/batch={number}")
        done = spark.read.schema("event_id long, user_id long, turn long, written long").parquet(f"{at}/out/batch={number}")
        now = before.unionByName(done.select("user_id", F.col("turn").alias("seen"), F.col("written").alias("total")))
        now.groupBy("user_id").agg(F.max("seen").alias("seen"), F.max_by("total", "seen").alias("total")).write.mode("overwrite").parquet(f"{at}/totals/batch={number}")

    return store
