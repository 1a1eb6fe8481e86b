"""Positions, balanced partitions and work in a fixed order, without one task for all rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encoding import let
from ..plans.staging import staged


def positions(df: DataFrame, *order: Column, out: str = "position") -> DataFrame:
    """``df`` with each row's place (from 0) in a global order.

    A range partitioning sorts, every partition numbers its rows, and the partitions' sizes, one
    row each, are summed up into the place where each begins.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = staged(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("lw_id", F.monotonically_increasing_id()), "positions")
    numbered = numbered.withColumns({"lw_part": F.shiftright("lw_id", 33), "lw_row": F.col("lw_id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = numbered.groupBy("lw_part").agg(F.count("*").alias("lw_n"))
    before = Window.orderBy("lw_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("lw_part", F.coalesce(F.sum("lw_n").over(before), F.lit(0)).alias("lw_begin"))  # one row a partition
    return numbered.join(F.broadcast(begins), "lw_part").withColumn(out, F.col("lw_begin") + F.col("lw_row")).drop("lw_id", "lw_part", "lw_row", "lw_begin")


def balanced_range(position: Column, total: Column | int, parts: int) -> Column:
    """Which of ``parts`` consecutive ranges a position falls in; the first ones have one more row
    where the total does not divide."""
    total = F.lit(total) if isinstance(total, int) else total
    base, more = F.floor(total / parts), total % parts
    head = more * (base + 1)
    return F.when(position < head, F.floor(position / (base + 1))).otherwise(more + F.floor((position - head) / F.greatest(base, F.lit(1)))).cast("long")


def ordered_map_reduce(df: DataFrame, order: list[Column], parts: int, mapped: Column, identity: Column, reduce: Callable[[Column, Column], Column], out: str = "result") -> DataFrame:
    """Aggregate each of ``parts`` balanced ranges of ``df`` with ``mapped``, then fold the results
    in the ranges' order. One range gives its own result; no rows give ``identity``."""
    total = df.count()
    if not total:
        return df.sparkSession.range(1).select(identity.alias(out))
    ranged = positions(df, *order, out="lw_at").withColumn("lw_range", balanced_range(F.col("lw_at"), total, parts))
    each = ranged.groupBy("lw_range").agg(mapped.alias("lw_value"))
    inorder = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("lw_range", "lw_value"))), lambda x: x.lw_value).alias("v"))  # `parts` values
    return inorder.select(F.when(F.size("v") == 1, F.get("v", F.lit(0))).otherwise(F.aggregate("v", identity, reduce)).alias(out))


def per_key_order(df: DataFrame, key: str, *order: Column, out: str = "turn") -> DataFrame:
    """First come, first served within each key: the place (from 1) of each row."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def ordered_batch(df: DataFrame, seq: str, result: Column, failed: Column, size: Column | None = None, most: int | None = None) -> DataFrame:
    """Rows with ``result`` up to the first (by ``seq``) that fails: a failure shows at its own
    place, after everything before it has come out. Work beyond it is dropped. A row whose ``size``
    alone is over ``most`` fails; with both, ``batch`` numbers the rows (from 0) so that the rows of
    a batch that are not its first end within ``most`` bytes of where it begins."""
    failed = F.coalesce(failed, F.lit(False))
    done = df.withColumns({"result": result, "lw_failed": failed if most is None else failed | F.coalesce(size > most, F.lit(False))})
    stop = done.where("lw_failed").agg(F.min(seq)).first()[0]  # one number
    done = (done if stop is None else done.where(F.col(seq) < F.lit(stop))).drop("lw_failed")
    if most is None:
        return done
    placed = running(done.withColumn("lw_size", F.coalesce(size, F.lit(0)).cast("long")), "lw_size", F.col(seq), out="lw_before")
    return placed.withColumn("batch", F.floor(F.col("lw_before") / most).cast("long")).drop("lw_size", "lw_before")


def running(df: DataFrame, size: str, *order: Column, out: str = "before") -> DataFrame:
    """``df`` with the sum of ``size`` over all rows before each one in a global order: a sum in each
    sorted range, and one of the ranges' totals, a row a range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(df.repartitionByRange(n, *order).withColumn("lw_range", F.spark_partition_id()), "running")
    rows = Window.partitionBy("lw_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("lw_range").agg(F.sum(size).alias("lw_total"))
    begins = totals.select("lw_range", F.coalesce(F.sum("lw_total").over(Window.orderBy("lw_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lw_begin"))
    return ranged.withColumn(out, F.coalesce(F.sum(size).over(rows), F.lit(0))).join(F.broadcast(begins), "lw_range").withColumn(out, F.col(out) + F.col("lw_begin")).drop("lw_range", "lw_begin")


def _next_bins(loads: Column, size: Column, rank: Column) -> Column:
    """The bin of the item of ``rank`` (from 0) among equal ones, dealt one by one to the emptiest of
    bins with these ``loads`` (ties: the lower bin). Sorted by load, the first j bins take turns
    until they reach the load of the next; within such a phase their order repeats."""
    bins = F.array_sort(F.transform(loads, lambda x, i: F.struct(x.alias("load"), i.alias("bin"))))
    step = F.greatest(size, F.lit(1))
    steps = lambda low, high: F.floor((high - low + step - 1) / step).cast("long")

    def of(b: Column) -> Column:
        taken = lambda top: F.aggregate(F.filter(b, lambda x: x.load < top), F.lit(0).cast("long"), lambda a, x: a + steps(x.load, top))
        begun = F.filter(F.transform(b, lambda x: F.struct(x.load.alias("load"), taken(x.load).alias("n"))), lambda x: x.n <= rank)
        phase = F.try_element_at(begun, F.lit(-1))
        turns = F.array_sort(F.transform(F.filter(b, lambda x: x.load <= phase.load), lambda x: F.struct((x.load + step * steps(x.load, phase.load)).alias("load"), x.bin.alias("bin"))))
        return F.get(turns, ((rank - phase.n) % F.size(turns)).cast("int")).bin

    return F.when(size == 0, F.get(bins, F.lit(0)).bin).otherwise(let(bins, of))


def longest_first(df: DataFrame, key: str, item: str, size: str, bins: int) -> DataFrame:
    """Items of each key dealt to ``bins`` bins: the largest first (ties: the lower item), each to
    the emptiest bin (ties: the lower bin). Sizes are whole numbers from 0; null ones count as 0.

    Only the number of items of each size, in order of sizes, is followed one by one, in a group a
    key: as many rows as a key has sizes. Items then find their bins by their rank in their size."""
    rows = df.select(key, item, size).withColumn("lw_size", F.coalesce(F.col(size), F.lit(0)).cast("long"))
    counts = rows.groupBy(F.col(key).alias("lw_key"), "lw_size").agg(F.count("*").alias("lw_n"))
    kind = T.StructType([T.StructField("lw_key", df.schema[key].dataType), T.StructField("lw_size", T.LongType()), T.StructField("lw_loads", T.ArrayType(T.LongType()))])

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        loads, out = np.zeros(bins, np.int64), []
        for s, n in pdf.sort_values("lw_size", ascending=False)[["lw_size", "lw_n"]].itertuples(index=False):
            out.append(loads.tolist())
            loads = _dealt(loads, int(s), int(n))
        return pd.DataFrame({"lw_key": pdf["lw_key"].iloc[0], "lw_size": sorted(pdf["lw_size"], reverse=True), "lw_loads": out})

    followed = counts.groupBy("lw_key").applyInPandas(follow, kind)
    rank = F.row_number().over(Window.partitionBy(key, "lw_size").orderBy(item)) - 1
    ranked = rows.withColumn("lw_rank", rank.cast("long")).withColumnRenamed("lw_size", "lw_own")
    met = ranked.join(followed, F.col(key).eqNullSafe(F.col("lw_key")) & (F.col("lw_own") == F.col("lw_size")))
    return met.select(key, item, size, _next_bins(F.col("lw_loads"), F.col("lw_own"), F.col("lw_rank")).cast("long").alias("bin"))


def _dealt(loads: np.ndarray, size: int, n: int) -> np.ndarray:
    """Loads after ``n`` items of one size: the level that they reach, then the rest in turn."""
    if size == 0 or n == 0:
        return loads
    taken = lambda top: np.maximum(0, -(-(top - loads) // size))  # noqa: E731  by each bin from loads below `top`
    low, high = int(loads.min()), int(loads.min()) + size * n + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if taken(mid).sum() <= n else (low, mid)
    got = taken(low)
    level = loads + size * got
    rest = [b for b in np.lexsort((np.arange(len(loads)), level)) if level[b] == low][: n - int(got.sum())]
    got[rest] += 1
    return loads + size * got
