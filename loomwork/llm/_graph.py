"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import forget, written


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int | None = None, table=written) -> DataFrame:
    """``links`` has longs ``a`` and ``b``; returns ``node`` and ``component``, the smallest node
    that links reach, for every node that some link names. Rounds go on until nothing changes;
    where ``rounds`` are given and do not suffice, it raises. The graph stays in Spark; two numbers
    a round reach the driver. The stars' joins are plain equi-joins, which Spark splits where one
    node has very many links."""
    edges = table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = _print_of(edges)
    done = 0
    while True:
        if done == rounds:
            raise RuntimeError(f"components are not complete after {rounds} rounds")
        done += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after_edges = table(small, "stars")
        after = _print_of(after_edges)
        forget(edges)
        edges = after_edges
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
