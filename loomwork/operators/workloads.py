"""The analytic workloads: nested valuation, re-ranking, expression trees, record summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arithmetic import safe_divide, safe_modulus, wrapping_add, wrapping_multiply, wrapping_subtract
from ..plans.staging import staged

# What each part of a car adds to its value.
PER_SEAT, PER_DOOR, SNOW_TIRE, VOLUME_SHARE, PER_HORSEPOWER, HYBRID, ELECTRIC, PER_CUP_HOLDER = 200, 350, 100, 50, 40, 5000, 3000, 25
EXTRAS = {"hasPowerWindows": 100, "hasPowerSteering": 200, "hasCruiseControl": 400, "hasNavSystem": 2000}
# What a word in a snippet does to its score.
BOOST = 10_000.0


def car_value(car: Column) -> Column:
    """The value of one car record, a long."""
    n = lambda name: car.getField(name).cast("long")
    tire = lambda w: w.getField("diameter").cast("long") * w.getField("diameter").cast("long") + F.when(w.getField("snowTires"), SNOW_TIRE).otherwise(0)
    wheels = F.aggregate(F.coalesce(car.getField("wheels"), F.array()), F.lit(0).cast("long"), lambda total, w: total + tire(w))
    engine = car.getField("engine")
    electric = F.when(engine.getField("usesElectric"), F.when(engine.getField("usesGas"), HYBRID).otherwise(ELECTRIC)).otherwise(0)
    extras = sum((F.when(car.getField(k), v).otherwise(0) for k, v in EXTRAS.items()), F.lit(0))
    volume = F.floor(n("length") * n("width") * n("height") / VOLUME_SHARE)
    return n("seats") * PER_SEAT + n("doors") * PER_DOOR + wheels + volume + engine.getField("horsepower").cast("long") * PER_HORSEPOWER + electric + extras + n("cupHolders") * PER_CUP_HOLDER


def total_value(cars: Column) -> Column:
    """The sum over a list of cars; nothing is exploded."""
    return F.aggregate(F.coalesce(cars, F.array()), F.lit(0).cast("long"), lambda total, car: total + car_value(car))


def rescored(score: Column, snippet: Column, up: str = " cat ", down: str = " dog ") -> Column:
    boosted = F.when(F.contains(snippet, F.lit(up)), score * BOOST).otherwise(score)
    return F.when(F.contains(snippet, F.lit(down)), boosted / BOOST).otherwise(boosted)


OPERATIONS = ["add", "subtract", "multiply", "divide", "modulus"]


def _apply(op: Column, a: Column, b: Column) -> Column:
    done = [wrapping_add(a, b), wrapping_subtract(a, b), wrapping_multiply(a, b), safe_divide(a, b), safe_modulus(a, b)]
    out = F.lit(None).cast("int")
    for name, value in zip(OPERATIONS, done):
        out = F.when(op == name, value).otherwise(out)
    return out


def evaluate_trees(nodes: DataFrame) -> DataFrame:
    """Values of expression trees kept as rows: ``tree``, ``node``, ``parent``, ``side`` (left or
    right), ``op`` (null for a leaf), ``value``; the root has no parent. All nodes whose two
    operands are known are evaluated together, so a round is one join however many trees there
    are, and there are as many rounds as the deepest tree has levels, without a bound. A round
    reads and writes only nodes that wait for an operand, so a tree costs its own levels, not
    those of the deepest. A null operand is a value like others. Raises where a root cannot be
    evaluated, as an operand is missing. Returns ``tree, value``."""
    sides, place = ["left", "right"], ["tree", "node", "parent", "side"]
    nodes = staged(nodes.select(*place, "op", "value"), "tree-nodes")
    operand = T.StructType([T.StructField("value", nodes.schema["value"].dataType)])
    known = nodes.where("op is null").select(*place, "value")
    waiting = nodes.where("op is not null").select(*place, "op", *(F.lit(None).cast(operand).alias(s) for s in sides))
    roots = known.where("parent is null").select("tree", "value")
    both = F.col("left").isNotNull() & F.col("right").isNotNull()
    while True:
        new = known.where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(*(F.max(F.when(F.col("side") == s, F.struct("value"))).alias(f"new_{s}") for s in sides))
        met = waiting.join(new, ["tree", "node"], "left").select(*place, "op", *(F.greatest(s, f"new_{s}").alias(s) for s in sides))
        met = staged(met, "tree-level")
        known = met.where(both).select(*place, _apply(F.col("op"), F.col("left.value"), F.col("right.value")).alias("value"))
        waiting = met.where(~both)
        evaluated, ends, halves = met.agg(F.count_if(both), F.count_if(both & F.col("parent").isNull()), F.count_if(F.col("left").isNotNull() != F.col("right").isNotNull())).first()
        if ends:
            roots = roots.unionByName(known.where("parent is null").select("tree", "value"))
        if evaluated == ends:
            break
    missing = nodes.where("parent is null").count() - roots.count()
    if missing or halves:
        raise ValueError(f"{missing} trees have no value, {halves} operands lack their partner")
    return roots


#: Of the calculator; others give null.
_FUNCTIONS = {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": F.try_divide}


def calculate(steps: DataFrame, functions: dict | None = None) -> DataFrame:
    """Calculations over doubles, a row a step: ``calc``, ``step``, ``op``, and of either side a
    ``value``, or as ``ref`` the step of the same calculation whose result it takes.

    A calculation's steps, in order, are one array, along which the results so far are handed on;
    a ref to a later, or no, step gives null, as does an unknown ``op``. Returns ``calc``, ``step``,
    ``result``. ``functions`` are columns of two doubles, by name."""
    functions = functions or _FUNCTIONS
    sides = [F.struct(F.col(f"{s}.value").cast("double").alias("value"), F.col(f"{s}.ref").cast("int").alias("ref")).alias(s) for s in ("left", "right")]
    calcs = steps.groupBy("calc").agg(F.sort_array(F.collect_list(F.struct(F.col("step").cast("int").alias("step"), "op", *sides))).alias("steps"))

    def follow(done: Column, x: Column) -> Column:
        of = lambda side: F.coalesce(side.value, F.try_element_at(done, side.ref))
        result = F.lit(None).cast("double")
        for name, f in functions.items():
            result = F.when(x.op == name, f(of(x.left), of(x.right))).otherwise(result)
        return F.map_concat(done, F.create_map(x.step, result))

    results = F.aggregate("steps", F.create_map().cast("map<int,double>"), follow)
    return calcs.select("calc", F.explode(results).alias("step", "result"))


def summary(*fields: Column, items: Column, tail: Column) -> Column:
    """Fields, a joined list and a label that depends on a union, with bars between."""
    return F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields), F.array_join(items, ","), tail)
