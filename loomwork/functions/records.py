"""Structs, unions, enums, presence and defaults."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def enum_value(ordinal: Column, names: Sequence[str]) -> Column:
    """``struct<ordinal, name>``; an unknown ordinal stays, with a null name."""
    return F.struct(ordinal.cast("int").alias("ordinal"), F.get(F.array(*(F.lit(n) for n in names)), ordinal.cast("int")).alias("name"))


def union_value(tag: Column, arms: dict[str, Column]) -> Column:
    """``struct<tag, arm...>``: only the active arm is set; an unknown tag stays, with no arm."""
    return F.struct(tag.cast("int").alias("tag"), *(F.when(tag == k, value).alias(name) for k, (name, value) in enumerate(arms.items())))


def which(union: Column, names: Sequence[str]) -> Column:
    """The active arm's name, or ``unknown(tag)``."""
    tag = union.getField("tag")
    return F.coalesce(F.get(F.array(*(F.lit(n) for n in names)), tag), F.concat(F.lit("unknown("), tag.cast("string"), F.lit(")")))


def is_present(value: Column, tag: Column | None = None, arm: int | None = None) -> Column:
    """A field of a union's active arm is present whatever it holds; others if they are not null."""
    return value.isNotNull() if tag is None else tag == arm


def or_default(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def xor_default(stored: Column, default: int) -> Column:
    """A stored integer as its value, or a value as stored: fields equal to the default are 0."""
    return F.coalesce(stored, F.lit(0)).bitwiseXOR(F.lit(default))


def unless_default(value: Column, default) -> Column:
    """Null where ``value`` is the default; floats are compared by their bits."""
    if isinstance(default, float):
        return F.when(value.cast("double").cast("string") != F.lit(default).cast("string"), value)
    return F.nullif(value, F.lit(default))


def set_fields(record: Column, **values: Column) -> Column:
    for name, value in values.items():
        record = record.withField(name, value)
    return record


def clear_field(record: Column, name: str, kind: str) -> Column:
    return record.withField(name, F.lit(None).cast(kind))


def move_field(record: Column, source: str, target: str, kind: str) -> Column:
    """Detach what ``source`` holds and attach it at ``target``."""
    return clear_field(record.withField(target, record.getField(source)), source, kind)


def set_arm(union: Column, names: Sequence[str], arm: str, value: Column) -> Column:
    """The union with another active arm: its value and the tag change together."""
    arms = [(value if n == arm else F.when(F.lit(False), union.getField(n))).alias(n) for n in names]
    return F.when(union.isNotNull(), F.struct(F.lit(list(names).index(arm)).alias("tag"), *arms))


_STEP = re.compile(r"\.?([A-Za-z_]\w*)|\[([0-9]+)\]")


def at_path(record: Column, path: str) -> Column:
    """What stands at a path such as ``home.rooms[3].name``; null outside a list."""
    at = 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m or (at == 0) != (path[at : at + 1] not in ".["):
            raise ValueError(f"no path: {path}")
        record = record.getField(m[1]) if m[1] else F.get(record, F.lit(int(m[2])))
        at = m.end()
    return record


def field_at(record: Column, schema: T.StructType, index: int) -> Column:
    return record.getField(schema.fieldNames()[index])


def flatten_record(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """The fields of struct ``column`` as columns of their own, in its place."""
    out: list[Column] = []
    for f in df.schema.fields:
        if f.name == column:
            out += [F.col(f"`{column}`").getField(n).alias(prefix + n) for n in f.dataType.fieldNames()]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def with_discriminator(union: Column, names: Sequence[str], kind: str = "kind", value: str = "value") -> Column:
    """A union as a tag name and one value, as text."""
    arm = F.coalesce(*(F.when(union.getField("tag") == k, union.getField(n).cast("string")) for k, n in enumerate(names)))
    return F.struct(which(union, names).alias(kind), arm.alias(value))
