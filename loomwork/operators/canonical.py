"""One form for equal records, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encoding import let
from ..functions.json_policy import decode, encode


def _defaults_out(value: Column, kind: T.DataType) -> Column:
    """Zero scalars, empty texts and empty lists are what an absent field reads as."""
    if isinstance(kind, T.StructType):
        return F.struct(*(_defaults_out(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return F.when(F.size(value) > 0, F.transform(value, lambda x: _defaults_out(x, kind.elementType)) if isinstance(kind.elementType, T.StructType) else value)
    if isinstance(kind, T.StringType):
        return F.when(value != "", value)
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.when((value != 0) | value.cast("string").startswith("-"), value)
    if isinstance(kind, T.BooleanType):
        return F.when(value, value)
    if isinstance(kind, T.NumericType):
        return F.when(value != 0, value)
    return value


def canonical(df: DataFrame, columns: list[str]) -> Column:
    """Text that two records share if and only if they read the same."""
    schema = T.StructType([df.schema[c] for c in columns])
    record = F.struct(*(F.col(f"`{c}`") for c in columns))
    return encode(_defaults_out(record, schema), schema)


def is_canonical(text: Column, schema: T.StructType) -> Column:
    """Whether a record's text is its canonical one; null where it is no record of ``schema``."""
    same = lambda record: F.when(record.isNotNull(), encode(_defaults_out(record, schema), schema) == text)
    return let(decode(text, schema), same)


def distinct_records(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each distinct record: its ``digest`` and how many rows hold it. Only digests are
    shuffled, after each task has counted its own."""
    return df.select(F.sha2(canonical(df, columns), 256).alias("digest")).groupBy("digest").agg(F.count("*").alias("copies"))


def traversal_words(df: DataFrame, columns: list[str]) -> Column:
    """Words that a reader of the whole record is charged for: its data and pointer words, and the
    words of its texts (with a closing zero), bytes and lists (at least one for elements of no size)."""
    kinds = [df.schema[c].dataType for c in columns]
    bits = sum(1 if isinstance(k, T.BooleanType) else 8 * {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4}.get(type(k), 8) for k in kinds if not isinstance(k, T.StringType | T.BinaryType | T.ArrayType))
    words = F.lit(-(-bits // 64) + sum(isinstance(k, T.StringType | T.BinaryType | T.ArrayType) for k in kinds)).cast("long")
    for c, k in zip(columns, kinds):
        if isinstance(k, T.StringType):
            words = words + F.coalesce(F.ceil((F.octet_length(c) + 1) / 8), F.lit(0))
        elif isinstance(k, T.BinaryType):
            words = words + F.coalesce(F.ceil(F.octet_length(c) / 8), F.lit(0))
        elif isinstance(k, T.ArrayType):
            width = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4}.get(type(k.elementType), 8)
            words = words + F.coalesce(F.ceil(F.size(c) * width / 8), F.lit(0))
    return words
