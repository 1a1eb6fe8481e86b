"""Schemas as rows, ids of types, and reading records of an older or newer schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _rows(schema: T.StructType, at: str = "") -> list[tuple[str, int, str, bool]]:
    out = []
    for i, f in enumerate(schema.fields):
        name = f"{at}{f.name}"
        out.append((name, i, f.dataType.simpleString(), f.nullable))
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(inner, T.StructType):
            out += _rows(inner, name + ".")
    return out


def fields(df: DataFrame) -> DataFrame:
    """A row for each field of ``df``, also within structs: ``path``, ``ordinal``, ``type``, ``nullable``."""
    return df.sparkSession.createDataFrame(_rows(df.schema), "path string, ordinal int, type string, nullable boolean")


def _nodes(schema: T.StructType, path: str, parent: str | None) -> list[tuple[str, str | None, int, int, int]]:
    pointers = sum(isinstance(f.dataType, T.StringType | T.BinaryType | T.ArrayType | T.StructType | T.MapType) for f in schema.fields)
    out = [(path, parent, len(schema.fields), len(schema.fields) - pointers, pointers)]
    for f in schema.fields:
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(inner, T.StructType):
            out += _nodes(inner, f"{path}.{f.name}", path)
    return out


def nodes(df: DataFrame, name: str, scope: str) -> DataFrame:
    """A row for each struct of ``df``, itself as ``name``: ``path``, ``parent``, the id derived from
    the 16 digits of ``scope``, and how many fields, data fields and pointers it has."""
    rows = df.sparkSession.createDataFrame(_nodes(df.schema, name, None), "path string, parent string, fields int, data int, pointers int")
    return rows.withColumn("type_id", child_id(F.lit(scope), F.col("path")))


def enumerants(df: DataFrame, column: str, name: str) -> DataFrame:
    """The values of a column as an enum: ``enum``, ``ordinal`` in the order of the values, ``name``."""
    found = df.select(F.col(f"`{column}`").cast("string").alias("name")).where("name is not null").distinct()
    ordered = found.agg(F.array_sort(F.collect_list("name")).alias("names"))  # an enum's names
    return ordered.select(F.lit(name).alias("enum"), F.posexplode("names").alias("ordinal", "name"))


def child_id(parent: Column, name: Column) -> Column:
    """A type's 64-bit id as 16 hexadecimal digits: of the digest of parent's digits and name, the
    first 8 bytes with the highest bit set."""
    h = F.md5(F.concat(parent, name))
    high = F.lower(F.hex((F.conv(F.substring(h, 1, 1), 16, 10).cast("long")).bitwiseOR(F.lit(8))))
    return F.concat(high, F.substring(h, 2, 15))


def _default(f: T.StructField) -> Column:
    return F.lit(f.metadata.get("default")).cast(f.dataType).alias(f.name)


def _upgraded(values: Column, have: T.DataType, want: T.DataType) -> Column:
    """Scalars as structs whose first field they are, or the other way round."""
    if isinstance(want, T.StructType):
        return F.transform(values, lambda x: F.struct(x.cast(want.fields[0].dataType).alias(want.fields[0].name), *(_default(f) for f in want.fields[1:])))
    return F.transform(values, lambda x: x.getField(have.fieldNames()[0]).cast(want))


def read_as(df: DataFrame, schema: T.StructType, renamed: dict[str, str] | None = None) -> DataFrame:
    """``df``, written with another version of its schema, as ``schema``: fields are found under
    their older names too, those that are not there have the default in their metadata (or are
    null), and lists change between scalars and structs whose first field the scalar is."""
    renamed = renamed or {}
    out = []
    for f in schema.fields:
        old = f.name if f.name in df.columns else renamed.get(f.name, f.name)
        if old not in df.columns:
            out.append(_default(f))
            continue
        c, have = F.col(f"`{old}`"), df.schema[old].dataType
        if isinstance(have, T.ArrayType) and isinstance(f.dataType, T.ArrayType) and isinstance(have.elementType, T.StructType) != isinstance(f.dataType.elementType, T.StructType):
            c = _upgraded(c, have.elementType, f.dataType.elementType)
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)
