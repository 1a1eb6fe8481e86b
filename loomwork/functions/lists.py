"""Typed lists: checked access, upgrades between element types, building from parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .records import enum_value


def read_list(values: Column) -> Column:
    """An absent list reads as an empty one."""
    return F.coalesce(values, F.array())


def get_checked(values: Column, index: Column | int) -> Column:
    """The element at ``index`` (from 0); an error outside the list."""
    index = F.lit(index) if isinstance(index, int) else index
    wrong = F.raise_error(F.concat(F.lit("index "), index.cast("string"), F.lit(" is outside a list of "), F.size(values).cast("string")))
    return F.when((index < 0) | (index >= F.size(values)), wrong).otherwise(F.get(values, index))


def first_fields(structs: Column, name: str) -> Column:
    """A list of structs read as the list of scalars that it has grown from."""
    return F.transform(structs, lambda x: x.getField(name))


def as_structs(scalars: Column, name: str, **defaults) -> Column:
    """A list of scalars read as structs whose other fields have their defaults."""
    return F.transform(scalars, lambda x: F.struct(x.alias(name), *(F.lit(v).alias(k) for k, v in defaults.items())))


def as_enums(ordinals: Column, names: Sequence[str]) -> Column:
    """A list of ordinals read as enums, see :func:`~loomwork.functions.records.enum_value`."""
    return F.transform(ordinals, lambda x: enum_value(x, names))


def set_at(values: Column, index: Column | int, value: Column) -> Column:
    """The list with another element at ``index``; an error outside the list."""
    index = F.lit(index) if isinstance(index, int) else index
    inside = get_checked(F.transform(values, lambda _, i: i), index)
    return F.transform(values, lambda x, i: F.when(i == inside, value).otherwise(x))


_BITS = {T.BooleanType: 1, T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.FloatType: 32, T.LongType: 64, T.DoubleType: 64, T.TimestampType: 64, T.DateType: 32}


def _scalar_fits(stored: T.DataType, wanted: T.DataType) -> bool:
    have, need = _BITS.get(type(stored)), _BITS.get(type(wanted))
    if have is None or need is None:
        return type(stored) is type(wanted) and (not isinstance(stored, T.ArrayType) or upgrades(stored.elementType, wanted.elementType))
    return (have == 1) == (need == 1) and need <= have


def upgrades(stored: T.DataType | str, wanted: T.DataType | str) -> bool:
    """Whether a list stored with elements ``stored`` can be read with elements ``wanted`` (types or
    DDL): scalars at most as wide, never booleans, which are bits, with anything else; and a scalar
    for a struct, or the other way round, whose first field of that kind (data, or a text or list)
    is such a scalar."""
    stored, wanted = (T.DataType.fromDDL(x) if isinstance(x, str) else x for x in (stored, wanted))
    inner = [isinstance(x, T.StructType) for x in (stored, wanted)]
    if all(inner):
        return True  # fields are found by name, those that lack have their defaults
    if not any(inner):
        return _scalar_fits(stored, wanted)
    struct, scalar = (stored, wanted) if inner[0] else (wanted, stored)
    if isinstance(scalar, T.BooleanType):
        return False
    data = type(scalar) in _BITS
    first = next((f.dataType for f in struct.fields if (type(f.dataType) in _BITS) == data), None)
    return first is not None and not isinstance(first, T.BooleanType) and (_scalar_fits(first, scalar) if inner[0] else _scalar_fits(scalar, first))


def build_list(parts: DataFrame, keys: list[str], slot: str, value: str, out: str = "items") -> DataFrame:
    """A list for each key from rows that hold its slots, in the slots' order."""
    return parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(slot, value))).alias("lw")).select(*keys, F.col("lw").getField(value).alias(out))


def build_sparse_list(parts: DataFrame, keys: list[str], slot: str, value: str, size: Column | int, out: str = "items") -> DataFrame:
    """A list of ``size`` (a number, or a column over each key's rows) for each key; slots without a
    row are null; a slot with two, none, or beyond the list is an error."""
    size = F.lit(size) if isinstance(size, int) else size
    filled = parts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(slot, value))).alias("lw"), size.cast("int").alias("lw_size"), F.min(slot).alias("lw_low"), F.max(slot).alias("lw_high"))
    places = F.filter(F.sequence(F.lit(0), F.col("lw_size")), lambda i: i < F.col("lw_size"))
    wrong = F.raise_error(F.concat(F.lit("slots "), F.col("lw_low").cast("string"), F.lit(" to "), F.col("lw_high").cast("string"), F.lit(" in a list of "), F.col("lw_size").cast("string")))
    whole = F.transform(places, lambda i: F.try_element_at("lw", i.cast(parts.schema[slot].dataType)))
    return filled.select(*keys, F.when((F.col("lw_low") < 0) | (F.col("lw_high") >= F.col("lw_size")), wrong).otherwise(whole).alias(out))
