"""Records as JSON and as text literals: 64-bit integers of JSON as strings, bytes as arrays of
numbers, absent fields left out."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arithmetic import parse_float, parse_signed
from .encoding import float_json, float_text, let, quote, quote_bytes, unquote, unquote_bytes

#: By the path of a field (``user.id``) or the class of a type: what takes the place of the policy.
Handlers = Mapping[str | type, Callable[[Column], Column]]
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _handler(handlers: Handlers, path: str, kind: T.DataType) -> Callable[[Column], Column] | None:
    return handlers.get(path) or handlers.get(type(kind))


def _bytes(raw: Column) -> Column:
    h = F.hex(raw)
    places = F.filter(F.sequence(F.lit(0), F.octet_length(raw)), lambda i: i < F.octet_length(raw))
    return F.transform(places, lambda i: F.conv(F.substr(h, 2 * i + 1, F.lit(2)), 16, 10))


def _json_string(text: Column) -> Column:
    return let(F.to_json(F.struct(text.alias("v"))), lambda whole: F.substr(whole, F.lit(6), F.length(whole) - 6))


def _double(value: Column, kind: T.DataType) -> Column:
    return value.cast("string").cast("double") if isinstance(kind, T.FloatType) else value  # 0.1f is 0.1


def _json(value: Column, kind: T.DataType, handlers: Handlers, path: str) -> Column:
    """Text, null where ``value`` is."""
    own = _handler(handlers, path, kind)
    if own:
        return own(value)
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(f'"{f.name}":'), _json(value.getField(f.name), f.dataType, handlers, f"{path}.{f.name}".lstrip("."))) for f in kind.fields]
        return F.when(value.isNotNull(), F.concat(F.lit("{"), F.array_join(F.array(*fields), ","), F.lit("}")))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: F.coalesce(_json(x, kind.elementType, handlers, path + "[]"), F.lit("null"))), ","), F.lit("]"))
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("["), F.array_join(_bytes(value), ","), F.lit("]"))
    if isinstance(kind, T.FloatType | T.DoubleType):
        return float_json(_double(value, kind))
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.BooleanType):
        return value.cast("string")
    if isinstance(kind, T.LongType | T.DecimalType):
        return F.concat(F.lit('"'), value.cast("string"), F.lit('"'))
    return let(value.cast("string"), lambda t: F.when(t.isNotNull(), _json_string(t)))


def encode(record: Column, schema: T.StructType, handlers: Handlers | None = None) -> Column:
    """``record`` as JSON text in the order of its fields; null fields are left out. Integers of 64
    bits and decimals are strings, bytes are arrays of numbers, floats have their shortest form,
    quoted names where they are not finite. ``handlers`` give JSON text for a field or a type."""
    return let(record, lambda r: _json(r, schema, handlers or {}, ""))


def _accepted(v: Column, kind: T.DataType, handlers: Handlers, path: str) -> Column:
    """A variant as a value of ``kind``; null where it is of another kind."""
    own = _handler(handlers, path, kind)
    if own:
        return own(v)
    return let(F.schema_of_variant(v), lambda of: _accepted_as(v, of, kind, handlers, path))


def _accepted_as(v: Column, of: Column, kind: T.DataType, handlers: Handlers, path: str) -> Column:
    """``of``: the variant's own kind. Parts are bound by :func:`let`, so that what follows from a
    value names it once for each field, and not once for all that is made of the fields."""
    text = F.try_variant_get(v, "$", "string")
    if isinstance(kind, T.StructType):
        field = lambda f: let(F.try_variant_get(v, f"$['{f.name}']", "variant"), lambda x: _accepted(x, f.dataType, handlers, f"{path}.{f.name}".lstrip(".")))
        return F.when(of.startswith("OBJECT"), F.struct(*(field(f).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(F.when(of.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")), lambda x: _accepted(x, kind.elementType, handlers, path + "[]"))
    if isinstance(kind, T.BinaryType):
        numbers = F.transform(F.when(of.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")), lambda x: _accepted(x, T.IntegerType(), {}, ""))
        whole = lambda n: F.forall(n, lambda x: F.coalesce(x.between(0, 255), F.lit(False)))
        return let(numbers, lambda n: F.when(whole(n), F.unhex(F.array_join(F.transform(n, lambda x: F.lpad(F.hex(x), 2, "0")), ""))))
    if isinstance(kind, _INTEGERS):
        return F.when((of == "STRING") | (of == "BIGINT") | of.startswith("DECIMAL"), let(text, lambda t: F.when(t.rlike("^-?[0-9]+$"), t.try_cast(kind))))
    if isinstance(kind, T.BooleanType):
        return F.when(of == "BOOLEAN", text == "true")
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.when(of == "VOID", F.lit(float("nan"))).when((of == "STRING") | (of == "BIGINT") | (of == "DOUBLE") | of.startswith("DECIMAL"), parse_float(text)).cast(kind)
    if isinstance(kind, T.StringType):
        return F.when(of == "STRING", text)
    return text.try_cast(kind)


def decode(text: Column, schema: T.StructType, handlers: Handlers | None = None) -> Column:
    """A JSON object as a record, nested ones too; null where it is no JSON or names a field twice.

    Integers come from their digits alone, quoted or not, so nothing beside them can come in; what
    is of another kind than its field is null. ``null`` is nan for a float. Bytes are arrays of
    numbers. Unknown fields are left out, see :func:`unknown_fields`; ``handlers`` make a value of
    a variant."""
    return let(F.try_parse_json(text), lambda v: _accepted(v, schema, handlers or {}, ""))


def unknown_fields(text: Column, schema: T.StructType) -> Column:
    """Names in a JSON object that the schema lacks; a strict reader takes none."""
    return F.array_except(F.json_object_keys(text), F.array(*(F.lit(n) for n in schema.fieldNames())))


def has_duplicate_keys(text: Column) -> Column:
    """Whether an object names a field twice (:func:`decode` refuses it, and does not take the last)."""
    return let(F.json_object_keys(text), lambda keys: F.size(keys) != F.size(F.array_distinct(keys)))


def literal(value: Column, kind: T.DataType) -> Column:
    """A value as a text literal: ``(name = "x", sizes = [1, 2], home = (x = 1.5))``; null fields
    are left out, null elements are empty records, texts or numbers of 0."""
    return let(value, lambda v: _literal(v, kind))


def _literal(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(f"{f.name} = "), _literal(value.getField(f.name), f.dataType)) for f in kind.fields]
        return F.when(value.isNotNull(), F.concat(F.lit("("), F.array_join(F.array(*fields), ", "), F.lit(")")))
    if isinstance(kind, T.ArrayType):
        empty = "()" if isinstance(kind.elementType, T.StructType) else '""' if isinstance(kind.elementType, T.StringType | T.BinaryType) else "0"
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: F.coalesce(_literal(x, kind.elementType), F.lit(empty))), ", "), F.lit("]"))
    if isinstance(kind, T.StringType):
        return quote(value)
    if isinstance(kind, T.BinaryType):
        return quote_bytes(value)
    if isinstance(kind, T.FloatType | T.DoubleType):
        return float_text(_double(value, kind))
    return value.cast("string")


_QUOTED = r'"(?:[^"\\]|\\.)*"'


def _tree(text: Column) -> Column:
    """A text literal as JSON: every scalar but booleans is a string, texts with their quotes and
    escapes. Texts are set aside while names, brackets and bare words are rewritten."""

    def bare(part: Column) -> Column:
        part = F.regexp_replace(F.translate(part, "()", "{}"), r"([A-Za-z_]\w*)\s*=", '"$1":')
        return F.regexp_replace(part, r'(?<![\w".+-])(?!(?:true|false)\b)([+-]?[A-Za-z0-9_.][\w.+-]*)(?![\w".+-])', '"$1"')

    outside = F.transform(F.split(text, _QUOTED, -1), bare)
    inside = F.transform(F.regexp_extract_all(text, F.lit(_QUOTED), F.lit(0)), _json_string)
    return F.array_join(F.flatten(F.zip_with(outside, inside, lambda o, i: F.array(o, F.coalesce(i, F.lit(""))))), "")


def from_literal(text: Column, schema: T.StructType) -> Column:
    """A text literal as a record, nested ones too; null where it is none, or names a field twice or
    one that the schema lacks."""
    whole = lambda v: F.try_variant_get(v, "$", "string")
    kinds = {t: (lambda v, t=t: parse_signed(whole(v)).try_cast(t())) for t in _INTEGERS}
    kinds |= {T.StringType: lambda v: unquote(whole(v)), T.BinaryType: lambda v: unquote_bytes(whole(v))}
    read = lambda json: F.when(F.size(unknown_fields(json, schema)) == 0, decode(json, schema, kinds))
    return let(text, lambda t: let(_tree(t), read))
