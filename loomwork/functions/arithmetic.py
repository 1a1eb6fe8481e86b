"""Integers that wrap or are guarded, and numbers read from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .encoding import let

INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1


def wrap32(x: Column) -> Column:
    """A long as the 32-bit integer with the same low bits."""
    return (F.pmod(x.cast("long") + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")


def wrapping_add(a: Column, b: Column) -> Column:
    return wrap32(a.cast("long") + b.cast("long"))


def wrapping_subtract(a: Column, b: Column) -> Column:
    return wrap32(a.cast("long") - b.cast("long"))


def wrapping_multiply(a: Column, b: Column) -> Column:
    return wrap32(a.cast("long") * b.cast("long"))


def _undefined(a: Column, b: Column) -> Column:
    return (b == 0) | ((a == INT_MIN) & (b == -1))


def safe_divide(a: Column, b: Column) -> Column:
    """Quotient towards zero; the largest integer where there is none."""
    return F.when(_undefined(a, b), F.lit(INT_MAX)).otherwise(F.try_divide(a.cast("decimal(11,0)"), b.cast("decimal(11,0)")).cast("int"))


def safe_modulus(a: Column, b: Column) -> Column:
    """Remainder with the sign of ``a``; the largest integer where there is none."""
    return F.when(_undefined(a, b), F.lit(INT_MAX)).otherwise(F.try_mod(a.cast("long"), b.cast("long")).cast("int"))


def _no_underscores(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(""))


def parse_unsigned(text: Column) -> Column:
    """Decimal digits, with a plus sign or not, or ``0x`` and hexadecimal ones; underscores are
    ignored; null for anything else (``0X`` too) and beyond 64 bits."""
    number = lambda d: F.when(F.length(d) <= 20, d).try_cast("decimal(38,0)")
    return let(let(let(_no_underscores(text), _digits), number), lambda value: F.when(value <= F.lit("18446744073709551615").cast("decimal(20,0)"), value.cast("decimal(20,0)")))


def _digits(t: Column) -> Column:
    """The decimal digits of an unsigned integer without leading zeros."""
    hexes = F.when(t.rlike("^0x[0-9a-fA-F]+$"), F.regexp_replace(F.substring(t, 3, 1 << 30), "^0+(?=.)", ""))
    of_hexes = let(hexes, lambda h: F.when(F.length(h) <= 16, F.conv(h, 16, 10)))
    return F.when(t.rlike(r"^\+?[0-9]+$"), F.regexp_replace(t, r"^\+?0*(?=.)", "")).otherwise(of_hexes)


def parse_signed(text: Column) -> Column:
    """As :func:`parse_unsigned` or with a minus sign, if a long can hold it."""

    def read(t: Column) -> Column:
        negative = t.startswith("-") & ~t.startswith("-+")
        size = parse_unsigned(F.when(negative, F.substring(t, 2, 1 << 30)).otherwise(t)).cast("decimal(38,0)")
        return let(size, lambda n: F.when(negative, -n).otherwise(n).try_cast("long"))

    return let(text, read)


def parse_float(text: Column) -> Column:
    """A double, underscores ignored; ``inf``, ``infinity`` and ``nan`` in any case, with a sign or not."""
    return let(F.lower(text), _float)


def _float(low: Column) -> Column:
    bare = F.regexp_replace(low, "^[+-]", "")
    special = let(bare, lambda b: F.when(b.isin("inf", "infinity"), F.when(low.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).when(b == "nan", F.lit(float("nan"))))
    plain = lambda t: F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), t.try_cast("double"))
    return F.coalesce(let(_no_underscores(low), plain), special)
