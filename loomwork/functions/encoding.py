"""Bytes and text: fixed-width integers, base64, hex, quoting, floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _swapped(hexes: Column, width: int) -> Column:
    return F.concat(*(F.substring(hexes, 2 * k + 1, 2) for k in reversed(range(width))))


def little_endian(value: Column, width: int) -> Column:
    """The low ``width`` bytes of a long, lowest first."""
    return F.unhex(_swapped(F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * width)), width))


def read_little_endian(raw: Column, start: Column | int, width: int, signed: bool = False) -> Column:
    """An integer of ``width`` (1 to 8) bytes from byte ``start`` (from 1), as a long. Unsigned ones
    of 8 bytes beyond a long come back as the long of the same bits, which is what ``signed`` reads."""
    if not 1 <= width <= 8:
        raise ValueError("a little-endian integer has 1 to 8 bytes")
    part = _swapped(F.hex(F.substring(raw, start, width) if isinstance(start, int) else F.substr(raw, start, F.lit(width))), width)
    if width < 8:
        value = F.conv(part, 16, 10).cast("long")
        return F.when(value >= 1 << (8 * width - 1), value - (1 << 8 * width)).otherwise(value) if signed else value
    return F.conv(part, 16, -10).cast("long")


def double_bits(x: Column) -> Column:
    """The bits of a double as a long (one form for nan), from its hexadecimal notation."""

    def of(t: Column) -> Column:
        negative, fraction = t.startswith("-"), F.rpad(F.regexp_extract(t, r"\.([0-9a-f]+)p", 1), 13, "0")
        power = F.regexp_extract(t, r"p(-?[0-9]+)$", 1).try_cast("int")
        normal = F.regexp_extract(t, r"0x([01])\.", 1) == "1"
        mantissa = F.conv(F.when(fraction == "0" * 13, "0").otherwise(fraction), 16, 10).cast("long")
        size = F.when(normal, F.shiftleft((power + 1023).cast("long"), 52)).otherwise(F.lit(0).cast("long")) + mantissa
        return F.when(negative, size.bitwiseOR(F.lit(-(1 << 63)))).otherwise(size)

    special = F.when(F.isnan(x), F.lit(0x7FF8 << 48)).when(x == float("inf"), F.lit(0x7FF << 52)).when(x == float("-inf"), F.lit(-(1 << 63) + (0x7FF << 52)))
    return F.coalesce(special, let(F.format_string("%a", x), of))


def bits_double(bits: Column) -> Column:
    """The double of 64 bits, given as a long."""
    power, mantissa = F.shiftright(bits, 52).bitwiseAND(F.lit(0x7FF)), bits.bitwiseAND(F.lit((1 << 52) - 1))
    sign = F.when(bits < 0, -1.0).otherwise(1.0)
    finite = F.when(power == 0, mantissa * F.lit(2.0**-1074)).otherwise((mantissa + F.lit(1 << 52)) * F.lit(2.0**-52) * F.pow(F.lit(2.0), (power - 1023).cast("double")))
    return F.when(power == 0x7FF, F.when(mantissa == 0, sign * float("inf")).otherwise(F.lit(float("nan")))).otherwise(sign * finite)


def to_base64(raw: Column) -> Column:
    return F.regexp_replace(F.base64(raw), "[\r\n]", "")


def from_base64(text: Column) -> Column:
    """Null unless ``text`` is padded base64 whose unused bits are zero."""
    strict = text.rlike("^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    raw = F.when(strict, F.unbase64(F.when(strict, text)))
    return F.when(to_base64(raw) == text, raw)


def to_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def from_hex(text: Column) -> Column:
    """Null unless ``text`` is an even number of hexadecimal digits."""
    return F.when(text.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(F.when(text.rlike("^([0-9a-fA-F]{2})*$"), text)))


# The escapes of quoted text.
ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]


_CONTROL = "[\\x00-\\x1f\\x7f\\x{80}-\\x{9f}]"
_PLAIN = _CONTROL.replace("[", "[^")


def _octal(raw: Column) -> Column:
    """Bytes (as text) as three octal digits each."""
    h = F.hex(raw)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.octet_length(raw) - 1), lambda i: F.concat(F.lit("\\"), F.lpad(F.conv(F.substr(h, 2 * i + 1, F.lit(2)), 16, 8), 3, "0"))), "")


def quote(text: Column) -> Column:
    """Text in quotes; control characters as octal bytes."""
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))

    def of(t: Column) -> Column:
        runs = F.regexp_extract_all(t, F.lit(f"(?s){_CONTROL}+|{_PLAIN}+"), F.lit(0))
        return F.when(t.rlike(_CONTROL), F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^" + _CONTROL), _octal(r)).otherwise(r)), "")).otherwise(t)

    return F.concat(F.lit('"'), let(text, of), F.lit('"'))


def quote_bytes(raw: Column) -> Column:
    """Bytes in quotes; all but printable ASCII as octal bytes."""
    plain = {p: e for p, e in ESCAPES}
    h = F.hex(raw)

    def sign(i: Column) -> Column:
        n = F.conv(F.substr(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
        out = F.when(n.between(32, 126), F.chr(n)).otherwise(F.concat(F.lit("\\"), F.lpad(F.conv(n.cast("string"), 10, 8), 3, "0")))
        for p, e in plain.items():
            out = F.when(n == ord(p), e).otherwise(out)
        return out

    places = F.filter(F.sequence(F.lit(0), F.octet_length(raw)), lambda i: i < F.octet_length(raw))
    return F.concat(F.lit('"'), F.array_join(F.transform(places, sign), ""), F.lit('"'))


def unquote_bytes(text: Column) -> Column:
    """The bytes inside quotes: the escapes, ``\\ooo`` and ``\\xhh``; null without quotes or where an
    escape is none of these."""
    def read(t: Column) -> Column:
        inner = F.when(t.startswith('"') & t.endswith('"') & (F.length(t) >= 2), F.substr(t, F.lit(2), F.length(t) - 2))
        # Between two escaped backslashes every other backslash begins an escape.
        return let(F.split(inner, r"\\\\", -1), lambda parts: let(F.transform(parts, part), joined))

    def part(p: Column) -> Column:
        short = p
        for plain, escaped in ESCAPES[1:]:
            short = F.replace(short, F.lit(escaped), F.lit(plain))
        return let(short, lambda s: F.when(F.contains(s, F.lit("\\")), coded(s)).otherwise(F.hex(s)))

    def coded(s: Column) -> Column:
        """The bytes of a part with codes, in hexadecimal digits; null where an escape is no code."""
        pieces = F.regexp_extract_all(s, F.lit(r"(?s)\\[0-3][0-7]{2}|\\x[0-9a-fA-F]{2}|[^\\]+|\\"), F.lit(0))
        raw = lambda p: F.when(~p.startswith("\\"), F.hex(p)).when(p.startswith("\\x"), F.substring(p, 3, 2)).when(p != "\\", F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 2, "0"))
        return let(F.transform(pieces, raw), lambda h: F.when(~F.exists(h, lambda x: x.isNull()), F.array_join(h, "")))

    joined = lambda h: F.when(~F.exists(h, lambda x: x.isNull()), F.unhex(F.array_join(h, "5C")))
    return let(text, read)


def unquote(text: Column) -> Column:
    """The text inside quotes, see :func:`unquote_bytes`; null also where it is not UTF-8."""
    return let(unquote_bytes(text).cast("string"), lambda t: F.when(F.is_valid_utf8(t), t))


def let(value: Column, then) -> Column:
    """``then(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _with_digits(x: Column, then) -> Column:
    """``then(sign, digits, point)`` of the shortest form that reads as the same finite double; the
    point stands after the first ``point`` digits."""

    def split(t: Column) -> Column:
        mantissa = F.regexp_replace(F.substring_index(t, "e", 1), "[-.]", "")
        return F.struct(
            F.when(t.startswith("-"), "-").otherwise("").alias("sign"), F.regexp_replace(mantissa, "(?<=.)0+$", "").alias("digits"),
            (F.substring_index(t, "e", -1).try_cast("int") + 1).alias("point"),
        )

    forms = [F.format_string(f"%.{n}e", x) for n in (0, 14, 15, 16)]
    shortest = F.coalesce(*(let(form, lambda f: F.when(f.try_cast("double") == x, f)) for form in forms[:-1]), forms[-1])
    return let(shortest, lambda t: let(split(t), lambda s: then(s.sign, s.digits, s.point)))


def _decimal(digits: Column, point: Column) -> Column:
    """Digits with the point after the first ``point`` of them, in full."""
    n = F.length(digits)
    return (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
        .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1, n)))
    )


def _negative_zero(x: Column) -> Column:
    return (x == 0) & x.cast("string").startswith("-")


def float_text(x: Column) -> Column:
    """Shortest decimal form without exponent or needless point; nan, inf, -inf, -0."""
    special = F.when(F.isnan(x), F.lit("nan")).when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf")).when(_negative_zero(x), F.lit("-0")).when(x == 0, F.lit("0"))
    return F.coalesce(special, _with_digits(x, lambda sign, digits, point: F.concat(sign, _decimal(digits, point))))


def float_json(x: Column) -> Column:
    """As JSON: an exponent only outside 1e-6 to 1e21, quoted names where not finite."""
    special = F.when(F.isnan(x), F.lit('"NaN"')).when(x == float("inf"), F.lit('"Infinity"')).when(x == float("-inf"), F.lit('"-Infinity"')).when(_negative_zero(x), F.lit("-0")).when(x == 0, F.lit("0"))

    def form(sign: Column, digits: Column, point: Column) -> Column:
        rest = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2), F.length(digits)))).otherwise(F.lit(""))
        short = F.concat(F.substring(digits, 1, 1), rest, F.lit("e"), (point - 1).cast("string"))
        return F.concat(sign, F.when(point.between(-5, 21), _decimal(digits, point)).otherwise(short))

    return F.coalesce(special, _with_digits(x, form))
