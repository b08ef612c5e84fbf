"""Casts of text to types, by a grammar of their own, and the one text form of typed values.

Spark's own casts trim, accept years alone, round decimals and take many words for booleans. Here a guard decides first
whether a text is of the type at all; only then Spark converts it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import PlanError, raised
from millrace.functions.types import FieldType, java_pattern, kind_of

INT = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
DATE = r"^\s*[+-]?[0-9]+-[0-9]{1,2}-[0-9]{1,2}\s*$"
TIMESTAMP = r"^\s*([+-]?[0-9]+-[0-9]{1,2}-[0-9]{1,2})([T ]([0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(\.[0-9]+)?))?\s*$"
DECIMAL = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\s*$"
#: Unicode's White_Space property, as a character class.
WHITE = "[\\t-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
#: Its characters.
WHITE_CHARS = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column, left: bool = True, right: bool = True) -> Column:
    if left:
        c = F.regexp_replace(c, f"^{WHITE}+", "")
    return F.regexp_replace(c, f"{WHITE}+$", "") if right else c


def _date(c: Column) -> Column:
    return F.when(c.rlike(DATE), trimmed(c).try_cast("date"))


def _timestamp(c: Column, pattern: str | None) -> Column:
    day, clock = F.regexp_extract(c, TIMESTAMP, 1), F.regexp_extract(c, TIMESTAMP, 3)
    plain = F.when(c.rlike(TIMESTAMP), F.concat(day, F.lit(" "), F.when(clock == "", "00:00:00").otherwise(clock)).try_cast("timestamp_ntz"))
    if pattern is None:
        return plain
    own = F.try_to_timestamp(trimmed(c), F.lit(java_pattern(pattern))).cast("timestamp_ntz")
    return F.coalesce(own, plain)


def _decimal(c: Column, scale: int) -> Column:
    """Digits beyond the scale are cut off, not rounded; what doesn't fit 38 digits is null."""
    text = F.btrim(c, F.lit(" \t\n\x0b\f\r"))
    whole, fraction = F.split_part(text, F.lit("."), F.lit(1)), F.substring(F.split_part(text, F.lit("."), F.lit(2)), 1, scale)
    return F.when(c.rlike(DECIMAL), F.concat(whole, F.lit("."), fraction, F.lit("0")).try_cast(T.DecimalType(38, scale)))


def lenient(c: Column, to: FieldType) -> Column:
    """The text column as the type; null where it isn't of the type."""
    if to.kind == "int64":
        return F.when(c.rlike(INT), c.try_cast("bigint"))
    if to.kind == "float64":
        return F.when(c.rlike(FLOAT), F.regexp_replace(c, r"^\+", "").try_cast("double"))
    if to.kind == "bool":
        return F.when(c == "true", True).when(c == "false", False)
    if to.kind == "date32":
        return _date(c)
    if to.kind == "timestamp":
        return _timestamp(c, to.format)
    if to.kind == "decimal128":
        return _decimal(c, to.scale)
    return c


def strict(c: Column, to: FieldType, name: str) -> Column:
    """Like lenient(), but a text that isn't of the type fails the query with a PlanError."""
    parsed = lenient(c, to)
    if to.kind in ("string", "dictionary"):
        return parsed
    said = F.concat(F.lit(f"column {name!r}: can't read "), F.substring(c, 1, 64), F.lit(f" as {to.kind}"))
    return F.when(c.isNotNull() & parsed.isNull(), raised(PlanError, said).cast(to.spark)).otherwise(parsed)


def checked(c: Column, dtype: T.DataType, to: FieldType, name: str) -> Column:
    """A typed column as the type, where nothing may be lost: a value that the type can't hold as it is fails the query,
    and kinds that have nothing to do with each other fail the plan."""
    kind = kind_of(dtype)
    ways = {
        ("int", "bool"): lambda: (c != 0, None), ("float", "bool"): lambda: (c != 0, None), ("bool", "int64"): lambda: (c.cast("bigint"), None), ("bool", "float64"): lambda: (c.cast("double"), None),
        ("float", "int64"): lambda: (F.when(~F.isnan(c), c.try_cast("bigint")), c != F.floor(c)), ("decimal", "int64"): lambda: (c.try_cast("bigint"), c != F.floor(c)), ("decimal", "float64"): lambda: (c.cast("double"), None),
        ("int", "float64"): lambda: (c.cast("double"), F.abs(c.cast("decimal(20,0)")) > 1 << 53), ("int", "decimal128"): lambda: (c.try_cast(to.spark), None), ("float", "decimal128"): lambda: (c.try_cast(to.spark), None),
        ("decimal", "decimal128"): lambda: (c.try_cast(to.spark), c.try_cast(to.spark) != c), ("date", "timestamp"): lambda: (c.cast("timestamp_ntz"), None), ("timestamp", "date32"): lambda: (c.cast("date"), None),
        ("date", "int64"): lambda: (F.unix_date(c).cast("bigint"), None), ("timestamp", "int64"): lambda: (F.unix_micros(c.cast("timestamp")), None),
    }
    same = {"int": "int64", "float": "float64", "bool": "bool", "date": "date32", "timestamp": "timestamp"}
    if same.get(kind) == to.kind:
        return c.cast(to.spark)
    if (kind, to.kind) not in ways:
        raise PlanError(f"column {name!r}: {dtype.simpleString()} can't be cast to {to.kind}")
    made, lossy = ways[kind, to.kind]()
    fails = made.isNull() if lossy is None else made.isNull() | lossy
    said = F.concat(F.lit(f"column {name!r}: "), c.cast("string"), F.lit(f" doesn't fit {to.kind}"))
    return F.when(c.isNotNull() & fails, raised(PlanError, said).cast(to.spark)).otherwise(made)


def converted(c: Column, dtype: T.DataType, to: FieldType, name: str, is_strict: bool) -> Column:
    """Any column as the type: text by the grammar, typed values by the few conversions that keep their meaning."""
    kind = kind_of(dtype)
    if kind == "string":
        return strict(c, to, name) if is_strict else lenient(c, to)
    if to.kind in ("string", "dictionary"):
        return canonical(c, dtype)
    if is_strict:
        return checked(c, dtype, to, name)
    if kind == "int" and to.kind == "float64":
        return c.cast("double")
    if kind == "int" and to.kind == "decimal128":
        return c.try_cast(to.spark)
    if kind == "float" and to.kind == "int64":
        return F.when(~F.isnan(c), F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).try_cast("bigint"))
    if kind == "date" and to.kind in ("int64", "float64"):
        return F.unix_date(c).cast(to.spark)
    if dtype == to.spark or (kind, to.kind) in (("int", "int64"), ("float", "float64"), ("bool", "bool"), ("date", "date32"), ("timestamp", "timestamp"), ("decimal", "decimal128")):
        return c.cast(to.spark)
    return F.lit(None).cast(to.spark)


def _plain_double(c: Column) -> Column:
    """A double without exponent, and without .0. Java's text is used as it is unless it has an exponent."""
    text = c.cast("string")
    sign, size = F.when(F.startswith(text, F.lit("-")), "-").otherwise(""), F.abs(c).cast("string")
    power = F.split_part(size, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.rtrim(F.translate(F.split_part(size, F.lit("E"), F.lit(1)), ".", ""), F.lit("0"))
    n = F.length(digits)
    large = F.when(n - 1 <= power, F.concat(digits, F.repeat(F.lit("0"), power - n + 1))).otherwise(F.concat(digits.substr(F.lit(1), power + 1), F.lit("."), digits.substr(power + 2, n)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    spelled = F.concat(sign, F.when(power >= 0, large).otherwise(small))
    whole = F.substring(text, F.lit(1), F.length(text) - 2)
    return F.when(F.endswith(text, F.lit(".0")), whole).when(F.contains(text, F.lit("E")), spelled).when(F.endswith(text, F.lit("Infinity")), F.concat(sign, F.lit("inf"))).otherwise(text)


def canonical(c: Column, dtype: T.DataType) -> Column:
    """The one text form of a value: whole doubles without .0, no exponents, fractions of seconds in groups of three."""
    kind = kind_of(dtype)
    if kind == "string":
        return c
    if kind == "float":
        return _plain_double(c.cast("double"))
    if kind == "timestamp":
        text = c.cast("timestamp_ntz").cast("string")
        fraction = F.regexp_extract(text, r"\.([0-9]+)$", 1)
        width = F.ceil(F.length(fraction) / 3).cast("int") * 3
        return F.when(fraction == "", text).otherwise(F.concat(F.regexp_extract(text, r"^([^.]*)", 1), F.lit("."), F.rpad(fraction, width, F.lit("0"))))
    return c.cast("string")
