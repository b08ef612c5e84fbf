"""Names of field types, and the Spark types that hold them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import types as T

from millrace.errors import PlanError

UNITS = ("s", "ms", "us", "ns")
#: Units of a timestamp's integer in a second.
PER_SECOND = {"s": 1, "ms": 10**3, "us": 10**6, "ns": 10**9}
_SIMPLE = {"string": "string", "int64": "int64", "float64": "float64", "bool": "bool", "boolean": "bool", "dictionary": "dictionary", "date32": "date32"}
_OF_CALLABLE = {int: "int64", float: "float64", bool: "bool", date: "date32", datetime: "timestamp", Decimal: "decimal128"}
#: chrono directives and the Java pattern letters that mean the same.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%I": "hh", "%p": "a", "%e": "d", "%T": "HH:mm:ss", "%F": "yyyy-MM-dd", "%f": "SSSSSSSSS", "%%": "%"}


@dataclass(frozen=True)
class FieldType:
    kind: str
    unit: str = "us"
    format: str | None = None
    scale: int = 18

    @property
    def spark(self) -> T.DataType:
        return {"int64": T.LongType(), "float64": T.DoubleType(), "bool": T.BooleanType(), "date32": T.DateType(), "timestamp": T.TimestampNTZType(), "decimal128": T.DecimalType(38, self.scale)}.get(self.kind, T.StringType())

    @property
    def metadata(self) -> dict:
        return {"encoding": "dictionary"} if self.kind == "dictionary" else {"unit": self.unit} if self.kind == "timestamp" else {}


def parse_type(spec: str) -> FieldType:
    """string, int64, float64, bool, boolean, dictionary, date32, timestamp[unit,format=...] or decimal128(scale)."""
    text = spec.strip()
    if text in _SIMPLE:
        return FieldType(_SIMPLE[text])
    if m := re.fullmatch(r"decimal128(?:\((\d+)\))?", text):
        scale = int(m[1]) if m[1] else 18
        if scale > 38:
            raise PlanError(f"decimal scale {scale} is beyond 38")
        return FieldType("decimal128", scale=scale)
    if m := re.fullmatch(r"timestamp(?:\[(.*)\])?", text, re.DOTALL):
        unit, pattern = "us", None
        if m[1] is not None:
            head, _, tail = m[1].partition(",")
            for part in [m[1]] if head.startswith("format=") else [head, *([tail] if tail else [])]:
                if part.startswith("format="):
                    pattern = part[len("format=") :]
                elif part.strip() in UNITS:
                    unit = part.strip()
                else:
                    raise PlanError(f"unknown timestamp option {part!r} in {spec!r}")
        return FieldType("timestamp", unit, pattern)
    raise PlanError(f"unknown field type {spec!r}")


def type_of_callable(fn) -> str | None:
    """The field type that a Python type means as a cast; None if it can only run in Python."""
    return _OF_CALLABLE.get(fn)


def java_pattern(chrono: str) -> str:
    """The Java datetime pattern of a chrono format."""
    out, i = [], 0
    while i < len(chrono):
        two = chrono[i : i + 2]
        if two[0] == "%":
            if two not in DIRECTIVES:
                raise PlanError(f"unsupported directive {two!r} in timestamp format")
            out.append(DIRECTIVES[two])
            i += 2
        else:
            c = two[0]
            out.append(f"'{c}'" if c.isalpha() else "''" if c == "'" else c)
            i += 1
    return "".join(out)


def kind_of(dtype: T.DataType) -> str:
    """The family that a Spark type belongs to in predicates."""
    for kind, of in (("int", T.IntegralType), ("float", (T.DoubleType, T.FloatType)), ("bool", T.BooleanType), ("date", T.DateType), ("timestamp", (T.TimestampNTZType, T.TimestampType)), ("decimal", T.DecimalType), ("string", (T.StringType, T.VarcharType, T.CharType))):
        if isinstance(dtype, of):
            return kind
    return "other"
