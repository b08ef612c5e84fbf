"""Filter specs to Spark conditions.

Every test is true or false, never null: a null or absent operand makes most tests false, and negation turns that to
true. Spark's logic has three values, so negation is pushed down to the tests. Where a test is wanted true it stands
alone, as a null drops the row just as well and the bare test reaches the scan; where it is wanted false, it becomes
"null, or not the test", which reaches the scan too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import PlanError
from millrace.functions.casts import DATE, FLOAT, INT, canonical, trimmed
from millrace.functions.types import PER_SECOND, kind_of, parse_type

MAX_DEPTH, MAX_VALUES, MAX_PATTERN = 128, 100_000, 1 << 20
_OPS = {"eq": "==", "ne": "!=", "gt": ">", "lt": "<", "ge": ">=", "le": "<="}
_COMPARE: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
_ARITHMETIC = {"+": "add", "-": "sub", "*": "mul", "/": "div"}
_TEXT_OPS = ("strip", "lstrip", "rstrip", "lower", "upper")


@dataclass
class Test:
    """A leaf: false where one of the columns is null or NaN, else what the condition says."""

    says: Column | bool
    nulls: list[Column] = field(default_factory=list)
    nans: list[Column] = field(default_factory=list)
    #: what a null operand gives
    if_null: bool = False

    def true(self) -> Column:
        if isinstance(self.says, bool):
            return F.lit(self.says)
        held = reduce(lambda a, b: a & b, [~F.isnan(c) for c in self.nans], self.says)
        return reduce(lambda a, b: a | b, [c.isNull() for c in self.nulls], held) if self.if_null else held

    def false(self) -> Column:
        if isinstance(self.says, bool):
            return F.lit(not self.says)
        if self.if_null:
            return ~self.says
        lacking = [c.isNull() for c in self.nulls] + [F.isnan(c) for c in self.nans]
        return reduce(lambda a, b: a | b, [*lacking, ~self.says])


def compare_op(op: str) -> str:
    out = _OPS.get(op, op)
    if out not in _COMPARE:
        raise PlanError(f"unsupported compare op {op!r}; valid: ==, !=, >, <, >=, <= and eq, ne, gt, lt, ge, le")
    return out


def _need(spec: dict, *keys: str) -> list:
    for k in keys:
        if k not in spec:
            raise PlanError(f"a filter must have {k!r}: {spec!r}")
    return [spec[k] for k in keys]


def validate(spec, depth: int = 0) -> None:
    """Raises PlanError unless the spec can be compiled over some schema."""
    compiled(spec, {}, depth=depth)


def to_spec(predicate) -> dict:
    return predicate.to_spec() if hasattr(predicate, "to_spec") else predicate


def pattern_of(pattern: str) -> str:
    """A pattern that Java reads as a linear-time engine would; look-around and back-references are refused."""
    if len(pattern) > MAX_PATTERN:
        raise PlanError(f"a regex of {len(pattern)} characters is too long")
    if re.search(r"(?<!\\)(?:\\\\)*(\(\?(=|!|<=|<!)|\\[1-9])", pattern):
        raise PlanError("look-around and back-references are not supported")
    try:
        re.compile(pattern)
    except re.error as e:
        raise PlanError(f"invalid regex in filter: {e}") from None
    return pattern.replace("(?P<", "(?<")


def _number(text: str) -> float | None:
    return float(text) if re.match(FLOAT, text) else None


def _decimal(text: str, scale: int) -> Decimal | None:
    """A decimal literal at a column's scale: further digits are cut off, exponents and what 38 digits can't hold are refused."""
    m = re.fullmatch(r"\s*([+-]?)([0-9]*)(?:\.([0-9]*))?\s*", text)
    if not m or not (m[2] or m[3]):
        return None
    units = int((m[2] or "0") + (m[3] or "")[:scale].ljust(scale, "0"))
    return Decimal(f"{'-' if m[1] == '-' else ''}{units}E-{scale}") if units < 10**38 else None


def typed_literal(text: str, dtype: T.DataType, unit: str = "us"):
    """The literal in the column's type; None if it can't be.

    Dates and timestamps are compared with integers, days or units since 1970; as an extension, ISO texts are read too.
    """
    kind = kind_of(dtype)
    if kind == "string":
        return text
    if kind == "int":
        return int(text) if re.match(INT, text) and -(2**63) <= int(text) < 2**63 else None
    if kind == "float":
        x = _number(text)
        return None if x is None or math.isnan(x) else x
    if kind == "bool":
        return {"true": True, "false": False}.get(text.lower() if text in ("true", "True", "TRUE", "false", "False", "FALSE") else text)
    if kind == "decimal":
        return _decimal(text, dtype.scale)
    if kind in ("date", "timestamp"):
        try:
            if re.fullmatch(r"[+-]?[0-9]+", text):
                return date(1970, 1, 1) + timedelta(days=int(text)) if kind == "date" else datetime(1970, 1, 1) + timedelta(microseconds=int(text) * 10**6 // PER_SECOND[unit])
            if kind == "date":
                return date.fromisoformat(text.strip())
            return datetime.fromisoformat(text.strip().replace("T", " "))
        except (ValueError, OverflowError):
            return None
    return None


def typed_members(values: list[str], dtype: T.DataType) -> list | None:
    """The values that can equal a column's canonical text, in the column's own type, so that the test reaches the scan;
    None if the text itself must be compared."""
    kind = kind_of(dtype)
    if kind == "int":
        return [int(v) for v in values if re.fullmatch(r"0|-?[1-9][0-9]{0,18}", v) and -(2**63) <= int(v) < 2**63]
    if kind == "float" and isinstance(dtype, T.DoubleType) and all(re.fullmatch(r"-?[1-9][0-9]{0,14}", v) for v in values):
        return [float(v) for v in values]
    return None


def _as_column(value, dtype: T.DataType) -> Column:
    kind = kind_of(dtype)
    if kind == "timestamp":
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz" if isinstance(dtype, T.TimestampNTZType) else "timestamp")
    if kind == "decimal":
        return F.lit(f"{value:f}").cast(T.DecimalType(38, dtype.scale))
    return F.lit(value)


class _Compiler:
    def __init__(self, schema: dict[str, T.DataType], metadata: dict[str, dict], resolve: Callable[[str], Column]) -> None:
        self.schema, self.metadata, self.resolve = schema, metadata, resolve

    def column(self, name: str) -> tuple[Column, T.DataType] | None:
        return (self.resolve(name), self.schema[name]) if name in self.schema else None

    def unit(self, name: str) -> str:
        return self.metadata.get(name, {}).get("unit", "us")

    def build(self, spec, wanted: bool, depth: int) -> Column:
        if depth >= MAX_DEPTH:
            raise PlanError(f"filters are nested deeper than {MAX_DEPTH}")
        if not isinstance(spec, dict):
            raise PlanError(f"a filter spec must be a dict, not {type(spec).__name__}")
        for word in ("and", "or"):
            if word in spec:
                parts = spec[word]
                if not isinstance(parts, (list, tuple)):
                    raise PlanError(f"{word!r} takes a list of filters")
                if not parts:
                    raise PlanError(f"{word!r} needs at least one filter")
                built = [self.build(to_spec(p), wanted, depth + 1) for p in parts]
                return reduce((lambda a, b: a & b) if (word == "and") == wanted else (lambda a, b: a | b), built)
        if "not" in spec:
            return self.build(to_spec(spec["not"]), not wanted, depth + 1)
        test = self.leaf(spec)
        return test.true() if wanted else test.false()

    def leaf(self, spec: dict) -> Test:
        if "always" in spec:
            return Test(bool(spec["always"]))
        if "not_field" in spec:
            found = self.column(spec["not_field"])
            return Test(True) if found is None else Test(canonical(*found) == "", [found[0]], if_null=True)
        (op,) = _need(spec, "op")
        if "arith_op" in spec:
            return self.arithmetic(spec)
        if "field_a" in spec and "field_b" in spec:
            return self.columns(spec["field_a"], compare_op(op), spec["field_b"])
        if "old" in spec and "new" in spec:
            name, old, new, value = _need(spec, "field", "old", "new", "value")
            if old == "":
                raise PlanError("replace needs a non-empty text to look for")
            return self.texts(name, lambda c: F.replace(c, F.lit(old), F.lit(new)), compare_op(spec.get("cmp_op", op)), value)
        (name,) = _need(spec, "field")
        if "values" in spec:
            values = [v if isinstance(v, str) else str(v) for v in spec["values"]]
            if len(values) > MAX_VALUES:
                raise PlanError(f"{len(values)} values are too many; the most is {MAX_VALUES}")
            if op not in ("in", "not_in"):
                raise PlanError(f"unsupported op {op!r} on values; valid: in, not_in")
            return self.members(name, values, op == "in")
        if op == "is_null":
            found = self.column(name)
            return Test(True) if found is None else Test(found[0].isNull())
        (value,) = _need(spec, "value")
        if op == "regex":
            pattern = pattern_of(value)
            return self.shaped(name, lambda c: c.rlike(pattern))
        if op == "is_type":
            return self.is_type(name, value)
        if op in ("equal", "not_equal"):
            found = self.column(name)
            if found is None:
                return Test(op == "not_equal")
            text = canonical(*found)
            return Test(text == value, [found[0]]) if op == "equal" else Test(text != value, [found[0]], if_null=True)
        if op in ("starts_with", "ends_with", "contains"):
            return self.shaped(name, lambda c: {"starts_with": c.startswith, "ends_with": c.endswith, "contains": c.contains}[op](F.lit(str(value))))
        if op in _TEXT_OPS:
            change = {"strip": trimmed, "lstrip": lambda c: trimmed(c, right=False), "rstrip": lambda c: trimmed(c, left=False), "lower": F.lower, "upper": F.upper}[op]
            return self.texts(name, change, compare_op(spec.get("cmp_op", "==")), value)
        if op == "length":
            limit = _number(str(value))
            how = _COMPARE[compare_op(spec.get("cmp_op", ">"))]
            if limit is None or math.isnan(limit):
                return Test(False)
            return self.shaped(name, lambda c: how(F.char_length(c).cast("double"), F.lit(limit)))
        return self.literal(name, compare_op(op), str(value))

    def shaped(self, name: str, test: Callable[[Column], Column]) -> Test:
        found = self.column(name)
        return Test(False) if found is None else Test(test(canonical(*found)), [found[0]])

    def texts(self, name: str, change, op: str, value) -> Test:
        return self.shaped(name, lambda c: _COMPARE[op](change(c), F.lit(str(value))))

    def members(self, name: str, values: list[str], inside: bool) -> Test:
        found = self.column(name)
        if found is None:
            return Test(not inside)
        typed = typed_members(values, found[1])
        if typed is not None:
            test = found[0].isin(typed) if typed else F.lit(False)
            return Test(test if inside else ~test, [found[0]], if_null=not inside)
        text = canonical(*found)
        return Test(text.isin(values), [found[0]]) if inside else Test(~text.isin(values), [found[0]], if_null=True)

    def literal(self, name: str, op: str, text: str) -> Test:
        found = self.column(name)
        if found is None:
            return Test(False)
        c, dtype = found
        value = typed_literal(text, dtype, self.unit(name))
        if value is None:
            return Test(False)
        return Test(_COMPARE[op](c, _as_column(value, dtype)), [c], [c] if kind_of(dtype) == "float" else [])

    def columns(self, left: str, op: str, right: str) -> Test:
        a, b = self.column(left), self.column(right)
        if a is None or b is None:
            return Test(False)
        kinds = kind_of(a[1]), kind_of(b[1])
        how, x, y = _COMPARE[op], a[0], b[0]
        if "other" in kinds or kinds[0] != kinds[1] and set(kinds) != {"int", "float"}:
            return Test(False)
        if kinds[0] == "timestamp" and self.unit(left) != self.unit(right):
            return Test(False)
        if kinds == ("decimal", "decimal"):
            return Test(self.decimals(how, a, b), [x, y])
        if "float" in kinds:
            nans = [c for c, k in zip((x, y), kinds, strict=True) if k == "float"]
            return Test(how(x.cast("double"), y.cast("double")) if kinds[0] != kinds[1] else how(x, y), [x, y], nans)
        return Test(how(x, y), [x, y])

    def decimals(self, how, a, b) -> Column:
        """Exact at any scales: where no common type of 38 digits holds both, whole parts are compared before fractions."""
        (x, p), (y, q) = a, b
        if max(p.precision - p.scale, q.precision - q.scale) + max(p.scale, q.scale) <= 38:
            return how(x, y)
        whole = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("decimal(38,0)")
        part = lambda c, t: (c - whole(c).cast(t)).cast(T.DecimalType(38, min(37, t.scale)))
        scale = T.DecimalType(38, 37)
        sign = F.when(whole(x) > whole(y), 1).when(whole(x) < whole(y), -1).when(part(x, p).cast(scale) > part(y, q).cast(scale), 1).when(part(x, p).cast(scale) < part(y, q).cast(scale), -1).otherwise(0)
        return how(sign, F.lit(0))

    def arithmetic(self, spec: dict) -> Test:
        name, sign, by, value = _need(spec, "field", "arith_op", "arith_value", "value")
        sign = {"add": "+", "sub": "-", "mul": "*", "div": "/"}.get(sign, sign)
        if sign not in _ARITHMETIC:
            raise PlanError(f"unsupported arithmetic op {sign!r}")
        how, by, value = _COMPARE[compare_op(spec["op"])], _number(str(by)), _number(str(value))
        found = self.column(name)
        if found is None or by is None or value is None or math.isnan(by) or math.isnan(value) or sign == "/" and by == 0:
            return Test(False)
        c, dtype = found
        if kind_of(dtype) not in ("int", "float", "decimal"):
            return Test(False)
        x = c.cast("double")
        made = {"+": x + by, "-": x - by, "*": x * by, "/": x / by}[sign]
        return Test(how(made, F.lit(value)), [c], [made])

    def is_type(self, name: str, target: str) -> Test:
        to = parse_type(target)
        found = self.column(name)
        if found is None:
            return Test(False)
        c, dtype = found
        kind, there = kind_of(dtype), Test(c.isNotNull())
        whole = {"int64": "int", "float64": "float", "bool": "bool", "date32": "date", "decimal128": "decimal", "string": "string", "dictionary": "string"}
        is_dictionary = self.metadata.get(name, {}).get("encoding") == "dictionary"
        if kind == "string":
            if to.kind == "dictionary" and is_dictionary or to.kind in ("string", "dictionary") and not is_dictionary or to.kind == "string":
                return there
            if is_dictionary:
                return Test(False)
            whole_number = c.rlike(INT) & c.try_cast("bigint").isNotNull()
            tests = {
                "int64": whole_number,
                "float64": c.rlike(FLOAT),
                "bool": F.lower(c).isin("true", "false", "1", "0", "yes", "no"),
                "date32": c.rlike(DATE) & trimmed(c).try_cast("date").isNotNull(),
                "timestamp": whole_number | (c.rlike(DATE) & trimmed(c).try_cast("date").isNotNull()),
                "decimal128": trimmed(c).rlike(INT) | c.rlike(FLOAT),
            }
            return Test(tests[to.kind], [c])
        if to.kind == "timestamp":
            return there if kind == "timestamp" and self.unit(name) == to.unit else Test(False)
        if kind == whole.get(to.kind) or to.kind == "string":
            return there
        if kind == "int":
            return there if to.kind == "float64" else Test(c.isin(0, 1), [c]) if to.kind == "bool" else Test(False)
        if kind == "float":
            fits = (c == F.floor(c).cast("double")) & (F.abs(c) <= float(2**63))
            return Test(fits, [c], [c]) if to.kind == "int64" else Test(c.isin(0.0, 1.0), [c], [c]) if to.kind == "bool" else Test(False)
        if to.kind == "int64" and kind in ("bool", "date", "timestamp", "decimal") or to.kind == "float64" and kind in ("bool", "decimal"):
            return there
        return Test(False)


def compiled(spec, schema: dict[str, T.DataType], metadata: dict[str, dict] | None = None, resolve: Callable[[str], Column] | None = None, depth: int = 0) -> Column:
    """The condition for DataFrame.filter(). A name that the schema lacks is a column of nulls."""
    resolve = resolve or (lambda name: F.col("`" + name.replace("`", "``") + "`"))
    return _Compiler(schema, metadata or {}, resolve).build(to_spec(spec), True, depth)


def filtered(df, spec):
    """df's rows that fit the predicate or spec."""
    schema = {f.name: f.dataType for f in df.schema}
    return df.filter(compiled(spec, schema, {f.name: f.metadata or {} for f in df.schema}))
