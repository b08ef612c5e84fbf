"""Filters: each operator, two-valued logic, and a brute-force evaluator as the judge of random trees."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.errors import PlanError
from millrace.operators.stages import FilterRows, FilterRowsAny
from millrace.plans.expr import col
from millrace.plans.predicate import filtered, validate

ROWS = [(1, 5, 1.5, "yes"), (2, None, float("nan"), " x "), (3, -2, None, None), (4, 7, 2.0, ""), (5, 0, -1.0, "é")]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id long, n long, v double, s string")


def ids(df, spec):
    return sorted(r["id"] for r in filtered(df, spec).collect())


@pytest.mark.parametrize(
    ("predicate", "kept"),
    [
        (col("n") > 1, [1, 4]),
        (~(col("n") > 1), [2, 3, 5]),
        (col("n") != 5, [3, 4, 5]),
        (col("v") != 2, [1, 5]),
        (~(col("v") > 1), [2, 3, 5]),
        (col("s") == "yes", [1]),
        (col("n").isin([5, 7]), [1, 4]),
        (col("n").not_in([5, 7]), [2, 3, 5]),
        (col("v").isin(["2"]), [4]),
        (col("s").strip("==", "x"), [2]),
        (col("s").lstrip("==", "x "), [2]),
        (col("s").length("==", 1), [5]),
        (col("s").is_null(), [3]),
        (col("s").is_not_null(), [1, 2, 4, 5]),
        (col("n") == "x", []),
        (~(col("n") == "x"), [1, 2, 3, 4, 5]),
        (col("n") > col("v"), [1, 4, 5]),
        (col("n") != col("s"), []),
        (~(col("n") != col("s")), [1, 2, 3, 4, 5]),
        (col("gone").is_null(), [1, 2, 3, 4, 5]),
        (col("gone") == 1, []),
        (col("s").matches("^.e"), [1]),
        (col("v").is_type("int64"), [4, 5]),
        (col("n").between(0, 5), [1, 5]),
    ],
)
def test_operators(df, predicate, kept):
    assert ids(df, predicate) == kept


def test_specs(df):
    assert ids(df, {"not_field": "s"}) == [3, 4]
    assert ids(df, {"field": "s", "op": "not_equal", "value": "yes"}) == [2, 3, 4, 5]
    assert ids(df, {"field": "n", "arith_op": "*", "arith_value": 2, "op": ">=", "value": 10}) == [1, 4]
    assert ids(df, {"not": {"field": "n", "arith_op": "/", "arith_value": 0, "op": ">", "value": 1}}) == [1, 2, 3, 4, 5]
    assert ids(df, {"always": False}) == []


def test_limits():
    nested = {"always": True}
    for _ in range(126):
        nested = {"not": nested}
    validate({"not": nested})
    for bad in ({"not": {"not": nested}}, {"and": []}, {"field": "x", "op": "??", "value": "1"}, {"field": "x", "op": "regex", "value": "(?=a)"}, {"field": "x", "op": "regex", "value": "("}, {"field": "x", "op": "in", "values": ["1"] * 100_001}, "x"):
        with pytest.raises(PlanError):
            validate(bad)
    with pytest.raises(ValueError):
        FilterRows(field="a", op="contains", value="b")
    with pytest.raises(ValueError):
        FilterRowsAny(FilterRows(col("a") == 1))
    with pytest.raises(TypeError):
        bool(col("a") == 1)


def test_negation_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).withColumn("n", F.col("id")).write.parquet(path)
    plan = filtered(spark.read.parquet(path), ~(col("n") > 3))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(n),LessThanOrEqual(n,3))]" in plan
    plan = filtered(spark.read.parquet(path), col("n").isin([3, 5]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(n, [3,5])]" in plan


def test_members_compare_canonical_texts(df):
    assert ids(df, col("n").isin(["05", "+7", "5.0"])) == []
    assert ids(df, col("n").not_in(["05"])) == [1, 2, 3, 4, 5]
    assert ids(df, col("v").isin([2, -1])) == [4, 5]
    assert ids(df, col("v").isin(["2.0", "1.5"])) == [1]


def holds(spec, row) -> bool:
    if "and" in spec:
        return all(holds(s, row) for s in spec["and"])
    if "or" in spec:
        return any(holds(s, row) for s in spec["or"])
    if "not" in spec:
        return not holds(spec["not"], row)
    if spec.get("op") == "is_null":
        return row[spec["field"]] is None
    x = row[spec["field"]]
    if spec["op"] == "not_in":
        return x is None or str(x) not in spec["values"]
    if x is None or isinstance(x, float) and math.isnan(x):
        return False
    y = float(spec["value"])
    return {"==": x == y, "!=": x != y, ">": x > y, "<": x < y}[spec["op"]]


def test_random_trees(df):
    rng = random.Random(5)

    def tree(depth):
        kind = rng.choice(["and", "or", "not", "leaf", "leaf"]) if depth else "leaf"
        if kind in ("and", "or"):
            return {kind: [tree(depth - 1) for _ in range(rng.randint(1, 3))]}
        if kind == "not":
            return {"not": tree(depth - 1)}
        leaf = rng.choice(["cmp", "null", "not_in"])
        if leaf == "cmp":
            return {"field": rng.choice(["n", "v"]), "op": rng.choice(["==", "!=", ">", "<"]), "value": str(rng.randint(-2, 7))}
        return {"field": "n", "op": "is_null"} if leaf == "null" else {"field": "n", "op": "not_in", "values": [str(rng.randint(-2, 7))]}

    for _ in range(40):
        spec = tree(4)
        assert ids(df, spec) == [r[0] for r in ROWS if holds(spec, dict(zip(("id", "n", "v", "s"), r, strict=True)))], spec


def test_decimal_and_day_literals(spark):
    from datetime import date
    from decimal import Decimal

    rows = [(1, Decimal("1.2"), date(1970, 1, 3)), (2, Decimal("-0.9"), date(2000, 1, 1)), (3, None, None)]
    df = spark.createDataFrame(rows, "id long, d decimal(4,1), day date")
    for text, kept in (("1.25", [1]), ("1.29", [1]), ("12e-1", []), ("+1.2", [1]), ("-.99", [2]), ("1.", []), ("9" * 39, []), ("", []), (".", [])):
        assert ids(df, {"field": "d", "op": "==", "value": text}) == kept, text
    assert ids(df, ~(col("d") == "12e-1")) == [1, 2, 3]
    assert ids(df, col("day") == 2) == [1] and ids(df, col("day") == "+2") == [1] and ids(df, col("day") > date(1999, 1, 1)) == [2] and ids(df, col("day") != "x") == []


def test_decimals_of_far_scales(spark):
    from decimal import Decimal

    pairs = [("0.1", "0.10"), ("99", "99.01"), ("-5.5", "-5.49"), ("0.000000001", "0"), ("-0.1", "0"), ("12345678901234567890123456789012", "12345678901234567890123456789012.00")]
    wide = [(i, Decimal(a), Decimal(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame([(i, str(a), str(b)) for i, a, b in wide], "id long, x string, y string")
    near = df.selectExpr("id", "cast(x as decimal(38,2)) x", "cast(y as decimal(38,6)) y")
    for op, test in (("<", lambda a, b: a < b), ("==", lambda a, b: a == b), (">=", lambda a, b: a >= b)):
        cut = [(i, Decimal(a).quantize(Decimal("0.01")) if abs(Decimal(a)) < 10**30 else Decimal(a), Decimal(b)) for i, (a, b) in enumerate(pairs)]
        assert ids(near, {"field_a": "x", "op": op, "field_b": "y"}) == [i for i, a, b in cut if test(a, b)], op


def test_keyword_filters():
    assert FilterRows(field="a", is_null=True).spec == {"field": "a", "op": "is_null"}
    assert FilterRows(field="a", is_null=False).spec == {"not": {"field": "a", "op": "is_null"}}
    assert FilterRows(field="a", is_type="int64").spec == {"field": "a", "op": "is_type", "value": "int64"}
    assert FilterRows(field="a", op="eq", value=True).spec == {"field": "a", "op": "eq", "value": "true"}
    assert FilterRows(field_a="a", op="<", field_b="b").spec == {"field_a": "a", "op": "<", "field_b": "b"}
    for bad in ({}, {"field": "a"}, {"field": "a", "op": "starts_with", "value": "x"}):
        with pytest.raises(ValueError):
            FilterRows(**bad)
    for bad in ({"fields": "a"}, {"predicate": 3}):
        with pytest.raises(TypeError):
            FilterRows(**bad)


def test_expressions_are_trees():
    tree = ~((col("a") == 1) | (col("b") > col("c"))) & col("d").startswith("x")
    assert tree.to_spec() == {"and": [{"not": {"or": [{"field": "a", "op": "==", "value": "1"}, {"field_a": "b", "op": ">", "field_b": "c"}]}}, {"field": "d", "op": "starts_with", "value": "x"}]}
    with pytest.raises(TypeError):
        bool(tree)
    with pytest.raises(TypeError):
        col("a").isin("abc")
    with pytest.raises(ValueError):
        col("a").not_in([])
    with pytest.raises(TypeError):
        col("a") == object()  # noqa: B015
