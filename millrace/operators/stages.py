"""Stages of a pipeline: each turns a DataFrame into another."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import PlanError
from millrace.functions.casts import canonical
from millrace.functions.types import kind_of, type_of_callable
from millrace.operators import schema
from millrace.plans import predicate as predicates
from millrace.plans.expr import COMPARISONS, Predicate, literal

#: Rows that a Python stage sees to learn its output's columns.
SAMPLE_ROWS = 1024
HOOKS = ("on_begin_row", "on_put_field", "on_row_accepted", "on_row_rejected", "on_chunk_finished")


class Stage:
    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


class RenameFields(Stage):
    def __init__(self, mapping: dict[str, str]) -> None:
        self.mapping = dict(mapping)
        if len(set(self.mapping.values())) < len(self.mapping):
            raise ValueError("two fields can't be renamed to the same name")

    def transform(self, df: DataFrame) -> DataFrame:
        return schema.rename(df, self.mapping)


class DropFields(Stage):
    def __init__(self, fields) -> None:
        if isinstance(fields, str):
            raise TypeError("DropFields takes a collection of names")
        self.fields = set(fields)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*(c for c in df.columns if c in self.fields))


class ProjectFields(Stage):
    def __init__(self, fields: list[str], types: dict[str, str] | None = None) -> None:
        self.fields, self.types = list(fields), types

    def transform(self, df: DataFrame) -> DataFrame:
        return schema.project(df, self.fields, self.types)


def _called(call: Callable):
    """A function on single values as a column function over Arrow batches; its results as text."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else str(call(x)) for x in values.to_pylist()], pa.string())

    return run


class CastTypes(Stage):
    """Strict casts: by type names, or Python types (int, float, bool, date, datetime, Decimal), or any callable."""

    def __init__(self, types: dict) -> None:
        self.types = dict(types)

    def transform(self, df: DataFrame) -> DataFrame:
        named = {k: v if isinstance(v, str) else type_of_callable(v) for k, v in self.types.items()}
        df = schema.typed(df, {k: v for k, v in named.items() if v}, strict=True)
        kinds = {f.name: f.dataType for f in df.schema}
        made = {k: canonical(F.col(schema.quoted(k)), kinds[k]) if self.types[k] is str else _called(self.types[k])(F.col(schema.quoted(k))) for k, v in named.items() if not v and k in kinds}
        return df.withColumns(made) if made else df


def _null_test(k: dict) -> dict:
    test = {"field": k["field"], "op": "is_null"}
    return test if k["is_null"] else {"not": test}


def _comparison(k: dict) -> dict:
    if k["op"] not in KEYWORD_OPS:
        raise ValueError(f"op={k['op']!r} is not for keyword filters; use col({k['field']!r}) instead")
    return {"field": k["field"], "op": k["op"], "value": literal(k["value"])}


KEYWORD_OPS = {*COMPARISONS.values(), "eq", "ne", "gt", "lt", "ge", "le", "regex"}
#: Keywords that make up a filter, and how; the first set that is all there counts.
KEYWORD_FILTERS: tuple[tuple[set[str], Callable[[dict], dict]], ...] = (
    ({"field", "is_null"}, _null_test),
    ({"field", "is_type"}, lambda k: {"field": k["field"], "op": "is_type", "value": k["is_type"]}),
    ({"field", "op", "value"}, _comparison),
    ({"field_a", "op", "field_b"}, lambda k: {name: k[name] for name in ("field_a", "op", "field_b")}),
)


class FilterRows(Stage):
    """Rows that fit an expression, a callable on dict rows, or one of KEYWORD_FILTERS."""

    def __init__(self, predicate=None, **keywords) -> None:
        self.call: Callable | None = None
        self.spec: dict | None = None
        if unknown := set(keywords) - set().union(*(names for names, _ in KEYWORD_FILTERS)):
            raise TypeError(f"unknown keywords {sorted(unknown)}")
        if isinstance(predicate, Predicate):
            self.spec = predicate.to_spec()
        elif callable(predicate):
            self.call = predicate
        elif predicate is not None:
            raise TypeError("a filter is an expression or a callable")
        else:
            given = {k: v for k, v in keywords.items() if v is not None}
            make = next((make for names, make in KEYWORD_FILTERS if names <= given.keys()), None)
            if make is None:
                raise ValueError("a filter takes an expression, a callable, or keywords: " + "; ".join(", ".join(sorted(n)) for n, _ in KEYWORD_FILTERS))
            self.spec = make(given)
        if self.spec is not None:
            predicates.validate(self.spec)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.call is None:
            return predicates.filtered(df, self.spec)
        call = self.call
        return MapRecords(lambda r: r if call(r) else None, df.schema).transform(df)


class _Combined(FilterRows):
    word = ""

    def __init__(self, *filters: FilterRows) -> None:
        if len(filters) < 2:
            raise ValueError(f"{type(self).__name__} needs two filters or more")
        super().__init__(Predicate({self.word: [spec_of(f) for f in filters]}))


def spec_of(f) -> dict:
    spec = f.to_spec() if isinstance(f, Predicate) else getattr(f, "spec", None)
    if spec is None:
        raise TypeError("only filters by expression can be combined")
    return spec


class FilterRowsAll(_Combined):
    word = "and"


class FilterRowsAny(_Combined):
    word = "or"


class FilterRowsNot(FilterRows):
    def __init__(self, inner: FilterRows) -> None:
        super().__init__(Predicate({"not": spec_of(inner)}))


class MapRecords(Stage):
    """A function on dict rows that returns a dict, or None to drop the row.

    The output's columns are those of the first results, as strings where types can't be told, unless a schema is given:
    of the first rows, or where none of these is kept, of the first SAMPLE_ROWS kept ones wherever they stand. A later
    row with another key fails.
    """

    def __init__(self, call: Callable[[dict], dict | None], output: T.StructType | str | None = None) -> None:
        self.call, self.output = call, output

    def transform(self, df: DataFrame) -> DataFrame:
        call, output = self.call, self.output
        if output is None:
            made = [x for r in df.limit(SAMPLE_ROWS).collect() if (x := call(r.asDict())) is not None]
            if not made:
                made = _first_kept(df, call)
            if not made:
                return df.filter(F.lit(False))
            keys = dict.fromkeys(k for x in made for k in x)
            kept = {f.name: f.dataType for f in df.schema}
            output = T.StructType([T.StructField(k, _type_of([x[k] for x in made if x.get(k) is not None], kept.get(k))) for k in keys])
        if isinstance(output, str):
            output = T._parse_datatype_string(output)
        names = output.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(output)
            for batch in batches:
                rows = [x for r in batch.to_pylist() if (x := call(r)) is not None]
                for x in rows:
                    if extra := set(x) - set(names):
                        raise ValueError(f"a row has keys that the first rows lack: {sorted(extra)}")
                yield pa.RecordBatch.from_pylist([{n: x.get(n) for n in names} for x in rows], arrow)

        return df.mapInArrow(run, output)


def _first_kept(df: DataFrame, call: Callable[[dict], dict | None]) -> list[dict]:
    """The first results of the whole table, at most SAMPLE_ROWS; partitions are read until there are so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (x for b in batches for r in b.to_pylist() if (x := call(r)) is not None)
        for x in islice(found, SAMPLE_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(x)], pa.binary())], names=["made"])

    return [pickle.loads(r["made"]) for r in df.mapInArrow(run, "made binary").limit(SAMPLE_ROWS).collect()]


def _type_of(values: list, before: T.DataType | None) -> T.DataType:
    kinds = {type(v) for v in values}
    of = {int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), str: T.StringType()}
    if len(kinds) == 1 and (found := of.get(next(iter(kinds)))):
        return found
    return before if before is not None and kind_of(before) != "other" else T.StringType()


class StreamStage(Stage):
    """A function from an iterator of dict rows to another, of any lengths. It sees the whole stream, in one task."""

    def __init__(self, call: Callable[[Iterator[dict]], Iterator[dict]], output: T.StructType | str) -> None:
        self.call, self.output = call, output

    def transform(self, df: DataFrame) -> DataFrame:
        call, output = self.call, T._parse_datatype_string(self.output) if isinstance(self.output, str) else self.output

        def run(batches):
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow, held = to_arrow_schema(output), []
            for x in call(r for b in batches for r in b.to_pylist()):
                held.append(x)
                if len(held) >= SAMPLE_ROWS:
                    yield pa.RecordBatch.from_pylist(held, arrow)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, arrow)

        return df.coalesce(1).mapInArrow(run, output)


class Tally:
    """A hook that counts its calls, or adds up what `of` makes of their arguments. Executors add, the caller reads value."""

    def __init__(self, spark: SparkSession, of: Callable[..., float] | None = None) -> None:
        self.held, self.of = spark.sparkContext.accumulator(0), of

    def __call__(self, *args) -> None:
        self.held.add(1 if self.of is None else self.of(*args))

    @property
    def value(self):
        return self.held.value


class ObservedStage(Stage):
    """Calls hooks on rows as they pass; what a hook raises is printed and passed over.

    Hooks come with the stage, or from a subclass's observer_hooks(). They run on executors: what they change in the
    caller's own variables stays there, a Tally's counts reach the caller. Tasks that are run again count again.
    """

    def __init__(self, hooks: dict[str, Callable] | None = None, spec: dict | None = None) -> None:
        self.hooks = dict(hooks) if hooks is not None else self.observer_hooks()
        if unknown := set(self.hooks) - set(HOOKS):
            raise PlanError(f"unknown hooks {sorted(unknown)}")
        self.spec = spec

    def observer_hooks(self) -> dict[str, Callable]:
        return {}

    def transform(self, df: DataFrame) -> DataFrame:
        hooks, spec, seen = self.hooks, self.spec, "_observed"
        while seen in df.columns:
            seen += "_"
        test = F.lit(True) if spec is None else F.coalesce(predicates.compiled(spec, {f.name: f.dataType for f in df.schema}), F.lit(False))
        if not hooks:
            return df if spec is None else df.filter(test)

        def call(name, *args):
            if name in hooks:
                try:
                    hooks[name](*args)
                except Exception as e:  # noqa: BLE001  observers never break a read
                    print(f"observer {name}: {e!r}", file=sys.stderr)

        def run(batches):
            for batch in batches:
                passed = batch.column(batch.num_columns - 1)
                rows = batch.drop_columns([batch.schema.names[-1]])
                for i, r in enumerate(rows.to_pylist()):
                    call("on_begin_row", i)
                    for k, v in r.items():
                        call("on_put_field", k, v)
                    call("on_row_accepted" if passed[i].as_py() else "on_row_rejected", i)
                call("on_chunk_finished", batch.num_rows)
                yield rows.filter(passed)

        return df.withColumn(seen, test).mapInArrow(run, df.schema)


def merged_hooks(first: dict[str, Callable] | None, second: dict[str, Callable] | None) -> dict[str, Callable] | None:
    """Hooks of two observers: of one name, both are called in turn."""
    if not first or not second:
        return first or second

    def both(a: Callable, b: Callable) -> Callable:
        def call(*args):
            try:
                a(*args)
            finally:
                b(*args)

        return call

    return {k: both(first[k], second[k]) if k in first and k in second else first.get(k) or second[k] for k in {**first, **second}}
