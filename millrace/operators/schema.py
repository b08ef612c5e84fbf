"""Shaping of records: discovery, projection, unification of parts, dictionary candidates, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import MergeError, PlanError
from millrace.functions.casts import converted
from millrace.functions.types import parse_type

LEAST_ROWS, LEAST_VALUES = 512, 16


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def discover(records: DataFrame, fields: str = "fields", order: tuple[str, ...] = ("_file", "_pos")) -> list[str]:
    """Names of all fields, by first appearance. Only the distinct names reach the driver."""
    each = records.select(*order, F.posexplode(F.map_keys(fields)).alias("_place", "_name"))
    first = each.groupBy("_name").agg(F.min(F.struct(*order, "_place")).alias("_first"))
    return [r["_name"] for r in first.orderBy("_first").collect()]


def located(records: DataFrame, fields: str = "fields") -> DataFrame:
    """How many rows, fields and distinct names there are; no value is read."""
    names = F.map_keys(fields)
    sums = records.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.size(names)), F.lit(0)).cast("long").alias("n_fields"))
    distinct = records.select(F.explode(names).alias("name")).agg(F.countDistinct("name").alias("n_names"))
    parts = sums.withColumn("n_names", F.lit(0).cast("long")).unionByName(distinct.select(F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("n_fields"), "n_names"))
    return parts.agg(*(F.max(c).alias(c) for c in ("n_rows", "n_fields", "n_names")))


def columns_of(records: DataFrame, names: list[str], fields: str = "fields", keep: tuple[str, ...] = ()) -> DataFrame:
    """Records as columns; a field that a record lacks is null."""
    return records.select(*(F.col(c) for c in keep), *(F.col(fields)[n].alias(n) for n in names))


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """All renames at once. Of columns that end up with one name the last stands, at the place of the first."""
    names = [mapping.get(c, c) for c in df.columns]
    if len(set(names)) == len(names):
        return df.toDF(*names)
    last = {n: i for i, n in enumerate(names)}
    inner = df.toDF(*(f"_{i}" for i in range(len(names))))
    return inner.select(*(F.col(f"_{last[n]}").alias(n) for n in dict.fromkeys(names)))


def project(df: DataFrame, order: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Exactly the listed columns in that order; those that df lacks are null, of their declared type or else strings."""
    declared = {k: parse_type(v).spark for k, v in (types or {}).items()}
    return df.select(*(F.col(quoted(c)) if c in df.columns else F.lit(None).cast(declared.get(c, T.StringType())).alias(c) for c in dict.fromkeys(order)))


def reorder(df: DataFrame, first: list[str]) -> DataFrame:
    """The listed columns that df has, then its others as they come."""
    head = [c for c in first if c in df.columns]
    return df.select(*(quoted(c) for c in [*head, *(c for c in df.columns if c not in head)]))


def typed(df: DataFrame, types: dict[str, str], strict: bool = False) -> DataFrame:
    """Columns as their declared types; names that df lacks are passed over."""
    out = []
    for f in df.schema:
        c = F.col(quoted(f.name))
        if f.name in types:
            to = parse_type(types[f.name])
            c = converted(c, f.dataType, to, f.name, strict).alias(f.name, metadata=to.metadata)
        out.append(c)
    return df.select(*out)


def unified_type(name: str, a: T.DataType, b: T.DataType) -> T.DataType:
    """int64 with float64 is float64; else both must be the same."""
    if a == b:
        return a
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    raise MergeError(f"column {name!r} is {a.simpleString()} in one part and {b.simpleString()} in another")


def union_ragged(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts; columns by first appearance, null where a part lacks them. Types are never mixed by guess."""
    if not parts:
        raise PlanError("there is nothing to unite")
    types: dict[str, T.DataType] = {}
    marks: dict[str, dict] = {}
    for p in parts:
        for f in p.schema:
            types[f.name] = unified_type(f.name, types[f.name], f.dataType) if f.name in types else f.dataType
            marks[f.name] = marks.get(f.name) or f.metadata or {}
    shaped = [p.select(*(F.col(quoted(n)).cast(t).alias(n, metadata=marks[n]) if n in p.columns else F.lit(None).cast(t).alias(n, metadata=marks[n]) for n, t in types.items())) for p in parts]
    out = shaped[0]
    for p in shaped[1:]:
        out = out.unionByName(p)
    return out


def checked_dictionary_options(threshold: float, most: int) -> None:
    if not 0.0 <= threshold <= 1.0:
        raise PlanError(f"auto_dict_threshold must be between 0 and 1, not {threshold}")
    if most < 1:
        raise PlanError("auto_dict_max_size must be 1 or more")


def dictionary_candidates(df: DataFrame, threshold: float = 0.05, most: int = 256) -> DataFrame:
    """name, n_rows, n_distinct and is_candidate of every string column, from one exact pass."""
    checked_dictionary_options(threshold, most)
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df.sparkSession.createDataFrame([], "name string, n_rows long, n_distinct long, is_candidate boolean")
    sums = df.agg(F.count(F.lit(1)).alias("n_rows"), *(F.countDistinct(quoted(n)).alias(f"d{i}") for i, n in enumerate(names)))
    each = sums.select("n_rows", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"d{i}").alias("n_distinct")) for i, n in enumerate(names)))).alias("x"))
    limit = F.least(F.greatest(F.lit(float(LEAST_VALUES)), F.lit(threshold) * F.col("n_rows")), F.lit(float(most)))
    return each.select("x.name", "n_rows", "x.n_distinct", ((F.col("n_rows") >= LEAST_ROWS) & (F.col("x.n_distinct") <= limit)).alias("is_candidate"))


def marked(df: DataFrame, names: list[str]) -> DataFrame:
    """Marks columns as dictionaries in their metadata; Parquet writes such pages by itself."""
    return df.select(*(F.col(quoted(c)).alias(c, metadata={"encoding": "dictionary"}) if c in names else F.col(quoted(c)) for c in df.columns))


def auto_dictionary(df: DataFrame, threshold: float = 0.05, most: int = 256) -> DataFrame:
    return marked(df, [r["name"] for r in dictionary_candidates(df, threshold, most).collect() if r["is_candidate"]])
