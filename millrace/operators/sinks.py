"""Sinks of pipelines, sources and DataFrames."""

from __future__ import annotations

import csv
import inspect
import warnings
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from millrace.errors import MergeError, unwrapped
from millrace.plans.pipeline import record_batches


def frame(source) -> DataFrame:
    return source if isinstance(source, DataFrame) else source.df


def _run(action):
    try:
        return action()
    except Exception as e:
        inner = unwrapped(e)
        if inner is e:
            raise
        raise inner from e


def to_arrow(source) -> pa.Table:
    return _run(lambda: frame(source).toArrow())


def to_pandas(source, dtype_backend: str = "pyarrow", chunksize: int | None = None, memory=None):
    """One pandas DataFrame. With chunksize or memory it is put together from batches of that size, so that the driver
    holds Arrow data of one batch at a time beside it."""
    if dtype_backend not in ("pyarrow", "numpy"):
        raise ValueError(f"dtype_backend must be pyarrow or numpy, not {dtype_backend!r}")
    import pandas as pd

    how = {"types_mapper": pd.ArrowDtype} if dtype_backend == "pyarrow" else {}
    if chunksize is not None or memory is not None:
        parts = _run(lambda: [pa.Table.from_batches([b]).to_pandas(**how) for b in record_batches(frame(source), chunksize or 1024, memory)])
        if parts:
            return pd.concat(parts, ignore_index=True)
    return to_arrow(source).to_pandas(**how)


def to_polars(source):
    try:
        import polars
    except ImportError:
        raise ImportError("to_polars needs the optional package polars") from None
    return polars.from_arrow(to_arrow(source))


def to_parquet(source, path: str, single_file: bool = False, memory=None, row_group_size: int | None = None, **options) -> None:
    """A folder of Parquet files that the cluster writes in parallel. With single_file, or a memory budget, one file that
    the driver writes batch by batch."""
    df = frame(source)
    if not single_file and memory is None:
        _run(lambda: df.write.mode("overwrite").options(**options).parquet(path))
        return
    allowed = {k: v for k, v in options.items() if k in inspect.signature(pq.ParquetWriter.__init__).parameters}
    from pyspark.sql.pandas.types import to_arrow_schema

    with pq.ParquetWriter(path, to_arrow_schema(df.schema), **allowed) as writer:
        for batch in record_batches(df, row_group_size or 65536, memory):
            writer.write_batch(batch)


def to_csv(source, path: str, encoding: str = "utf-8", delimiter: str = ",", fieldnames: list[str] | None = None, single_file: bool = True) -> None:
    """One file with a header; nothing at all for no rows. With single_file=False, a folder that the cluster writes."""
    if not single_file:
        frame(source).write.mode("overwrite").option("header", True).option("sep", delimiter).csv(path)
        return
    rows: Iterator[dict] = (r.asDict() for r in frame(source).toLocalIterator(prefetchPartitions=True)) if isinstance(source, DataFrame) else iter(source)
    names, told = fieldnames, set()
    with open(path, "w", encoding=encoding, newline="") as f:
        writer = None
        for row in rows:
            if writer is None:
                names = names or list(row)
                writer = csv.DictWriter(f, names, delimiter=delimiter, extrasaction="ignore")
                writer.writeheader()
            if new := set(row) - set(names) - told:
                told |= new
                warnings.warn(f"fields {sorted(new)} are not in the header and are left out", UserWarning, stacklevel=2)
            writer.writerow(row)


def collect(source) -> list[dict]:
    return _run(lambda: [r.asDict() for r in frame(source).collect()])


def gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    """One table of Arrow batches whose schemas fit together: columns by first appearance, null where a batch lacks them;
    whole numbers with fractions are fractions, dictionaries with texts are texts. Other mixtures are refused."""
    tables = [pa.Table.from_batches([b]) for b in batches]
    kinds: dict[str, pa.DataType] = {}
    for t in tables:
        for f in t.schema:
            held = kinds.setdefault(f.name, f.type)
            pair = {held, f.type}
            if len(pair) == 1:
                continue
            if pair == {pa.int64(), pa.float64()}:
                kinds[f.name] = pa.float64()
            elif {k.value_type if pa.types.is_dictionary(k) else k for k in pair} == {pa.string()}:
                kinds[f.name] = pa.string()
            else:
                raise MergeError(f"column {f.name!r} is {held} in one batch and {f.type} in another")
    schema = pa.schema(kinds.items())
    parts = [pa.table([t.column(n).cast(k) if n in t.column_names else pa.nulls(t.num_rows, k) for n, k in kinds.items()], schema) for t in tables]
    return pa.concat_tables(parts) if parts else schema.empty_table()


def discard(source) -> None:
    """Runs everything and keeps nothing."""
    _run(lambda: frame(source).write.format("noop").mode("overwrite").save())
