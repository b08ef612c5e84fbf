"""Sources, adapters and pipelines: source | stage | stage, then a sink."""

from __future__ import annotations

import inspect
import warnings
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from copy import copy

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.errors import MillraceError
from millrace.functions.budget import StreamStats, parse_memory, resolve_engine, timed
from millrace.operators import schema as shaping
from millrace.operators.stages import MapRecords, ObservedStage, Stage, merged_hooks
from millrace.plans import predicate
from millrace.shipping import ship
from millrace.sources import formats

Reader = Callable[..., DataFrame]
_adapters: dict[str, Reader] = {}
_extensions: dict[str, str] = {}
PLAN = ("field_mapping", "drop_fields", "filter", "field_types", "dictionary_columns", "schema", "auto_dict", "strict_types", "observer", "column_order")


def register_adapter(name: str, adapter: Reader, extensions: tuple[str, ...] = ()) -> None:
    """adapter: (spark, path, **options) to a DataFrame of columns, or of records (_file, _pos, fields)."""
    if not isinstance(name, str) or not name:
        raise MillraceError("an adapter needs a name")
    if not callable(adapter):
        raise MillraceError("an adapter must be callable")
    for e in extensions:
        if not e.startswith(".") or len(e) < 2:
            raise MillraceError(f"{e!r} is no file extension")
    _adapters[name] = adapter
    _extensions.update({e.lower(): name for e in extensions})


def guess_format(path: str) -> str:
    name = str(path).rsplit("/", 1)[-1].lower()
    dot = name.rfind(".")
    if dot < 0 or name[dot:] not in _extensions:
        raise MillraceError(f"no adapter is known for {path!r}")
    return _extensions[name[dot:]]


def _text(parser) -> Reader:
    def read(spark: SparkSession, path: str, compressed: bool = False, **options) -> DataFrame:
        """compressed is for those who know; the files' first bytes tell by themselves."""
        return parser(formats.lines(spark, path), **options)

    read.takes_names = "names" in inspect.signature(parser).parameters
    return read


for _name, _parser, _ext in (("properties", formats.properties, (".properties",)), ("ini", formats.ini, (".ini",)), ("ldif", formats.ldif, (".ldif",)), ("kv", formats.key_values, (".kv",))):
    register_adapter(_name, _text(_parser), _ext)
register_adapter("xml", lambda spark, path, row_tag="row", **_: formats.xml_fields(spark, path, row_tag), (".xml",))
register_adapter("parquet", lambda spark, path, **_: spark.read.parquet(path), (".parquet",))
register_adapter("csv", lambda spark, path, header=True, sep=",", **_: spark.read.option("header", header).option("sep", sep).csv(path), (".csv",))
register_adapter("tsv", lambda spark, path, header=True, **_: spark.read.option("header", header).option("sep", "\t").csv(path), (".tsv",))
register_adapter("jsonl", lambda spark, path, **_: spark.read.json(path), (".jsonl",))


def source_fields(schema=None, field_mapping=None, field_types=None, filter=None, **_) -> list[str] | None:  # noqa: A002
    """Names in the file of all fields that a plan with a declared schema needs; None without one."""
    if not schema:
        return None
    back = {v: k for k, v in (field_mapping or {}).items()}
    return [back.get(n, n) for n in dict.fromkeys([*schema, *(field_types or {}), *predicate_fields(filter)])]


def shaped(df: DataFrame, field_mapping=None, drop_fields=None, filter=None, field_types=None, dictionary_columns=None, schema=None, auto_dict=False, strict_types=False, observer=None, column_order=None) -> DataFrame:  # noqa: A002
    """A reader's result under a plan: rename, drop, types, filter, then projection to the declared schema, or the columns
    of column_order first and the others as they come."""
    mapping, dropped, types = dict(field_mapping or {}), set(drop_fields or ()), dict(field_types or {})
    if {"_file", "_pos", "fields"} <= set(df.columns):
        used = source_fields(schema, mapping, types, filter)
        df = shaping.columns_of(df, used if used is not None else shaping.discover(df))
    df = shaping.rename(df, mapping)
    df = df.drop(*(c for c in df.columns if c in dropped))
    df = shaping.typed(df, types | {c: "dictionary" for c in dictionary_columns or () if c not in types}, strict=strict_types)
    if observer:
        df = ObservedStage(observer, predicate.to_spec(filter) if filter is not None else None).transform(df)
    elif filter is not None:
        df = predicate.filtered(df, filter)
    if schema:
        df = shaping.project(df, [c for c in schema if c not in dropped], types)
    elif column_order:
        df = shaping.reorder(df, list(column_order))
    return shaping.auto_dictionary(df) if auto_dict else df


def predicate_fields(spec) -> list[str]:
    """Names that a filter reads."""
    spec = predicate.to_spec(spec) if spec is not None else None
    if not isinstance(spec, dict):
        return []
    inner = [*spec.get("and", ()), *spec.get("or", ()), *([spec["not"]] if "not" in spec else [])]
    return [spec[k] for k in ("field", "field_a", "field_b", "not_field") if k in spec] + [n for s in inner for n in predicate_fields(s)]


def _checked(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(f"no such file: {path}")


class Source:
    """A file, or a folder of files, to read with plan options; | adds stages. The reader is asked once."""

    def __init__(self, spark: SparkSession, path: str, reader: Reader, batch_size: int = 1024, use_mmap: bool = True, **options) -> None:
        if isinstance(batch_size, bool) or not isinstance(batch_size, int) or batch_size < 1:
            raise ValueError("batch_size must be a positive integer")
        _checked(spark, path)
        ship(spark)
        self.spark, self.path, self.reader, self.batch_size = spark, str(path), reader, batch_size
        self.plan = {k: v for k, v in options.items() if k in PLAN}
        self.options = {k: v for k, v in options.items() if k not in PLAN and k not in ("prefault", "chunks", "memory", "threads")}
        self._df: DataFrame | None = None

    def with_plan(self, **overrides) -> Source:
        """The same file under a plan in which later options win and observers are called one after the other."""
        other = copy(self)
        other._df = None
        other.plan = self.plan | overrides
        if "observer" in overrides:
            other.plan["observer"] = merged_hooks(self.plan.get("observer"), overrides["observer"])
        return other

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            names = source_fields(**self.plan) if getattr(self.reader, "takes_names", False) else None
            self._df = shaped(self.reader(self.spark, self.path, **self.options, **({"names": names} if names is not None else {})), **self.plan)
        return self._df

    def cache(self) -> Source:
        """Keeps the result in the executors' memory and disks, for sources that many pipelines read."""
        self.df.persist()
        return self

    def __or__(self, stage) -> Pipeline:
        return Pipeline(self) | stage

    def __iter__(self) -> Iterator[dict]:
        return (r.asDict() for r in self.df.toLocalIterator(prefetchPartitions=True))

    def iter_record_batches(self, batch_size: int | None = None, memory: int | str | None = None, strict: bool = False, stats: StreamStats | None = None) -> Iterator[pa.RecordBatch]:
        return record_batches(self.df, batch_size or self.batch_size, memory, strict, stats)


class Adapter(Source):
    """Subclasses define read(spark, path, **options), which returns a DataFrame of columns or of records."""

    def __init__(self, spark: SparkSession, path: str, **options) -> None:
        super().__init__(spark, path, self._read, **options)

    def _read(self, spark: SparkSession, path: str, **options) -> DataFrame:
        made = self.read(spark, path, **options)
        if not isinstance(made, DataFrame):
            raise TypeError(f"read() must return a DataFrame, not {type(made).__name__}")
        return made

    def read(self, spark: SparkSession, path: str, **options) -> DataFrame:
        raise NotImplementedError("subclasses must define read()")


class FrameSource:
    """A DataFrame as a source."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.spark = df, df.sparkSession

    __or__ = Source.__or__
    __iter__ = Source.__iter__


class Pipeline:
    """A source and its stages, applied strictly in order. Nothing runs before a sink asks."""

    def __init__(self, source, stages: tuple = ()) -> None:
        self.source, self.stages = source, stages
        self._df: DataFrame | None = None

    def __or__(self, stage) -> Pipeline:
        if not isinstance(stage, Stage) and not hasattr(stage, "transform") and not hasattr(stage, "apply") and not callable(stage):
            raise TypeError(f"{stage!r} is no stage")
        return Pipeline(self.source, (*self.stages, stage))

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            df = self.source.df
            for s in self.stages:
                df = s.transform(df) if hasattr(s, "transform") else MapRecords(s.apply).transform(df) if hasattr(s, "apply") else s(df)
            self._df = df
        return self._df

    def __iter__(self) -> Iterator[dict]:
        return (r.asDict() for r in self.df.toLocalIterator(prefetchPartitions=True))

    def iter_record_batches(self, batch_size: int = 1024, memory: int | str | None = None, strict: bool = False, stats: StreamStats | None = None) -> Iterator[pa.RecordBatch]:
        return record_batches(self.df, batch_size, memory, strict, stats)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one row of Arrow's own bytes."""
    for batch in batches:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema) as writer:
            writer.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["arrow"])


def _as_done(df: DataFrame, threads: int) -> Iterator:
    """Rows of whole partitions, in the order in which these are done; no more than `threads` are on their way."""
    rdd = df.rdd
    waiting = list(range(rdd.getNumPartitions()))[::-1]
    with ThreadPoolExecutor(threads) as pool:
        one = lambda p: rdd.context.runJob(rdd, list, [p])
        running = {pool.submit(one, waiting.pop()) for _ in range(min(threads, len(waiting)))}
        while running:
            done, running = wait(running, return_when=FIRST_COMPLETED)
            for f in done:
                if waiting:
                    running.add(pool.submit(one, waiting.pop()))
                yield from f.result()


def _fitting(batch: pa.RecordBatch, budget: int) -> Iterator[pa.RecordBatch]:
    """A batch in halves until each is within the budget or one row."""
    if batch.num_rows <= 1 or batch.nbytes <= budget:
        yield batch
        return
    half = batch.num_rows // 2
    yield from _fitting(batch.slice(0, half), budget)
    yield from _fitting(batch.slice(half), budget)


def record_batches(df: DataFrame, batch_size: int = 1024, memory: int | str | None = None, strict: bool = False, stats: StreamStats | None = None, should_stop: Callable[[], bool] | None = None, ordered: bool = True, threads: int = 4) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the rows in order (or of partitions as they are done, `threads` of them at a time), of batch_size rows, the last one fewer; with a memory budget smaller ones, so
    that each is within it unless a single row is beyond. One partition is computed ahead at most; should_stop is asked
    between batches, and nothing more is computed once it says so."""
    if isinstance(batch_size, bool) or not isinstance(batch_size, int) or batch_size < 1:
        raise ValueError("batch_size must be a positive integer")
    return _record_batches(df, batch_size, parse_memory(memory) if memory is not None else None, strict, stats if stats is not None else StreamStats(), should_stop, None if ordered else max(1, threads))


def _record_batches(df: DataFrame, batch_size: int, budget: int | None, strict: bool, stats: StreamStats, should_stop: Callable[[], bool] | None, threads: int | None) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)
    ship(df.sparkSession)
    packed = df.mapInArrow(_packed, "arrow binary")
    rows = packed.toLocalIterator(prefetchPartitions=True) if threads is None else _as_done(packed, threads)
    held: list[pa.RecordBatch] = []

    def whole(n: int) -> pa.RecordBatch:
        """The first n rows of those held; the others stay."""
        table = pa.Table.from_batches(held)
        first = table.slice(0, n).combine_chunks().to_batches()
        held[:] = table.slice(n).to_batches()
        return first[0]

    def out(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        waiting = sum(b.nbytes for b in held)
        for part in [batch] if budget is None else _fitting(batch, budget):
            stats.add(part, budget, strict, waiting)
            yield part

    while True:
        with timed("parse"):
            row = next(rows, None)
        if row is None:
            break
        with timed("export"):
            with pa.ipc.open_stream(row["arrow"]) as stream:
                held.extend(b.cast(schema) if b.schema != schema else b for b in stream)
        while sum(b.num_rows for b in held) >= batch_size:
            for part in out(whole(batch_size)):
                if should_stop is not None and should_stop():
                    return
                yield part
    if n := sum(b.num_rows for b in held):
        yield from out(whole(n))


def _source(spark: SparkSession, path: str, format: str | None, adapter: Reader | None, options: dict) -> Source:  # noqa: A002
    name = format or (None if adapter else guess_format(path))
    if adapter is None and name not in _adapters:
        raise MillraceError(f"unknown format {name!r}")
    return Source(spark, path, adapter or _adapters[name], **options)


def read(spark: SparkSession, path: str, format: str | None = None, adapter: Reader | None = None, **options) -> DataFrame:  # noqa: A002
    return _source(spark, path, format, adapter, options).df


def read_par(spark: SparkSession, path: str, chunks: int = 4, **options) -> DataFrame:
    """Spark cuts files into tasks by itself; more partitions than asked for are merged without a shuffle."""
    return read(spark, path, **options).coalesce(max(1, chunks))


def read_stream(spark: SparkSession, path: str, memory: int | str = "64MiB", **options) -> DataFrame:
    parse_memory(memory)
    return read(spark, path, **options)


def read_batches(spark: SparkSession, path: str, batch_size: int = 1024, memory: int | str | None = None, **options) -> Iterator[pa.RecordBatch]:
    source = _source(spark, path, options.pop("format", None), options.pop("adapter", None), options)
    if getattr(source.reader, "whole_files", False):
        warnings.warn(f"{path} is read as a whole before the first batch", RuntimeWarning, stacklevel=2)
    return record_batches(source.df, batch_size, memory)


def discover_schema(spark: SparkSession, path: str, **options) -> list[str]:
    return read(spark, path, **options).columns


def engine_for(spark: SparkSession, path: str, **how) -> str:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return resolve_engine(size, **how)
