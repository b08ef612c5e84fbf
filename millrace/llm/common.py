"""Helpers shared by the training-data operators: tables, durable intermediates, numbering."""

from __future__ import annotations

import ctypes
import math
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.shipping import shared_folder

#: Bytes of an Arrow batch, one longer row excepted.
BATCH_BYTES = 8 << 20
#: Whether Spark deletes a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a cell of number_within() holds on average.
CELL_ROWS = 8192

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application below the cluster's shared checkpoint folder; it goes with the application."""
    path = f"{shared_folder(spark)}/millrace-{spark.sparkContext.applicationId}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again: the lineage ends here and lost executors cost nothing.
    The shuffle files of the write go with it."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    held = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, held)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._durable_path = path
    return made


def forget(made: DataFrame) -> None:
    """Deletes the files of a durable() table that nothing reads any more."""
    path = made.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(made._durable_path)
    path.getFileSystem(made.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slim() -> None:
    """Gives memory that a Python worker has freed back to the system, as workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows and bytes: whole texts are long, and Python holds one batch at a time."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = str(spark.conf.get(key)).lower().removesuffix("b")
        if not (held.isdigit() and 0 < int(held) <= most):
            spark.conf.set(key, most)


def kept_rows(df: DataFrame, text_col: str, judge) -> DataFrame:
    """The rows whose texts judge(list of texts) finds good (an array of booleans), with all their columns, of any type."""
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(judge(batch.column(at).to_pylist())))

    # under plain names, as names may hold dots
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    kept = plain.mapInArrow(run, plain.schema).toDF(*df.columns)
    return kept.select(*(F.col("`" + f.name.replace("`", "``") + "`").alias(f.name, metadata=f.metadata or {}) for f in df.schema))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its letters' case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def crc_mod(col, modulus: int):
    """crc32 of a value as text, modulo modulus; null where the value is null."""
    return F.crc32(col.cast("string").cast("binary")) % modulus


def held_out(col, modulus: int, remainder: int = 1):
    """Whether the fold of an id is the held-out one; a null id is not."""
    return F.coalesce(crc_mod(col, modulus) == remainder, F.lit(False))


def number_within(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """df with a gapless number from 0 within each group, in a long column.

    A group may hold any share of the rows: it is dealt over cells by a hash of the order columns, rows are
    numbered within cells, and a running sum over the cells' counts adds where a cell begins. Groups must not be
    null; rows equal in all order columns get adjacent numbers in any order.
    """
    cells, rows = max(1, math.ceil(df.count() / CELL_ROWS)), fresh(df, "rows")
    cell, begin, within = (fresh(df, n) for n in ("cell", "begin", "within"))
    salted = df.withColumn(cell, F.pmod(F.xxhash64(*order), F.lit(cells)).cast("long"))
    running = F.sum(rows).over(Window.partitionBy(*groups).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0))
    begins = salted.groupBy(*groups, cell).agg(F.count(F.lit(1)).alias(rows)).withColumn(begin, running - F.col(rows)).drop(rows)
    numbered = salted.withColumn(within, F.row_number().over(Window.partitionBy(*groups, cell).orderBy(*order)).cast("long") - 1)
    return numbered.join(begins, [*groups, cell]).withColumn(name, F.col(begin) + F.col(within)).drop(cell, begin, within)


#: Keys that more than one row in so many bears are joined by broadcast; there are fewer than this of them.
HEAVY = 1000


def labelled(rows: DataFrame, labels: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of labels, which has each key once and in `rows` how many rows bear it. Rows of a key that
    more than one row in HEAVY bears stay where they are, the others meet their label by a shuffle."""
    heavy = labels.filter(F.col("rows") * HEAVY > total).drop("rows")
    others = labels.filter(F.col("rows") * HEAVY <= total).drop("rows")
    of_others = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(others, key)
    return rows.join(F.broadcast(heavy), key).unionByName(of_others)


def with_fields(df: DataFrame, columns: list[str], extra: list[tuple[str, T.DataType]]) -> T.StructType:
    """Output schema of a mapInArrow(): some columns of df as they are, and new ones."""
    kinds = {f.name: f.dataType for f in df.schema}
    return T.StructType([T.StructField(c, kinds[c]) for c in columns] + [T.StructField(n, t) for n, t in extra])
