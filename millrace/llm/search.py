"""Exact top-k inner-product search over integer vectors.

Queries are packed into blocks and candidates into tiles, and these are dealt into groups. A cell of the grid of groups
holds its query blocks and lets its tiles stream past them: every pair is one matrix product, of which only each query's
best k are kept and merged with those of the tiles before. Lists of neighbouring groups are then merged, level by level.
So a tile is sent once for each group of query blocks, and a block once for each group of tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import durable, number_within, table

#: Rows of a block of queries, of a tile of candidates, and tiles whose lists one merge takes in.
QUERY_ROWS, TILE_ROWS, FAN_IN = 1024, 4096, 16
#: Factor before rounding down.
SCALE = 64
#: Query blocks and tiles in a cell of the grid at most.
CELL_BLOCKS, CELL_TILES = 64, 64
TILE_SCHEMA = "tile long, dims int, ids binary, cells binary, kind string"
LONGEST = 2**63 - 1


def integers(vectors: list, scale: int) -> np.ndarray:
    """floor(scale * x) as int64 where that is exact everywhere, else as Python integers."""
    out = np.floor(np.asarray(vectors, "f8") * scale)
    return out.astype("i8") if not out.size or np.abs(out).max() < 2**53 else np.array([[int(x) for x in row] for row in out], object)


def _tiles(rows: int, scale: int):
    """Packs (id, vector) rows into tiles of one vector length each."""

    def packed(seq: int, dims: int, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        cells = integers(vectors, scale)
        kind = "object" if cells.dtype == object else next(k for k in ("<i2", "<i4", "<i8") if np.abs(cells).max(initial=0) <= np.iinfo(k).max)
        body = repr(cells.tolist()).encode() if kind == "object" else cells.astype(kind).tobytes()
        columns = {"tile": (seq, pa.int64()), "dims": (dims, pa.int32()), "ids": (ids.astype("<i8").tobytes(), pa.binary()), "cells": (body, pa.binary()), "kind": (kind, pa.string())}
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in columns.values()], names=list(columns))

    def run(batches):
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 32
        open_tiles: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1)
            lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dims)
                held = open_tiles.setdefault(dims, [])
                held.append((ids[at], vectors.take(pa.array(at)).flatten().to_numpy().reshape(-1, dims)))
                if sum(len(i) for i, _ in held) >= rows:
                    all_ids, cells = (np.concatenate(x) for x in zip(*held, strict=True))
                    full = len(all_ids) // rows * rows
                    for i in range(0, full, rows):
                        yield packed(seq, dims, all_ids[i : i + rows], cells[i : i + rows])
                        seq += 1
                    held[:] = [(all_ids[full:], cells[full:])]
        for dims, held in open_tiles.items():
            if held and sum(len(i) for i, _ in held):
                yield packed(seq, dims, *(np.concatenate(x) for x in zip(*held, strict=True)))
                seq += 1

    return run


def _unpacked(cells: bytes, kind: str, dims: int) -> np.ndarray:
    import ast

    return np.array(ast.literal_eval(cells.decode()), object) if kind == "object" else np.frombuffer(cells, kind).reshape(-1, dims)


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All inner products, exactly; those beyond 64 bits become the nearest 64-bit integer."""
    if queries.dtype != object and candidates.dtype != object:
        most = int(np.abs(queries.astype("i8")).max(initial=0)) * int(np.abs(candidates.astype("i8")).max(initial=0)) * max(1, queries.shape[1])
        if most < 2**53:
            return (queries.astype("f8") @ candidates.astype("f8").T).astype("i8")
        if most < 2**63:
            return queries.astype("i8") @ candidates.astype("i8").T
    return np.clip(queries.astype(object) @ candidates.astype(object).T, -LONGEST - 1, LONGEST).astype("i8")


def best(scores: np.ndarray, ids: np.ndarray, barred: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's k highest scores, ties to the smaller id; barred places take no part."""
    n = scores.shape[1]
    if n > k:
        held = np.where(barred, -LONGEST - 1, scores)
        floor = np.partition(held, n - k, axis=1)[:, n - k]
        rows, cols = np.nonzero((scores >= floor[:, None]) & ~barred)
    else:
        rows, cols = np.nonzero(~barred)
    order = np.lexsort((ids[cols], ~scores[rows, cols], rows))  # ~x falls as x rises, and can't overflow
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k]


def _cell(k: int):
    """Each query's best k of the tiles of one cell."""

    def run(asked: pa.Table, tiles: pa.Table) -> pa.Table:
        made: list[list[np.ndarray]] = [[np.zeros(0, "i8")] for _ in range(4)]
        group = tiles.column("group")[0].as_py() if tiles.num_rows else 0
        held = tiles.select(["dims", "ids", "cells", "kind"]).to_pylist() if asked.num_rows else []
        for q in asked.select(["dims", "ids", "cells", "kind"]).to_pylist():
            query_ids, queries = np.frombuffer(q["ids"], "<i8"), _unpacked(q["cells"], q["kind"], q["dims"])
            row, vec, score = (np.zeros(0, "i8") for _ in range(3))
            for t in held:
                if t["dims"] != q["dims"]:
                    continue
                ids = np.frombuffer(t["ids"], "<i8")
                scores = products(queries, _unpacked(t["cells"], t["kind"], t["dims"]))
                rows, cols = best(scores, ids, query_ids[:, None] == ids[None, :], k)
                row, vec, score = np.r_[row, rows], np.r_[vec, ids[cols]], np.r_[score, scores[rows, cols]]
                order = np.lexsort((vec, ~score, row))
                row, vec, score = row[order], vec[order], score[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, vec, score = row[kept], vec[kept], score[kept]
            for into, values in zip(made, (query_ids[row], np.full(len(row), group), vec, score), strict=True):
                into.append(values)
        return pa.table({n: pa.array(np.concatenate(x), pa.int64()) for n, x in zip(("query_id", "group", "vec_id", "score"), made, strict=True)})

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k highest inner products with rows of another id.

    Components are floor(scale * x). Rows whose id or vector is null, whose vector is empty or holds a null or
    non-finite component take no part; vectors of different lengths aren't compared. Ties go to the smaller id. A
    repeated candidate row counts each time; of query rows with one id, the least vector asks. Fewer than k candidates
    are all returned, and a query with none has no row. Scores beyond 64 bits are the nearest 64-bit integer. Empty
    tables give an empty one; other columns are not looked at.
    """
    spark = candidates.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = F.col("vector").isNotNull() & F.col("id").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = pick(queries).filter(usable).groupBy("id").agg(F.min("vector").alias("vector"))
    blocks = durable(asked.mapInArrow(_tiles(QUERY_ROWS, scale), TILE_SCHEMA), "query-blocks")
    tiles = durable(pick(candidates).filter(usable).mapInArrow(_tiles(TILE_ROWS, scale), TILE_SCHEMA), "candidate-tiles")
    n_blocks, n_tiles = blocks.count(), tiles.count()
    if not n_blocks or not n_tiles:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cores = spark.sparkContext.defaultParallelism
    block_groups, tile_groups = -(-n_blocks // CELL_BLOCKS), -(-n_tiles // max(1, min(CELL_TILES, n_tiles // (4 * cores))))
    numbered = lambda df, name: df.join(number_within(df.select("tile", F.lit(0).alias("one")), ["one"], ["tile"], name).select("tile", name), "tile")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = numbered(blocks, "number").withColumn("mine", F.col("number") % block_groups).withColumn("other", every(tile_groups)).withColumn("cell", F.col("mine") * tile_groups + F.col("other"))
    given = numbered(tiles, "number").withColumn("group", F.col("number") % tile_groups).withColumn("other", every(block_groups)).withColumn("cell", F.col("other") * tile_groups + F.col("group"))
    columns = ["cell", "dims", "ids", "cells", "kind"]
    dealt = asked.select(*columns).repartition(min(block_groups * tile_groups, 100_000), "cell").groupBy("cell").cogroup(given.select(*columns, "group").groupBy("cell"))
    lists = dealt.applyInArrow(_cell(k), "query_id long, group long, vec_id long, score long")
    groups = tile_groups
    while True:
        groups = -(-groups // FAN_IN)
        merged = Window.partitionBy("query_id", "group").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("group", F.floor(F.col("group") / FAN_IN).cast("long")).withColumn("rank", F.row_number().over(merged)).filter(F.col("rank") <= k)
        if groups == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")


def op10_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.filter(F.col("vec_id") % 20 == 0), vectors, k=20)


ORACLES = {
    "op10_exact_top_k": """
WITH usable AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
}
