"""Near copies by the exact Jaccard similarity of word shingles.

Candidates come from two sides. SimHash components of the same shingles (simhash.py) hold copies and the nearest of near
copies, but most pairs at LEAST lie further apart than its index can guarantee to find. So MinHash adds the least values
of a text's shingles under BANDS x ROWS orders, band by band: a pair at LEAST meets in no band with a chance of
(1 - 0.8^4)^32, below 1 in 10^7, and a more similar pair more rarely. Every candidate is verified with both texts' whole
sets of shingles. The list of a band, or of a component, is not paired off at once: all its texts are held against the
one that most others meet, and of lists that this does not join any two chunks are compared in a task of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable, labelled, small_batches
from millrace.llm.simhash import SEED, components, connected, majority, shingle_hashes, units

#: Words of a shingle; the least similarity of a link, as a fraction.
SHINGLE_WORDS, LEAST = 5, (4, 5)
BANDS, ROWS = 32, 4
#: Shingles that one step of a signature holds; texts that one task compares in place.
STRIDE, LIST_ROWS = 2048, 1024
_ORDERS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, "u8") | np.uint64(1)


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted set of 64-bit hashes of a whole text's shingles; a shorter text is one shingle, one without words none."""
    return np.unique(shingle_hashes(text, words))


def bands(of: np.ndarray) -> np.ndarray:
    """A key for each band of a set's signature; an empty set has none."""
    if not len(of):
        return np.zeros(0, "u8")
    least = np.min([(of[i : i + STRIDE, None] * _ORDERS[None, :]).min(0) for i in range(0, len(of), STRIDE)], axis=0).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
    for row in range(ROWS):
        key = (key ^ least[:, row]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is LEAST or more."""
    if min(len(a), len(b)) * LEAST[1] < max(len(a), len(b)) * LEAST[0]:
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared * LEAST[1] >= (len(both) - shared) * LEAST[0]


def signatures(df: DataFrame) -> DataFrame:
    """key, rank, seal (128 bits of the set of shingles), fp (SimHash) and bands of rows with key, rank and text."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            hashes = [shingle_hashes(t, SHINGLE_WORDS) for t in batch.column(2).to_pylist()]
            sets = [np.unique(h) for h in hashes]
            seals = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            prints = pa.array(np.array([majority(h) for h in hashes], "u8").view("i8"))
            keys = pa.array([bands(s).view("i8") for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), seals, prints, keys], names=["key", "rank", "seal", "fp", "bands"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select("key", "rank", "text").mapInArrow(run, f"key {kinds['key']}, rank {kinds['rank']}, seal binary, fp long, bands array<bigint>")


def _sets(df: DataFrame, members: DataFrame) -> DataFrame:
    """node and its sorted set of shingles, as bytes, from members' (node, key)."""

    def run(batches):
        for batch in batches:
            made = pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["node", "set"])

    texts = df.select("key", "text").join(members, "key").dropDuplicates(["key"])
    return texts.select("node", "text").mapInArrow(run, "node long, set binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            fit = pa.array([similar(np.frombuffer(x, "u8"), np.frombuffer(y, "u8")) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(fit)

    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def local_links(nodes: list[int], roots: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect exactly the texts of one list which chains of links connect, those of one root being joined
    before. What two sets share is counted over an inverted index of the list, so pairs take no memory."""
    n, sizes = len(nodes), np.array([len(x) for x in sets])
    first: dict[int, int] = {}
    group = np.array([first.setdefault(r, i) for i, r in enumerate(roots)])
    owner = np.repeat(np.arange(n), sizes)
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    lists = owner[np.argsort(number, kind="stable")]
    ends = np.cumsum(np.bincount(number))
    begins, at = np.r_[0, ends[:-1]], np.r_[0, np.cumsum(sizes)]
    left, out = len(first), []
    for i in range(n):
        if left == 1:
            break
        shared = np.bincount(np.concatenate([lists[begins[k] : ends[k]] for k in number[at[i] : at[i + 1]]]), minlength=n)
        fit = shared * LEAST[1] >= (sizes + sizes[i] - shared) * LEAST[0]
        for g in np.unique(group[fit]).tolist():
            if g != group[i]:
                out.append((nodes[i], nodes[int(np.flatnonzero(fit & (group == g))[0])]))
                group[group == g] = group[i]
                left -= 1
    return out


def _compared(apart: DataFrame, sets: DataFrame, list_rows: int) -> DataFrame:
    """Links (a, b) within each list of rows with band, node and root."""

    def run(batches):
        unit, nodes, roots, held = None, [], [], []

        def closed():
            links = local_links(nodes, roots, held) if len(set(roots)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for of, node, root, made in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if of != unit:
                    yield closed()
                    unit, nodes, roots, held = of, [], [], []
                nodes.append(node)
                roots.append(root)
                held.append(np.frombuffer(made, "u8"))
        yield closed()

    met = units(apart, list_rows, "band", "node").join(sets, "node").select("unit", "node", "root", "set")
    return met.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def heads(df: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """From rows with key (not null, alike only for rows alike), rank and text: of each group of near copies, which
    chains of links join, the key of the row with the least rank. Texts without words are copies of each other. A null
    text has no words; repeated rows and ties of rank fall to the least key; an empty table gives an empty one."""
    nodes = signatures(df).groupBy("seal").agg(F.min(F.struct("rank", "key")).alias("first"), F.min("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = durable(nodes.select(F.monotonically_increasing_id().alias("node"), "first", "fp", "bands"), "signatures")
    near = connected(nodes.select(F.col("node").alias("id"), "fp")).select(F.col("id").alias("node"), F.xxhash64(F.lit("simhash"), "component").alias("band"))
    every = nodes.select("node", F.explode("bands").alias("band")).union(near)
    sizes = durable(every.groupBy("band").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1), "lists")
    total = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    listed = durable(labelled(every, sizes.withColumn("n", F.col("rows")), "band", total), "bands")
    degree = listed.groupBy("node").agg(F.sum("n").alias("degree"))
    sets = durable(_sets(df, nodes.select("node", F.col("first.key").alias("key")).join(degree.select("node"), "node")), "sets")
    hubs = listed.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", "node")).alias("hub"), F.count(F.lit(1)).alias("rows"))
    hubs = durable(hubs.select("band", F.col("hub.node").alias("hub"), "rows"), "hubs")
    stars = labelled(listed.select("node", "band"), hubs, "band", total).filter(F.col("node") != F.col("hub"))
    stars = durable(stars.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    links = durable(_verified(stars, sets), "links")
    # Where a list is not one group yet, it is compared as a whole.
    joined = listed.filter(F.col("n") > 2).join(components(links), "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    joined = durable(joined, "joined")
    spans = joined.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("rows"))
    apart = labelled(joined, durable(spans.filter(F.col("low") < F.col("high")).select("band", "rows"), "apart"), "band", total)
    roots = components(links.union(_compared(apart.select("band", "node", "root"), sets, list_rows)))
    whole = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return whole.select("first.key")
