"""Near-duplicates by SimHash, over a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most `bits` bits agree in at least 8 - bits of their 8 bytes: that is the
guaranteed count. A posting list of one byte at one place would hold a 256th of all fingerprints, whose pairs grow with
the square of the corpus; so a posting names several places at once, one fewer than the guaranteed count, and the bytes
there. The places are chosen such that any set of the guaranteed size holds one of the postings' sets (for four bits 20
sets of three places do, of 56): each pair that can link meets in a list. In a list the shared positional bytes of each
pair are tallied, pairs below the guaranteed count fall, and what is left is verified bit by bit. A list of more than
LIST_ROWS fingerprints is dealt into chunks, and each two chunks are compared in a task of their own.
"""

from __future__ import annotations

from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable, forget, labelled, small_batches, table

#: Words of a shingle, seed of its hash, most differing bits of a link.
SHINGLE_WORDS, SEED, LINK_BITS = 4, 42, 4
#: Rows of a posting list that one task compares in place; of longer ones, any two chunks of half as many.
LIST_ROWS = 4096
#: Long lists whose numbers of chunks are broadcast at most; more of them meet the postings by a shuffle.
BROADCAST_ROWS = 500_000
#: Fingerprints times columns that one step of a comparison holds.
STRIP = 1 << 20


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of a whole text's shingles in order, repeats included; a shorter text is one shingle, one without words none."""
    found = (text or "").encode().lower().split()  # exactly the words [^\\x20\\x09-\\x0D]+, A-Z lower-cased
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    ends = list(accumulate([len(found[0]), *(len(w) + 1 for w in found[1:])]))
    starts = [0, *(e + 1 for e in ends[: max(0, len(found) - words)])]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(words, len(found)) - 1 :], strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have set."""
    # unpackbits gives each byte's bits from the highest on; the byte order is turned so that column k is bit 63 - k.
    sums = sum((np.unpackbits(hashes[i : i + 65536].byteswap().view("u1").reshape(-1, 8), axis=1).sum(0, dtype="i8") for i in range(0, len(hashes), 65536)), np.zeros(64, "i8"))
    return int.from_bytes(np.packbits(2 * sums > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a whole text's shingles, repeats included."""
    return majority(shingle_hashes(text, words))


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """id and fp, the fingerprint as a signed long."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            made = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, fp long")


@cache
def place_sets(bits: int) -> tuple[tuple[int, ...], ...]:
    """Sets of byte places, one place fewer than are guaranteed to agree (or one), so that every set of the guaranteed
    size holds one of them. For four bits: all threes within one of three groups of places, or with two in a group and
    one in the next; else all sets that do without the last place."""
    sure = 8 - bits
    if sure == 4:
        group = (0, 0, 0, 1, 1, 1, 2, 2)
        inside = lambda c: len({group[p] for p in c}) == 1
        beside = lambda c: any(sorted(group[p] for p in c) == sorted((g, g, (g + 1) % 3)) for g in range(3))
        return tuple(c for c in combinations(range(8), 3) if inside(c) or beside(c))
    return tuple(combinations(range(8 if sure == 1 else 7), max(1, sure - 1)))


def postings(distinct: DataFrame, bits: int) -> DataFrame:
    """key and fp: every fingerprint under each of the sets of byte places."""
    masks = np.array([sum(0xFF << (8 * p) for p in chosen) for chosen in place_sets(bits)], "u8")

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view("u8")
            # The set's number is mixed into the kept bytes by an odd factor, so that a key names both, but for chance
            # meetings, which verification sorts out.
            keys = ((fps[:, None] & masks[None, :]) ^ (np.arange(1, len(masks) + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))[None, :]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(keys.view("i8")), pa.array(np.repeat(fps, len(masks)).view("i8"))], names=["key", "fp"])

    return distinct.mapInArrow(run, "key long, fp long")


def units(listed: DataFrame, list_rows: int, key: str, item: str) -> DataFrame:
    """listed with a column unit: each list, of one key, as one unit, or for a list of more than list_rows any two of its
    chunks, to which items are dealt by their hash. Rows of long lists come once for each unit that they are in."""
    half = max(1, list_rows // 2)
    long = durable(listed.groupBy(key).count().filter(F.col("count") > list_rows).select(key, F.ceil(F.col("count") / half).cast("int").alias("chunks")), "long-lists")
    found = listed.join(F.broadcast(long) if long.count() <= BROADCAST_ROWS else long, key, "left")
    chunk = F.pmod(F.xxhash64(item), F.col("chunks")).cast("int")
    others = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("chunks") - 1), chunk))
    each = found.select(*listed.columns, "chunks", chunk.alias("chunk"), F.explode(others).alias("other"))
    unit = F.when(F.col("chunks").isNull(), F.col(key)).otherwise(F.xxhash64(key, F.least("chunk", "other"), F.greatest("chunk", "other")))
    return each.select(*listed.columns, unit.alias("unit"))


def local_links(fps: np.ndarray, bits: int) -> np.ndarray:
    """Rows (fp, fp) that connect exactly the fingerprints of one posting list which chains of links connect."""
    fps = np.unique(fps)
    n = len(fps)
    group, strip, links = np.arange(n), max(1, STRIP // n), [np.zeros((0, 2), "u8")]
    for at in range(0, n, strip):
        differ = fps[at : at + strip, None] ^ fps[None, at:]
        shared = sum(((differ >> np.uint64(8 * p)) & np.uint64(0xFF) == 0).astype("u1") for p in range(8))
        # the tally of shared positional bytes comes first, then the bits of what it keeps
        rows, cols = np.nonzero(np.triu(shared >= 8 - bits, 1))
        close = np.bitwise_count(differ[rows, cols]) <= bits
        rows, cols = rows[close] + at, cols[close] + at
        if len(rows) and not group.any():
            break
        while len(rows):
            low, high = np.minimum(group[rows], group[cols]), np.maximum(group[rows], group[cols])
            apart = low != high
            rows, cols, low, high = rows[apart], cols[apart], low[apart], high[apart]
            # each group that meets a lower one joins one such; what it meets besides is looked at again
            joined, first = np.unique(high, return_index=True)
            links.append(np.stack([fps[rows[first]], fps[cols[first]]], 1))
            above = np.arange(n)
            above[joined] = low[first]
            while (further := above[above] != above).any():
                above[further] = above[above[further]]
            group = above[group]
    return np.concatenate(links)


def links_of(distinct: DataFrame, bits: int, list_rows: int = LIST_ROWS) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints which chains of links connect."""
    met = units(postings(distinct, bits), list_rows, "key", "fp").select("unit", "fp").repartition("unit").sortWithinPartitions("unit")

    def run(batches):
        open_unit, open_fps = None, np.zeros(0, "u8")

        def closed():
            links = local_links(open_fps, bits) if len(open_fps) > 1 else np.zeros((0, 2), "u8")
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0].view("i8")), pa.array(links[:, 1].view("i8"))], names=["a", "b"])

        for batch in batches:
            held, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view("u8")
            bounds = np.flatnonzero(np.r_[True, held[1:] != held[:-1], True])
            sizes = np.diff(bounds)
            # Units of one inside the batch are passed over at once; its first and last may go on in other batches.
            for k in sorted({0, len(sizes) - 1, *np.flatnonzero(sizes > 1).tolist()}) if len(sizes) else ():
                part, unit = fps[bounds[k] : bounds[k + 1]], int(held[bounds[k]])
                if unit != open_unit:
                    if len(open_fps) > 1:
                        yield closed()
                    open_unit, open_fps = unit, np.zeros(0, "u8")
                open_fps = np.r_[open_fps, part]
        if len(open_fps) > 1:
            yield closed()

    return met.mapInArrow(run, "a long, b long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) for every node of links (a, b).

    Rounds of "every node's larger neighbours point to its least neighbour", then "its smaller neighbours do", until
    nothing changes; the number of rounds follows the logarithm of the links. Each round's links are stored.
    """
    least = lambda df: df.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        before = edges
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        m = least(large)
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v")))
        edges = durable(small.filter(F.col("u") != F.col("v")).distinct(), "links")
        forget(before)
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        seen = state
    raise RuntimeError("the components did not settle")


def connected(prints: DataFrame, bits: int = LINK_BITS, list_rows: int = LIST_ROWS) -> DataFrame:
    """id, fp and component of every row of a stored table of ids and fingerprints: the least id (null only if there is
    no other) of the rows that chains of links join it with, itself included."""
    if not 1 <= bits <= 7:
        raise ValueError("links must allow from 1 to 7 bits")
    nodes = durable(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")), "distinct")
    roots = components(links_of(nodes.select("fp"), bits, list_rows))
    tied = durable(roots.join(nodes, roots["node"] == nodes["fp"]).select("root", "fp", "least"), "tied")
    of_root = durable(tied.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("rows")), "roots")
    moved = labelled(tied.select("root", "fp"), of_root, "root", tied.count()).select("fp", "component")
    labels = durable(nodes.join(moved, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"), "rows"), "labels")
    return labelled(prints.select("id", "fp"), labels, "fp", prints.count()).select("id", "fp", "component")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = LINK_BITS, words: int = SHINGLE_WORDS, list_rows: int = LIST_ROWS) -> DataFrame:
    """id, fp and component of every row: the least id of the rows that chains of links join it with, itself included.

    A null text has no words; its fingerprint, zero, links like any other, and so does an empty one's. Rows without an id
    take part; a component's least id is null only if none of its rows has one. Repeated rows are linked to each other.
    Links are searched among distinct fingerprints, so copies, however many, cost one row. A long text is read whole.
    An empty table gives an empty one; other columns are not looked at.
    """
    return connected(durable(fingerprints(df, id_col, text_col, words), "fingerprints"), bits, list_rows)


def op7_simhash_components(spark, sf_dir: str) -> DataFrame:
    made = near_duplicates(table(spark, sf_dir, "documents"))
    return made.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
