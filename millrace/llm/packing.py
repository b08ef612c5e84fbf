"""Packing of token sequences by patterns of lengths.

Documents become pieces of at most `capacity` tokens. Patterns of two or three lengths that fill a sequence exactly are
fitted to the histogram of lengths by non-negative least squares; their repeat counts are rounded, and what is left over
is packed by best fit. All of this works on the histogram, which has `capacity` entries whatever the corpus holds. Each
piece then finds its place by its number among the pieces of its length.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import PATTERN, byte_alphabet, codec_of, read_vocabulary
from millrace.llm.common import durable, fresh, number_within, small_batches, table

CAPACITY = 1024
#: Token after each document.
END_ID = 2
#: Repeat counts are rounded down, and besides so much of them is rounded with carry; the plan of fewest sequences holds.
SHARES = (1.0, 0.7, 0.5, 0.3)
#: Steps of the least-squares fit.
STEPS = 400

_encodings: dict = {}


def _encoding(vocabulary: str):
    """tiktoken's encoder for the vocabulary, whose ids must be merge ranks."""
    import tiktoken

    key = hash(vocabulary)
    if key not in _encodings:
        spec, to_byte = json.loads(vocabulary), byte_alphabet()
        ids = spec["model"]["vocab"]
        merged = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if spec.get("normalizer") or merged != sorted(merged):
            raise ValueError("only plain byte-level vocabularies in order of their merges are read")
        ranks = {bytes(map(to_byte.__getitem__, s)): i for s, i in ids.items()}
        _encodings.clear()
        _encodings[key] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={x["content"]: x["id"] for x in spec.get("added_tokens", ())})
    return _encodings[key]


def _tokens(vocabulary: str, text: str) -> np.ndarray:
    try:
        return _encoding(vocabulary).encode_to_numpy(text, allowed_special="all")
    except ValueError:  # its patterns give up on white space of a million characters; the slower encoder doesn't
        return np.frombuffer(codec_of(vocabulary).encode(text), "<u4")


def pieces(df: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The id as doc_id, piece (from 0), start, length and ids (packed little-endian unsigned 32-bit) of every piece.

    A document is its whole text's ids and end_id, a null text being empty. One of more than capacity tokens is cut from
    its end into pieces of capacity tokens, so that the first piece may be shorter.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))  # one file of a fixed size, about 1.5 MB
    names = ["doc_id", "piece", "start", "length", "ids"]

    def run(batches):
        for batch in batches:
            owner, piece, start, length, ids = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                tokens = np.append(_tokens(shared.value, text or ""), np.uint32(end_id)).astype("<u4")
                first = len(tokens) % capacity or capacity
                cuts = [0, *range(first, len(tokens) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    owner.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    ids.append(tokens[a:b].tobytes())
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def patterns_of(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All ways to fill capacity with two or three of the lengths, ascending in a row; 0 in the first place for two."""
    here = np.zeros(capacity + 1, bool)
    here[lengths[lengths < capacity]] = True
    here[0] = True
    found = []
    for a in np.flatnonzero(here[: capacity // 3 + 1]).tolist():
        b = np.arange(max(a, 1), (capacity - a) // 2 + 1)
        b = b[here[b] & here[capacity - a - b]]
        found.append(np.stack([np.full(len(b), a), b, capacity - a - b], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def fit(histogram: np.ndarray, patterns: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts >= 0 of the patterns that come nearest to the histogram in least squares (accelerated projection)."""
    n = len(histogram)
    if not len(patterns):
        return np.zeros(0)
    used = (patterns > 0).astype(float)

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns.ravel(), (used * x[:, None]).ravel(), n)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[patterns] * used).sum(1)

    v = np.ones(len(patterns))
    for _ in range(30):
        v = back(total(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(total(y) - histogram) / (1.05 * norm))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x


def rounded(repeats: np.ndarray, patterns: np.ndarray, histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts that the histogram can bear; what rounding cuts off is carried to the next pattern."""
    left = histogram.astype("i8").copy()
    out, carry = [], 0.0
    for k in np.lexsort((patterns[:, 1], patterns[:, 2]))[::-1].tolist():
        carry += repeats[k]
        if carry < 0.5:
            continue
        parts = [p for p in patterns[k].tolist() if p]
        times = min(int(carry + 0.5), *(int(left[p]) // parts.count(p) for p in parts))
        if times > 0:
            for p in parts:
                left[p] -= times
            out.append((tuple(parts), times))
            carry -= times
        carry = min(carry, 1.0)
    return out


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: equal sequences are opened and filled together."""
    open_by_space: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for length in np.flatnonzero(histogram)[::-1].tolist():
        n = int(histogram[length])
        while n:
            space = next((s for s in range(length, capacity + 1) if open_by_space[s]), None)
            if space is None:
                each = min(capacity // length, n)
                times = n // each
                open_by_space[capacity - each * length].append(((length,) * each, times))
                n -= each * times
                continue
            parts, times = open_by_space[space].pop()
            each = min(space // length, n)
            taken = min(times, n // each)
            if taken < times:
                open_by_space[space].append((parts, times - taken))
            open_by_space[space - each * length].append((parts + (length,) * each, taken))
            n -= each * taken
    return [x for held in open_by_space for x in held]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for all pieces that the histogram counts by length."""
    left = histogram.astype("i8").copy()
    full, left[capacity] = int(left[capacity]), 0
    patterns = patterns_of(np.flatnonzero(left), capacity)
    repeats = fit(left, patterns)
    whole = []
    for counts in (np.floor(repeats), *(share * repeats for share in SHARES)):
        done, rest = rounded(counts, patterns, left), left.copy()
        for parts, times in done:
            np.subtract.at(rest, list(parts), times)
        whole.append(done + best_fit(rest, capacity))
    return ([((capacity,), full)] if full else []) + min(whole, key=lambda x: sum(times for _, times in x))


def intervals(planned: list[tuple[tuple[int, ...], int]], capacity: int) -> np.ndarray:
    """Rows (length, first number, first sequence, offset): pieces of a length from that number on go to sequences from that one on."""
    given = np.zeros(capacity + 1, "i8")
    rows, sequence = [], 0
    for parts, times in planned:
        offset = 0
        for p in parts:
            rows.append((p, given[p], sequence, offset))
            given[p] += times
            offset += p
        sequence += times
    return np.array(sorted(rows), "i8").reshape(-1, 4)


def pack(df: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """df, which has a long column length from 1 to capacity, with sequence_id and offset.

    Sequences hold at most capacity; offsets leave no gap. df is read several times, so it should be stored. order:
    columns that tell its rows apart; rows equal in them are told apart in any way. An empty table gives an empty one.
    """
    counts = df.groupBy("length").count().collect()  # at most capacity rows
    histogram = np.zeros(capacity + 1, "i8")
    for r in counts:
        if not 1 <= r["length"] <= capacity:
            raise ValueError(f"a piece of {r['length']} tokens can't be packed")
        histogram[r["length"]] = r["count"]
    # The plan's size follows the number of lengths and patterns, not of pieces: broadcast with the task.
    steps = intervals(plan(histogram, capacity), capacity)
    number = fresh(df, "number")
    numbered = number_within(df, ["length"], list(order), number)
    names = numbered.columns
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + ["sequence_id long", "offset long"]
    kept = [names.index(n) for n in df.columns]
    at_length, at_number = names.index("length"), names.index(number)
    shared = df.sparkSession.sparkContext.broadcast(steps)

    def run(batches):
        steps = shared.value
        begins = np.searchsorted(steps[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, place = batch.column(at_length).to_numpy(), batch.column(at_number).to_numpy()
            row = np.zeros(len(length), "i8")
            for one in np.unique(length).tolist():
                own = steps[begins[one] : begins[one + 1], 1]
                at = length == one
                row[at] = begins[one] + np.searchsorted(own, place[at], "right") - 1
            found = steps[row]
            columns = [batch.column(i) for i in kept] + [pa.array(found[:, 2] + place - found[:, 1]), pa.array(found[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, names=[*(names[i] for i in kept), "sequence_id", "offset"])

    return numbered.mapInArrow(run, ", ".join(fields))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of whole sequences, from packed pieces with their ids."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(parts, "")).alias("ids"))


def op8_pattern_packing(spark, sf_dir: str) -> DataFrame:
    cut = pieces(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed = pack(durable(cut, "pieces"), order=("doc_id", "piece", "ids_crc32"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
