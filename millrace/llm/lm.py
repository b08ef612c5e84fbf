"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions; each decision has a tree of contexts of 0 to DEPTH bytes before it. A node's
Krichevsky-Trofimov estimate of its own counts is mixed half and half with the product of its children's mixtures. The
trees learn from the counts of all training texts; the code length of a text follows from the mixtures' predictions.

A gram is a byte with the DEPTH bytes before it. Grams are ordered by their contexts, nearest byte first, so that every
node of the trees is a run of grams, and that order is cut into ranges of about RANGE_BYTES positions of the corpus:

1. Texts are packed into blocks of about BLOCK_BYTES, as they come. A block sends every range the distinct grams that it
   has there, with their training counts.
2. A range gathers its grams from all blocks and mixes the nodes that lie inside it, bottom up. Nodes that a cut runs
   through, at most one of each depth at each cut, are summed up over their ranges by the bytes nearest to the prediction.
3. With those nodes' weights a range predicts its grams, top down, and answers every block with the code lengths of the
   grams that the block sent, in the block's order.
4. A block puts its own grams in order again and adds up the answers over its texts.

So what is sent follows the text: a block's grams meet the model of their own ranges only, and no task holds the model.
Nothing is pruned. Words travel alike, dealt by a hash instead of ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable, held_out, slim, small_batches, table

#: Bytes of the longest context; a context fits 64 bits.
DEPTH = 8
#: Bytes of text of a block, positions of the corpus in a range, and the most ranges (a cut is 8 bytes that all tasks see).
BLOCK_BYTES, RANGE_BYTES, MOST_RANGES = 12 << 20, 2 << 20, 1 << 22
#: Sampled contexts for each cut.
SAMPLES = 32
#: Stands before a text's start and for its end, and marks the places before a start; no UTF-8 text holds these bytes.
EDGE, PASSED = 0xFF, 0xFE
#: Bytes of a block that are dealt out at a time.
SORTED = 1 << 20
#: Counts up to which gamma functions are looked up, and those up to which pairs are.
TABLED, PAIRED = 1 << 13, 64
#: Parts of a bit in which code lengths travel; longer ones than 16 bits of these hold travel whole.
STEPS = 2048
#: Cut nodes' weights, in rows, that are broadcast at most; beyond, they meet the ranges by a shuffle.
BROADCAST_ROWS = 20_000
GRAMS, WORDS, CUT = 1, 2, 3
LOG10_2, LN_HALF = math.log10(2), math.log(0.5)
BLOCK = "block long, payload binary"
PIECE = "kind int, key int, block long, part int, payload binary"
_REST = np.uint64((1 << 56) - 1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: Stirling's series at x + 8, stepped back."""
    down = sum(np.log(x + i) for i in range(8))
    z = x + 8
    inner = 1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / z**2) / z**2) / z**2) / z**2
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + inner / z - down


_HALVES, _WHOLES = log_gamma(np.arange(TABLED) + 0.5), log_gamma(np.arange(TABLED) + 1.0)
_PAIRS = (_HALVES[:PAIRED, None] + _HALVES[None, :PAIRED] - math.log(math.pi) - _WHOLES[np.arange(PAIRED)[:, None] + np.arange(PAIRED)[None, :]]).ravel()


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of a sequence with these counts under the Krichevsky-Trofimov estimator."""
    small = (zeros < PAIRED) & (ones < PAIRED)
    out = _PAIRS[np.where(small, zeros * PAIRED + ones, 0).astype("i8")]
    if not small.all():
        z, o = zeros[~small].astype("f8"), ones[~small].astype("f8")
        some = log_gamma(z + 0.5) + log_gamma(o + 0.5) - math.log(math.pi) - log_gamma(z + o + 1)
        low = z + o < TABLED
        zi, oi = z[low].astype("i8"), o[low].astype("i8")
        some[low] = _HALVES[zi] + _HALVES[oi] - math.log(math.pi) - _WHOLES[zi + oi]
        out[~small] = some
    return out


def mixed(log_own: np.ndarray, log_children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the half-and-half mixture, and the share of the own estimate in it after all that was seen."""
    ahead = log_children - log_own
    less = np.exp(-np.abs(ahead))
    return np.maximum(log_own, log_children) + np.log1p(less) + LN_HALF, np.where(ahead > 0, less, 1) / (1 + less)


class Block:
    """The bytes of some texts, with DEPTH edges before and one after each, and their grams byte by byte."""

    def __init__(self, texts: list[bytes]) -> None:
        edge = bytes([EDGE])
        self.bytes = np.frombuffer(edge * DEPTH + (edge * (DEPTH + 1)).join(texts) + edge, "u1")
        sizes = np.array([len(t) + DEPTH + 1 for t in texts], "i8")
        self.begins = np.r_[0, np.cumsum(sizes)[:-1]].astype("i8")
        # the context of place p is the eight bytes that follow place n - p in the reversed text
        back = np.zeros(len(self.bytes) + 8, "u1")
        back[: len(self.bytes)] = self.bytes[::-1]
        self._contexts = np.ndarray((len(self.bytes) + 1,), ">u8", back.data, strides=(1,))

    def keys(self, at: np.ndarray) -> np.ndarray:
        """Of the places of bytes: their contexts but for the nearest byte, and the byte itself below."""
        made = self._contexts[len(self.bytes) - at].astype("u8")
        made <<= np.uint64(8)
        made |= self.bytes[at]
        return made

    def groups(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each byte that comes before another, and the places of those that it comes before."""
        before = np.r_[np.uint8(0), self.bytes[:-1]]
        for i in range(DEPTH):
            before[self.begins + i] = PASSED
        parts = []  # sorting some bytes at a time takes little memory besides
        for at in range(0, len(before), SORTED):
            some = before[at : at + SORTED]
            parts.append((at, np.argsort(some, kind="stable").astype("i4"), np.r_[0, np.cumsum(np.bincount(some, minlength=256))]))
        for byte in np.flatnonzero(np.bincount(before, minlength=256)).tolist():
            if byte != PASSED:
                yield byte, np.concatenate([order[ends[byte] : ends[byte + 1]] + np.int64(at) for at, order, ends in parts])


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each comes. Sorts in place."""
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, "i8")
    return keys[first], np.diff(np.r_[first, len(keys)])


def _learnt(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each comes in training texts."""
    seen, counts = _counted(keys[train])
    other, _ = _counted(keys[~train])
    both = np.concatenate([seen, other])
    order = np.argsort(both, kind="stable")
    both = both[order]
    kept = np.r_[True, both[1:] != both[:-1]] if len(both) else np.zeros(0, bool)
    return both[kept], np.r_[counts, np.zeros(len(other), "i8")][order[kept]]


def _cut_up(byte: int, keys: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Range, begin and end of the pieces of ordered keys after one byte."""
    low, high = np.searchsorted(cuts, np.uint64(byte << 56)), np.searchsorted(cuts, np.uint64(byte << 56) | _REST, "right")
    ends = [0, *np.searchsorted(keys, cuts[low:high] << np.uint64(8)).tolist(), len(keys)]
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        if b > a:
            yield int(low) + i, a, b


def _zipped(*parts: np.ndarray | bytes) -> bytes:
    data = b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)
    return pa.compress(data, "zstd", asbytes=True) + len(data).to_bytes(8, "little")


def _unzipped(payload: bytes) -> bytes:
    return pa.decompress(payload[:-8], int.from_bytes(payload[-8:], "little"), "zstd", asbytes=True)


def packed(byte: int, keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ordered grams after one byte: of each key the bytes from the first one on that differs from the key before it."""
    n = len(keys)
    differ = np.r_[np.uint64(2**64 - 1), keys[1:] ^ keys[:-1]]
    kept = np.zeros(n, "u1")
    for j in range(8):
        kept += differ >= np.uint64(1 << 8 * j)
    given = [((keys >> np.uint64(8 * j)).astype("u1"))[kept > j] for j in range(8)]
    return _zipped(np.array([n, byte], "<u4"), kept, np.minimum(counts, 255).astype("u1"), *given, counts[counts >= 255].astype("<u4"))


def unpacked(payload: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    data = _unzipped(payload)
    n, byte = np.frombuffer(data, "<u4", 2).tolist()
    kept, small = np.frombuffer(data, "u1", n, 8), np.frombuffer(data, "u1", n, 8 + n)
    keys, at = np.zeros(n, "u8"), 8 + 2 * n
    for j in range(8):
        told = np.flatnonzero(kept > j)
        plane = np.frombuffer(data, "u1", len(told), at)
        keys |= (np.repeat(plane, np.diff(np.r_[told, n])) if len(told) < n else plane).astype("u8") << np.uint64(8 * j)
        at += len(told)
    counts = small.astype("i8")
    counts[small == 255] = np.frombuffer(data, "<u4", offset=at)
    return byte, keys, counts


def _steps(numbers: np.ndarray) -> bytes:
    """Ascending numbers, by their differences."""
    differ = np.diff(np.r_[0, numbers])
    return _zipped(np.array([len(numbers)], "<u4"), np.minimum(differ, 255).astype("u1"), differ[differ >= 255].astype("<u4"))


def _stepped(payload: bytes) -> np.ndarray:
    data = _unzipped(payload)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    small = np.frombuffer(data, "u1", n, 4)
    differ = small.astype("i8")
    differ[small == 255] = np.frombuffer(data, "<u4", offset=4 + n)
    return np.cumsum(differ)


def _lengths(bits: np.ndarray) -> bytes:
    """Code lengths in bits, in STEPS of a bit; those beyond 16 bits of steps in full besides."""
    steps = np.minimum(np.rint(bits * STEPS), 65535).astype("<u2")
    return _zipped(np.array([len(bits)], "<u4"), steps.view("u1").reshape(-1, 2).T.tobytes(), bits[steps == 65535].astype("<f8"))


def _in_bits(payload: bytes) -> np.ndarray:
    data = _unzipped(payload)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    steps = np.frombuffer(data, "u1", 2 * n, 4).reshape(2, n).T.copy().view("<u2").ravel()
    bits = steps / STEPS
    bits[steps == 65535] = np.frombuffer(data, "<f8", offset=4 + 2 * n)
    return bits


def _hashed(words: pa.Array, ranges: int) -> np.ndarray:
    """A range for each word, that follows from its bytes alone: a polynomial of them, well mixed."""
    if not len(words):
        return np.zeros(0, "i8")
    ends = np.frombuffer(words.buffers()[1], "<i4", len(words) + 1, 4 * words.offset).astype("i8")
    data, starts = np.frombuffer(words.buffers()[2], "u1")[ends[0] : ends[-1]], ends[:-1] - ends[0]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(ends))
    powers = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, "u8"))
    value = np.add.reduceat((data + np.uint64(1)) * powers[place], starts)
    value = (value ^ value >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (value >> np.uint64(33)).astype("i8") % ranges


class Words:
    """The words of some lower-cased texts: distinct ones, and each token's text and number. Ends are not among them."""

    def __init__(self, texts: pa.Array, ranges: int) -> None:
        lists = pc.ascii_split_whitespace(texts)
        of = np.repeat(np.arange(len(texts), dtype="i4"), np.diff(lists.offsets.to_numpy()))
        coded = lists.flatten().dictionary_encode()
        del lists
        # white space at a text's ends leaves empty words, which are none
        written = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0 if len(coded.dictionary) else np.zeros(0, bool)
        self.spelled = coded.dictionary.filter(pa.array(written))
        number = coded.indices.to_numpy(zero_copy_only=False)
        real = written[number] if len(number) else np.zeros(0, bool)
        self.texts, self.tokens = of[real], (np.cumsum(written, dtype="i4") - np.int32(1))[number[real]]
        del coded, number, of, real
        to = _hashed(self.spelled, ranges)
        self.order = np.argsort(to, kind="stable")
        self.to = to[self.order]

    def sent(self, train: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """For each range its words with their training counts."""
        counts = np.bincount(self.tokens[train[self.texts]], minlength=len(self.spelled))[self.order].astype("<u4")
        spelled = self.spelled.take(pa.array(self.order))
        ends = np.frombuffer(spelled.buffers()[1], "<i4", len(spelled) + 1, 4 * spelled.offset) if len(spelled) else np.zeros(1, "<i4")
        data = spelled.buffers()[2]
        cuts = np.flatnonzero(np.r_[True, self.to[1:] != self.to[:-1], True]) if len(spelled) else np.zeros(1, "i8")
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            yield int(self.to[a]), _zipped(np.array([b - a], "<u4"), counts[a:b], np.diff(ends[a : b + 1]).astype("<u4"), bytes(data[ends[a] : ends[b]]))


def _lowered(column) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(column, "").combine_chunks() if isinstance(column, pa.ChunkedArray) else pc.fill_null(column, ""))


def _opened(payload: bytes) -> pa.Table:
    with pa.ipc.open_stream(payload) as stream:
        return stream.read_all()


def _closed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return out.getvalue().to_pybytes()


def _pieces(number: int, docs: pa.Table, cuts: np.ndarray) -> Iterator[tuple]:
    """PIECE rows of a block: its grams and words by range."""
    lowered, train = _lowered(docs.column("text")), np.array(docs.column("train").to_pylist(), bool)
    for key, payload in Words(lowered, len(cuts) + 1).sent(train):
        yield WORDS, key, number, 0, payload
    block = Block([x.as_buffer().to_pybytes() for x in lowered])
    del lowered
    learnt = np.repeat(train, np.diff(np.r_[block.begins, len(block.bytes)]))
    for byte, at in block.groups():
        keys, counts = _learnt(block.keys(at), learnt[at])
        del at
        for key, a, b in _cut_up(byte, keys, cuts):
            yield GRAMS, key, number, byte, packed(byte, keys[a:b], counts[a:b])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "key", "block", "part", "payload"])


def _merged(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Contexts, last bytes and counts of the distinct grams of a range, and the numbers of each row's grams among them."""
    found = [unpacked(p) for p in payloads]
    numbers: list = [None] * len(found)
    contexts, last, sums, so_far = [], [], [], 0
    for byte in sorted({f[0] for f in found}):
        rows = [i for i, f in enumerate(found) if f[0] == byte]
        keys, counts = np.concatenate([found[i][1] for i in rows]), np.concatenate([found[i][2] for i in rows])
        order = np.argsort(keys, kind="stable")
        opens = np.r_[True, keys[order][1:] != keys[order][:-1]]
        number = np.empty(len(keys), "i8")
        number[order] = np.cumsum(opens) - 1
        distinct = keys[order[opens]]
        sums.append(np.bincount(number, counts, len(distinct)).astype("i8"))
        contexts.append(distinct >> np.uint64(8) | np.uint64(byte << 56))
        last.append((distinct & np.uint64(0xFF)).astype("u1"))
        for i, part in zip(rows, np.split(number, np.cumsum([len(found[i][1]) for i in rows])[:-1]), strict=True):
            numbers[i] = part + so_far
        so_far += len(distinct)
    return np.concatenate(contexts), np.concatenate(last), np.concatenate(sums), numbers


class Range:
    """The trees over one range's grams, which lie between two cuts (None: the end of all contexts).

    A node after which one byte alone was met in this range, and that no cut runs through, is plain: its counts are all
    zeros or all ones at every decision of that byte, so one mixture serves all eight, and below it all nodes are plain.
    The others are mixed decision by decision.
    """

    def __init__(self, contexts: np.ndarray, last: np.ndarray, counts: np.ndarray, low: int | None, high: int | None) -> None:
        opens = np.r_[True, contexts[1:] != contexts[:-1]]
        nodes, key = contexts[opens], np.cumsum(opens) - 1 << 8 | last
        #: by depth: node number and byte of each row, in order, its count, and the row above it that it belongs to
        self.keys, self.counts, self.above = [key], [counts], []
        #: by depth: (node number, node) of those that a cut runs through
        self.cut: list[list[tuple[int, int]]] = [[]]
        for depth in range(DEPTH - 1, -1, -1):
            nodes = nodes >> np.uint64(8)
            opens = np.r_[True, nodes[1:] != nodes[:-1]]
            key = (np.cumsum(opens) - 1)[self.keys[0] >> 8] << 8 | self.keys[0] & 0xFF
            nodes = nodes[opens]
            order = np.argsort(key, kind="stable")
            key = key[order]
            opens = np.r_[True, key[1:] != key[:-1]]
            above = np.empty(len(key), "i8")
            above[order] = np.cumsum(opens) - 1
            self.above.insert(0, above)
            self.counts.insert(0, np.bincount(above, self.counts[0]).astype("i8"))
            self.keys.insert(0, key[opens])
            below = 8 * (DEPTH - depth)
            through = sorted({c >> below for c in (low, high) if c is not None and c & (1 << below) - 1})
            at = [int(np.searchsorted(nodes, np.uint64(node))) for node in through]
            self.cut.insert(0, [(i, node) for i, node in zip(at, through, strict=True) if i < len(nodes) and int(nodes[i]) == node])
        self._plain()

    def _plain(self) -> None:
        #: by depth: the rows of nodes that are not plain, and their places among these
        self.rows, self.place = [None] * (DEPTH + 1), [None] * (DEPTH + 1)
        #: by depth: of plain rows under one that is not, the place of that one, and the log of their mixture
        self.joins: list = [None] * (DEPTH + 1)
        whole, share = [None] * (DEPTH + 1), [None] * (DEPTH + 1)
        plain: list = [None] * (DEPTH + 1)
        for depth in range(DEPTH, -1, -1):
            node = self.keys[depth] >> 8
            alone = np.r_[True, node[1:] != node[:-1]] & np.r_[node[1:] != node[:-1], True]
            for at, _ in self.cut[depth]:
                alone[node == at] = False
            plain[depth] = alone
            self.rows[depth] = np.flatnonzero(~alone)
            self.place[depth] = np.cumsum(~alone) - 1
            own = log_kt(np.zeros(len(node), "i8"), self.counts[depth])
            if depth == DEPTH:
                whole[depth], share[depth] = own, np.ones(len(node))
                continue
            # what is not plain is left out here: the sums of its rows are overwritten decision by decision
            product = np.bincount(self.above[depth], np.where(plain[depth + 1], whole[depth + 1], 0), len(node))
            whole[depth], share[depth] = mixed(own, product)
            under = np.flatnonzero(plain[depth + 1] & ~alone[self.above[depth]])
            self.joins[depth + 1] = self.place[depth][self.above[depth][under]], whole[depth + 1][under]
        #: by depth: grams whose nodes are plain from there on, the place of the row above, and the chance that the plain
        #: nodes give each decision of the gram's byte
        self.ends: list = [None] * (DEPTH + 1)
        told, left, begun = (np.zeros(len(self.keys[0])), np.ones(len(self.keys[0])), np.zeros(len(self.keys[0]), "i8"))
        above = np.zeros(len(self.keys[0]), "i8")
        for depth in range(DEPTH + 1):
            if depth:
                up = self.above[depth - 1]
                fresh = plain[depth] & ~plain[depth - 1][up]
                told, left, begun, above = told[up], left[up], np.where(fresh, depth, begun[up]), np.where(fresh, self.place[depth - 1][up], above[up])
            on = plain[depth]
            chance = (self.counts[depth] + 0.5) / (self.counts[depth] + 1)
            told, left = np.where(on, told + left * share[depth] * chance, told), np.where(on, left * (1 - share[depth]), left)
        for depth in range(DEPTH + 1):
            grams = np.flatnonzero(plain[DEPTH] & (begun == depth))
            self.ends[depth] = grams, above[grams], told[grams]

    def mixtures(self, given: dict | None = None) -> Iterator[tuple[int, list[tuple], list[tuple]]]:
        """For each decision of a byte, the last one first, from the longest contexts up: (run of each row, share, estimate,
        run above) by depth, over the rows that are not plain, a run being those of one node and decision; and of cut
        nodes their sums (depth, node, place, zeros, ones, product). given: shares and estimates of cut nodes by (depth,
        node) and place."""
        keys = [k[r] for k, r in zip(self.keys, self.rows, strict=True)]
        firsts, totals = [np.arange(len(r)) for r in self.rows], [c[r] for c, r in zip(self.counts, self.rows, strict=True)]
        for level in range(7, -1, -1):
            made: list[tuple] = []
            sums: list[tuple] = []
            whole = None
            for depth in range(DEPTH, -1, -1):
                # the runs of the next decision, in pairs
                key, total = keys[depth][firsts[depth]], totals[depth]
                prefix = key >> 8 - level
                opens = np.r_[True, prefix[1:] != prefix[:-1]] if len(key) else np.zeros(0, bool)
                pair = np.flatnonzero(opens)
                ones = np.add.reduceat(total * (key >> 7 - level & 1), pair) if len(pair) else total
                total = np.add.reduceat(total, pair) if len(pair) else total
                first, key = firsts[depth][pair], key[pair]
                run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys[depth])]))
                own, estimate = log_kt(total - ones, ones), (ones + 0.5) / (total + 1)
                if depth == DEPTH:
                    whole, share = own, np.ones(len(own))
                else:
                    # the rows of the depth below that open its runs, and what they hang from
                    begins = self.rows[depth + 1][firsts[depth + 1]]
                    over = run[self.place[depth][self.above[depth][begins]]]
                    for at, _ in self.cut[depth + 1]:
                        whole = np.where(self.keys[depth + 1][begins] >> 8 == at, 0, whole)
                    hung, weights = self.joins[depth + 1]
                    product = np.bincount(over, whole, len(first)) + np.bincount(run[hung], weights, len(first))
                    made[0] = (*made[0][:3], over)
                    whole, share = mixed(own, product)
                    for at, node in self.cut[depth]:
                        here = np.flatnonzero(key >> 8 == at)
                        place = (1 << level | (key[here] & 0xFF) >> 8 - level).astype("i4")
                        if given is None:
                            sums.append((depth, node, place, (total - ones)[here], ones[here], product[here]))
                        else:
                            share[here], estimate[here] = (x[place] for x in given[depth, node])
                firsts[depth], totals[depth] = first, total
                made.insert(0, (run, share, estimate, None))
            yield level, made, sums

    def cut_nodes(self) -> list[tuple]:
        """(depth, node, place, zeros, ones, product) of the nodes that a cut runs through, over all decisions."""
        found: dict = {}
        for _, _, sums in self.mixtures():
            for depth, node, *values in sums:
                found.setdefault((depth, node), []).append(values)
        return [(depth, node, *(np.concatenate(x) for x in zip(*parts, strict=True))) for (depth, node), parts in found.items()]

    def bits(self, given: dict) -> np.ndarray:
        """Code length of each gram's byte after its context."""
        out = np.zeros(len(self.keys[DEPTH]))
        for level, made, _ in self.mixtures(given):
            added, left = np.zeros(1), np.ones(1)
            for depth, (run, share, estimate, over) in enumerate(made):
                grams, hung, told = self.ends[depth]
                if len(grams):
                    # the nodes above, if there are any, leave a part of the chance to the plain ones
                    at = made[depth - 1][0][hung] if depth else np.zeros(len(grams), "i8")
                    bit, rest = self.keys[DEPTH][grams] >> 7 - level & 1, left[at]
                    out[grams] -= np.log2(np.where(bit, added[at], 1 - rest - added[at]) + rest * told)
                if depth:
                    added, left = added[over], left[over]
                elif len(share) != 1:
                    added, left = np.zeros(len(share)), np.ones(len(share))
                added, left = added + left * share * estimate, left * (1 - share)
            rows = self.rows[DEPTH]
            ones = added[made[DEPTH][0]]
            out[rows] -= np.log2(np.where(self.keys[DEPTH][rows] >> 7 - level & 1, ones, 1 - ones))
        return out


def _bounds(cuts: np.ndarray, key: int) -> tuple[int | None, int | None]:
    return (int(cuts[key - 1]) if key else None), (int(cuts[key]) if key < len(cuts) else None)


def _weighed(nodes: np.ndarray, place: np.ndarray, *sums: np.ndarray) -> list[np.ndarray]:
    """Sums of values over equal nodes, which are numbered, and places."""
    size = 256 * (int(nodes.max()) + 1)
    return [np.bincount(nodes * 256 + place, x, size).reshape(-1, 256) for x in sums]


def _finished(zeros: np.ndarray, ones: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mixture, share and estimate of nodes by place; places without counts have the mixture 1."""
    whole, share = mixed(log_kt(zeros, ones), product)
    return whole, share, (ones + 0.5) / (zeros + ones + 1)


_FLAT = "key int, depth int, node long, place int, zeros double, ones double, product double"


def _flat(batches):
    """Rows of the cut nodes' decisions."""
    for batch in batches:
        for key, depth, node, payload in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "block", "payload")), strict=True):
            values = np.frombuffer(_unzipped(payload), "<f8").reshape(4, -1)
            n = values.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key), pa.int32()), pa.array(np.full(n, depth), pa.int32()), pa.array(np.full(n, node), pa.int64()), pa.array(values[0].astype("i4")), *(pa.array(v) for v in values[1:])], names=["key", "depth", "node", "place", "zeros", "ones", "product"])


def _summed_up(group: pa.Table) -> pa.Table:
    """Cut nodes of two bytes and more that begin with the same two: shares and estimates of each range's nodes, and (with
    no range) what the nodes of two bytes add to the product of that of one."""
    key, depth, place = (group.column(c).to_numpy() for c in ("key", "depth", "place"))
    node = group.column("node").to_numpy().view("u8")
    values = [group.column(c).to_numpy() for c in ("zeros", "ones", "product")]
    rows: list[tuple] = []
    came: tuple[np.ndarray, np.ndarray] | None = None
    for d in range(DEPTH - 1, 1, -1):
        here = np.flatnonzero(depth == d)
        if not len(here):
            continue
        nodes, number = np.unique(node[here], return_inverse=True)
        zeros, ones, product = _weighed(number, place[here], *(v[here] for v in values))
        if came is not None:
            np.add.at(product, np.searchsorted(nodes, came[0] >> np.uint64(8)), came[1])
        whole, share, estimate = _finished(zeros, ones, product)
        came = nodes, whole
        by_range = np.lexsort((number, key[here]))
        edges = np.flatnonzero(np.r_[True, (np.diff(key[here][by_range]) != 0) | (np.diff(number[by_range]) != 0), True])
        for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            own = by_range[a:b]
            n, at = number[own[0]], place[here[own]]
            rows.append((int(key[here[own[0]]]), d, int(node[here[own[:1]]].view("i8")[0]), np.stack([at, share[n][at], estimate[n][at]]).astype("<f8").tobytes()))
    nodes, whole = came
    for n, w in zip((nodes >> np.uint64(8)).tolist(), whole, strict=True):
        at = np.flatnonzero(w)
        rows.append((None, 1, n, np.stack([at, w[at], w[at]]).astype("<f8").tobytes()))
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("key", "depth", "node", "payload"), zip(*rows, strict=True), kinds, strict=True)})


def _lifted(batches):
    """What finished nodes of two bytes add to those of one, as rows of decisions."""
    for batch in batches:
        for depth, node, payload in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "payload")), strict=True):
            place, whole, _ = np.frombuffer(payload, "<f8").reshape(3, -1)
            n = len(place)
            zero = pa.array(np.zeros(n))
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.array(np.full(n, depth), pa.int32()), pa.array(np.full(n, node), pa.int64()), pa.array(place.astype("i4")), zero, zero, pa.array(whole)], names=["key", "depth", "node", "place", "zeros", "ones", "product"])


def _top(flat: DataFrame, weights: DataFrame) -> dict:
    """Shares and estimates of the nodes of one byte and none that cuts run through: at most 257, of 255 decisions each."""
    lifted = weights.filter(F.col("key").isNull()).mapInArrow(_lifted, _FLAT)
    sums = flat.filter("depth < 2").union(lifted).groupBy("depth", "node", "place").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "product"))).collect()
    made: dict = {}
    held: dict = {}
    for r in sums:
        held.setdefault((r["depth"], r["node"]), np.zeros((3, 256)))[:, r["place"]] = r["zeros"], r["ones"], r["product"]
    for at in sorted(held, reverse=True):
        zeros, ones, product = held[at]
        whole, *made[at] = _finished(zeros, ones, product)
        if at[0]:
            held[0, 0][2] += whole
    return made


def _cuts(texts: DataFrame, total: int, range_bytes: int) -> np.ndarray:
    """Contexts that cut the corpus's positions into ranges of about range_bytes, from a sample of all texts' positions."""
    size = max(range_bytes, total // MOST_RANGES)
    step, tasks = max(1, size // SAMPLES), max(1, total // size * SAMPLES >> 20)
    if total <= size:
        return np.zeros(0, "u8")

    def sampled(batches):
        at = TaskContext.get().partitionId() * 7919 % step  # how far the next sampled position is
        for batch in batches:
            found = []
            for t in _lowered(batch.column(0)):
                t = t.as_buffer()
                while at <= t.size:
                    found.append(int.from_bytes((bytes([EDGE]) * DEPTH + bytes(t[max(0, at - DEPTH) : at]))[-DEPTH:][::-1], "big") - (1 << 63))
                    at += step
                at -= t.size + 1
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["at"])

    def thinned(batches):
        seen = 0
        for batch in batches:
            yield batch.take(pa.array(np.arange(-seen % SAMPLES, batch.num_rows, SAMPLES)))
            seen += batch.num_rows

    found = texts.select("text").mapInArrow(sampled, "at long").repartitionByRange(tasks, "at").sortWithinPartitions("at").mapInArrow(thinned, "at long")
    cuts = np.unique(np.array([r["at"] for r in found.collect()], "i8"))
    return cuts.view("u8") ^ np.uint64(1 << 63)


def _in_blocks(texts: DataFrame, block_bytes: int) -> DataFrame:
    """BLOCK rows of all texts. A block holds texts of one task, as they come, so that equal rows are nothing special."""

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def closed():
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_closed(pa.Table.from_batches(held))], pa.binary())], names=["block", "payload"])

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype("i8") + 1)
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                upto = max(at + (not size), int(np.searchsorted(ends, before + block_bytes - size, "right")))
                if upto > at:
                    held.append(batch.slice(at, upto - at))
                    size += int(ends[upto - 1]) - before
                if upto < batch.num_rows or size >= block_bytes:
                    yield closed()
                    number, held, size = number + 1, [], 0
                at = upto
        if size:
            yield closed()

    return texts.mapInArrow(run, BLOCK)


def _word_answers(key: int, blocks: list[int], payloads: list[bytes]) -> Iterator[tuple]:
    """To each block the training counts of the words that it sent; and once (for no block) all counts above 0."""
    arrays, counts = [], []
    for payload in payloads:
        data = _unzipped(payload)
        n = int(np.frombuffer(data, "<u4", 1)[0])
        counts.append(np.frombuffer(data, "<u4", n, 4))
        ends = np.r_[0, np.cumsum(np.frombuffer(data, "<u4", n, 4 + 4 * n), dtype="i8")].astype("<i4")
        arrays.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[4 + 8 * n :])]))
    coded = pa.concat_arrays(arrays).dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False)
    sums = np.bincount(number, np.concatenate(counts), len(coded.dictionary)).astype("<i8")
    for block, part in zip(blocks, np.split(number, np.cumsum([len(a) for a in arrays])[:-1]), strict=True):
        yield WORDS, key, block, 0, _zipped(sums[part])
    yield WORDS, key, -1, 0, np.array([sums.sum(), np.count_nonzero(sums)], "<i8").tobytes()


def _gathered(cuts):
    """Of one range: the answers to its words; or one row with its merged grams and the numbers of each block's, and a CUT
    row (part: depth, block: node) for each node that a cut runs through."""

    def run(group: pa.Table) -> pa.Table:
        kind, key = group.column("kind")[0].as_py(), group.column("key")[0].as_py()
        group = group.sort_by([("block", "ascending"), ("part", "ascending")])
        blocks, payloads = group.column("block").to_pylist(), group.column("payload").to_pylist()
        if kind == WORDS:
            return pa.Table.from_batches([_batch(list(_word_answers(key, blocks, payloads)))])
        contexts, last, counts, numbers = _merged(payloads)
        del payloads
        model = _zipped(np.array([len(last)], "<u4"), contexts.astype(">u8").view("u1").reshape(-1, 8).T.tobytes(), last, counts.astype("<i8"))
        held = pa.table({"block": pa.array([-1, *blocks], pa.int64()), "part": pa.array([0, *group.column("part").to_pylist()], pa.int32()), "payload": pa.array([model, *map(_steps, numbers)], pa.binary())})
        rows = [(GRAMS, key, -1, 0, _closed(held))]
        for depth, node, *values in Range(contexts, last, counts, *_bounds(cuts.value, key)).cut_nodes():
            rows.append((CUT, key, node - (1 << 64) if node >> 63 else node, depth, _zipped(np.stack([v.astype("<f8") for v in values]))))
        slim()
        return pa.Table.from_batches([_batch(rows)])

    return run


def _answers(cuts, top):
    """To each block the code lengths of the grams that it sent. Rows: key, payload of _gathered(), weights of cut nodes."""

    def run(batches):
        for batch in batches:
            for key, payload, weights in zip(*(batch.column(c).to_pylist() for c in ("key", "payload", "weights")), strict=True):
                given = dict(top.value)
                for w in weights or ():
                    place, share, estimate = np.frombuffer(w["payload"], "<f8").reshape(3, -1)
                    shares, estimates = np.zeros(256), np.zeros(256)
                    shares[place.astype("i4")], estimates[place.astype("i4")] = share, estimate
                    given[w["depth"], w["node"] & (1 << 64) - 1] = shares, estimates
                held = _opened(payload)
                sent = held.column("payload")
                data = _unzipped(sent[0].as_py())
                n = int(np.frombuffer(data, "<u4", 1)[0])
                contexts = np.frombuffer(data, "u1", 8 * n, 4).reshape(8, n).T.copy().view(">u8").ravel().astype("u8")
                last, counts = np.frombuffer(data, "u1", n, 4 + 8 * n), np.frombuffer(data, "<i8", n, 4 + 9 * n)
                bits = Range(contexts, last, counts, *_bounds(cuts.value, key)).bits(given)
                parts = zip(held.column("block").to_pylist()[1:], held.column("part").to_pylist()[1:], range(1, len(sent)), strict=True)
                yield _batch([(GRAMS, key, block, part, _lengths(bits[_stepped(sent[i].as_py())])) for block, part, i in parts])
            slim()

    return run


def score(df: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every row.

    train: a condition, true for the rows whose texts the model learns from (null: false). Texts are lower-cased from A
    to Z; score is the log10 probability of a text's bytes and end, each byte's code length being rounded to 1/STEPS bit
    on its way; bits_per_byte is its code length in bits over its bytes and end. base_score is that of its words and end
    under add-half unigram counts. A null text is empty, an empty one has its end alone, and one longer than a block is a
    block by itself. Without training texts all decisions are even. Repeated rows and ids, null ones too, count and are
    scored each time. An empty table gives an empty one; other columns are not looked at.
    """
    spark = df.sparkSession
    small_batches(spark)
    texts = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    total, ends = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)), F.coalesce(F.sum(F.col("train").cast("int")), F.lit(0))).first()
    cuts = _cuts(texts, total, range_bytes)
    shared, ranges = spark.sparkContext.broadcast(cuts), len(cuts) + 1  # at most MOST_RANGES, of 8 bytes
    # Tables of few files are dealt out, so that all cores take part.
    wanted = min(spark.sparkContext.defaultParallelism, -(-total // (1 << 20)))
    spread = texts.repartition(wanted) if texts.rdd.getNumPartitions() < wanted else texts
    blocks = durable(_in_blocks(spread, block_bytes), "blocks")

    def sending(batches):
        rows: list[tuple] = []
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in _pieces(number, _opened(payload), shared.value):
                    rows.append(row)
                    if len(rows) >= 64:
                        yield _batch(rows)
                        rows.clear()
                slim()
        if rows:
            yield _batch(rows)

    sent = blocks.mapInArrow(sending, PIECE).repartition(min(2 * ranges, 100_000), "kind", "key")
    gathered = durable(sent.groupBy("kind", "key").applyInArrow(_gathered(shared), PIECE), "gathered")
    of = lambda kind: gathered.filter(F.col("kind") == kind)
    top: dict = {}
    ready = of(GRAMS).select("key", "payload")
    if len(cuts):
        flat = durable(of(CUT).mapInArrow(_flat, _FLAT), "cut-nodes")
        deep = flat.filter("depth >= 2").withColumn("head", F.expr("shiftrightunsigned(node, 8 * (depth - 2))"))
        weights = durable(deep.groupBy("head").applyInArrow(_summed_up, "key int, depth int, node long, payload binary"), "cut-weights")
        top = _top(flat, weights)
        own = weights.filter(F.col("key").isNotNull()).groupBy("key").agg(F.collect_list(F.struct("depth", "node", "payload")).alias("weights"))
        ready = ready.join(F.broadcast(own) if weights.count() <= BROADCAST_ROWS else own, "key", "left")
    else:
        ready = ready.withColumn("weights", F.lit(None).cast("array<struct<depth:int,node:bigint,payload:binary>>"))
    known = spark.sparkContext.broadcast(top)  # at most 257 nodes of 255 decisions
    totals = of(WORDS).filter("block < 0").select("payload").mapInArrow(_totals, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n_train, distinct = totals[0] + ends, totals[1] + (ends > 0)
    back = of(WORDS).filter("block >= 0").union(ready.mapInArrow(_answers(shared, known), PIECE))
    log_all, log_end, kind = math.log10(n_train + 0.5 * (distinct + 1)), math.log10(ends + 0.5), df.schema[id_col].dataType.simpleString()

    def run(sent: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _opened(sent.column("payload")[0].as_py())
        answers = answers.sort_by([("kind", "ascending"), ("part", "ascending"), ("key", "ascending")])
        kinds, parts, payloads = answers.column("kind").to_numpy(), answers.column("part").to_numpy(), answers.column("payload")
        received = lambda at, read: np.concatenate([read(payloads[i].as_py()) for i in at.tolist()]) if len(at) else np.zeros(0)
        lowered = _lowered(docs.column("text"))
        docs = docs.drop_columns(["text"])
        rows, words = len(lowered), Words(lowered, ranges)
        counts = np.zeros(len(words.spelled))
        counts[words.order] = received(np.flatnonzero(kinds == WORDS), lambda p: np.frombuffer(_unzipped(p), "<i8"))
        n_tokens = np.bincount(words.texts, minlength=rows) + 1
        base = np.bincount(words.texts, np.log10(counts + 0.5)[words.tokens], rows) + log_end - n_tokens * log_all
        n_known = np.bincount(words.texts, (counts > 0)[words.tokens], rows).astype("i8") + (ends > 0)
        del words
        block, bits = Block([x.as_buffer().to_pybytes() for x in lowered]), np.zeros(rows)
        del lowered
        text = np.repeat(np.arange(rows, dtype="i4"), np.diff(np.r_[block.begins, len(block.bytes)]))
        for byte, at in block.groups():
            keys = block.keys(at)
            order = np.argsort(keys)
            keys, at = keys[order], at[order]
            del order
            number = np.cumsum(np.r_[False, keys[1:] != keys[:-1]], dtype="i4")
            del keys
            own = received(np.flatnonzero((kinds == GRAMS) & (parts == byte)), _in_bits)[number]
            bits += np.bincount(text[at], own, rows)
            del at, own, number
        n_bytes = np.diff(np.r_[block.begins, len(block.bytes)]) - DEPTH - 1
        del block, text
        slim()
        made = {"n_tokens": n_tokens, "n_known": n_known, "base_score": base, "score": -bits * LOG10_2, "n_bytes": n_bytes, "bits_per_byte": bits / (n_bytes + 1)}
        return pa.table({"doc_id": docs.column("doc_id"), "train": docs.column("train")} | {n: pa.array(x) for n, x in made.items()})

    made = blocks.repartition(max(1, -(-4 * total // block_bytes)), "block").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, bits_per_byte double")
    return made.withColumn("train_tokens", F.lit(n_train).cast("long"))


def _totals(batches):
    for batch in batches:
        sums = np.array([np.frombuffer(p, "<i8") for p in batch.column(0).to_pylist()], "i8").reshape(-1, 2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(sums[:1]), pa.array(sums[1:])], names=["n", "v"])


def op6_context_tree_scores(spark, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 5)
    made = score(table(spark, sf_dir, "documents"), ~out)
    return made.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
