"""Sharding by a k-d tree over metadata.

A node that stands for k shards is cut where floor(k/2)/k of its bytes lie on the left, along the dimension in which its
rows are spread widest. Rows of equal texts share their metadata (the least of each) and lie side by side along every
dimension, so that a cut parts one group at most, and none that is light enough to go to one side whole. All nodes of a
level are cut together: one pass sums up bytes over the first digit of the keys of all dimensions, and a few more resolve
the digits below in the dimensions chosen. Only these sums, at most nodes x dimensions x 2^12 or nodes x 2^16, reach the
driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import durable, labelled, number_within, table

#: Bits of the sort key, from the top: place along the dimension, hash of the text, hash of the id.
PLACE_BITS, TEXT_BITS, ID_BITS = 18, 28, 16
#: Bits that one pass over the rows resolves; after all but the last, cells are whole groups of equal texts.
DIGITS = (12, 14, 10, 10, 16)
#: A cut is good enough when the rows that it can't tell apart yet weigh at most this share of the node.
TOLERANCE = 1e-4
#: A group of equal texts goes to one side whole if that shifts the cut by at most this share of a shard's bytes.
GROUP_TOLERANCE = 0.02
#: Bytes that a row weighs besides its text.
ROW_BYTES = 8


@dataclass
class Node:
    leaves: int
    first: int
    dim: int = 0
    cut: int | None = None
    low: Node | None = None
    high: Node | None = None


def _key(dim: int) -> Column:
    return F.col(f"_key{dim}")


def _assigned(node: Node, number: dict[int, int]) -> Column:
    """number of the leaf of the present tree that a row falls into."""
    if node.low is None or node.high is None or node.cut is None:
        return F.lit(number[node.first])
    return F.when(_key(node.dim) < F.lit(node.cut), _assigned(node.low, number)).otherwise(_assigned(node.high, number))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.low is None or node.high is None else _leaves(node.low) + _leaves(node.high)


def _placed(df: DataFrame, dims: list[str]) -> list[Column]:
    """Each dimension's place from 0 to 1: numbers and times within their range, other values by their hash; nulls at 0."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.TimestampType, T.DateType, T.BooleanType))}
    as_number = lambda c: F.col(c).cast("timestamp").cast("double") if isinstance(df.schema[c].dataType, T.DateType) else F.col(c).cast("double")
    finite = lambda c: F.when(F.abs(as_number(c)) < float("inf"), as_number(c))
    ranges = df.agg(*(f(finite(c)).alias(f"{n}{i}") for i, c in enumerate(dims) if c in numeric for n, f in (("low", F.min), ("high", F.max)))).first() if numeric & set(dims) else None
    out = []
    for i, c in enumerate(dims):
        if c in numeric:
            low, high = ranges[f"low{i}"], ranges[f"high{i}"]
            place = (finite(c) - F.lit(low)) / F.lit(high - low) if low is not None and high > low else F.lit(0.0)
        else:
            place = F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << 30)) / float(1 << 30)
            place = F.when(F.col(c).isNotNull(), place)
        out.append(F.coalesce(place, F.lit(0.0)))
    return out


def _nearest(sums: list[tuple[int, int]], below: int, want: float) -> tuple[int, int, int]:
    """Of ascending (digit, bytes): the digit in which `want` falls, its bytes, and the bytes below it."""
    for digit, weight in sums:
        if below + weight > want:
            break
        below += weight
    else:
        below -= weight
    return digit, weight, below


def grow_tree(keyed: DataFrame, dims: int, shards: int, tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE) -> Node:
    """The tree of a table with _size and, for each dimension, _key0, _key1, ..."""
    root = Node(shards, 0)
    while todo := [n for n in _leaves(root) if n.leaves > 1]:
        number = {n.first: i for i, n in enumerate(_leaves(root))}
        shift = sum(DIGITS) - DIGITS[0]
        each = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), _key(d).alias("key")) for d in range(dims))))
        digits = keyed.select(_assigned(root, number).alias("node"), "_size", each.alias("x")).groupBy("node", "x.dim", F.shiftright("x.key", shift).alias("digit"))
        seen: dict = {}
        for r in digits.agg(F.sum("_size").alias("bytes"), F.min("x.key").alias("low"), F.max("x.key").alias("high")).collect():
            seen.setdefault(r["node"], {}).setdefault(r["dim"], []).append((r["digit"], r["bytes"], r["low"], r["high"]))
        live: dict[int, dict] = {}
        for n in todo:
            n.cut = 0
            if not (found := seen.get(number[n.first])):
                continue
            spread = [(max(x[3] for x in found[d]) >> TEXT_BITS + ID_BITS) - (min(x[2] for x in found[d]) >> TEXT_BITS + ID_BITS) for d in range(dims)]
            n.dim = max(range(dims), key=lambda d: (spread[d], -d))
            total = sum(x[1] for x in found[0])
            state = {"node": n, "bytes": total, "want": total * (n.leaves // 2) / n.leaves, "prefix": 0, "below": 0}
            live[number[n.first]] = state
            state["sums"] = sorted((x[0], x[1]) for x in found[n.dim])
        for step, bits in enumerate(DIGITS):
            if step and live:
                held, shift = shift, shift - bits
                pick = lambda of: F.coalesce(*(F.when(F.col("node") == k, of(s)) for k, s in live.items()))
                at = keyed.withColumn("node", _assigned(root, number)).select("node", "_size", pick(lambda s: _key(s["node"].dim)).alias("key"), pick(lambda s: F.lit(s["prefix"])).alias("prefix"))
                cells = at.filter(F.shiftright("key", held) == F.col("prefix")).groupBy("node", F.shiftright("key", shift).bitwiseAND((1 << bits) - 1).alias("digit"))
                for s in live.values():
                    s["sums"] = []
                for r in cells.agg(F.sum("_size").alias("bytes")).collect():
                    live[r["node"]]["sums"].append((r["digit"], r["bytes"]))
            for k, s in list(live.items()):
                digit, weight, s["below"] = _nearest(sorted(s["sums"]), s["below"], s["want"])
                s["prefix"] = (s["prefix"] << bits) + digit
                before, after = s["want"] - s["below"], s["below"] + weight - s["want"]
                s["node"].cut = (s["prefix"] + (before > after)) << shift
                whole = step == len(DIGITS) - 2 and min(abs(before), abs(after)) <= group_tolerance * s["bytes"] / s["node"].leaves
                if whole or step < len(DIGITS) - 1 and weight <= tolerance * s["bytes"]:
                    del live[k]
        for n in todo:
            left = n.leaves // 2
            n.low, n.high = Node(left, n.first), Node(n.leaves - left, n.first + left)
    return root


def keys(df: DataFrame, dims: tuple[str, ...], id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """doc_id, _size, text_crc32 and the _key of each dimension that df has, stored; and how many dimensions there are."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    size = (F.length(text) + ROW_BYTES).cast("long")
    dims_here = [d for d in dims if d in df.columns]
    named = {f"_dim{i}": F.col(d) for i, d in enumerate(dims_here)}
    rows = durable(df.select(F.col(id_col).alias("doc_id"), size.alias("_size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_text"), *(c.alias(n) for n, c in named.items())), "shard-rows")
    groups = durable(rows.groupBy("_text").agg(*(F.min(n).alias(n) for n in named), F.count(F.lit(1)).alias("rows")), "shard-groups")
    places = _placed(groups, list(named)) or [F.lit(0.0)]
    head = lambda p: F.least(F.lit((1 << PLACE_BITS) - 1), F.floor(p * (1 << PLACE_BITS)).cast("long")) * (1 << TEXT_BITS) + F.pmod("_text", F.lit(1 << TEXT_BITS))
    of_group = groups.select("_text", "rows", *(head(p).alias(f"_key{i}") for i, p in enumerate(places)))
    joined = labelled(rows.drop(*named), of_group, "_text", rows.count())
    row = F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS))
    made = joined.select("doc_id", "_size", "text_crc32", *((_key(i) * (1 << ID_BITS) + row).alias(f"_key{i}") for i in range(len(places))))
    return durable(made, "shard-keys"), len(places)


def shard(df: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = ("n_chars", "doc_id", "source", "lang"), id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE) -> DataFrame:
    """The id, size, text_crc32, shard (from 0) and slot (gapless from 0 in each shard) of every row.

    shards, or else as many as hold target_bytes each. A row's size is its text's UTF-8 bytes and ROW_BYTES; a null
    text has none. Shards' sizes are equal but for the row, or the light group of equal texts, at each cut. Rows of one
    text are parted only by a cut that falls inside their group, rows with the same id and text never. Null metadata lies
    at a dimension's start. An empty table gives an empty result; dimensions that df lacks are passed over, and other
    columns are not looked at.
    """
    keyed, places = keys(df, dims, id_col, text_col)
    if shards is None:
        shards = max(1, math.ceil((keyed.agg(F.sum("_size")).first()[0] or 0) / target_bytes))
    root = grow_tree(keyed, places, shards, tolerance, group_tolerance)
    placed = keyed.select("doc_id", F.col("_size").alias("size"), "text_crc32", _assigned(root, {n.first: n.first for n in _leaves(root)}).cast("int").alias("shard"))
    return number_within(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")


def op9_kd_sharding(spark, sf_dir: str) -> DataFrame:
    made = shard(table(spark, sf_dir, "documents"), shards=24)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
