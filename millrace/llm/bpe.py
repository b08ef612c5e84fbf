"""Byte-pair encoding and decoding with the vocabulary of a public tokenizer.

The text is cut at added tokens, then into pre-tokens by the byte-level pattern. Each pre-token becomes a doubly linked
list of symbols; a priority queue holds the merge rank and place of every adjacent pair, and an entry whose pair is no
longer there when it comes up is skipped. Decoding concatenates the vocabulary's strings.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import small_batches, table, with_fields

#: Fixed value: the pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose ids a worker remembers in each of two generations; the older one goes when the newer is full.
REMEMBERED = 500_000
#: Longer pre-tokens are not remembered.
REMEMBERED_CHARS = 64
#: Pre-tokens of a text that are held at a time.
BLOCK = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec(dict):
    """Encoder and decoder of a vocabulary; as a dict, the packed ids of the pre-tokens met so far."""

    def __init__(self, vocabulary: str) -> None:
        """vocabulary: the JSON text of a byte-level BPE tokenizer."""
        super().__init__()
        self.older: dict[str, bytes] = {}
        spec = json.loads(vocabulary)
        model, to_byte = spec["model"], byte_alphabet()
        if spec.get("normalizer") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout"):
            raise ValueError("only plain byte-level vocabularies are read")
        ids = model["vocab"]
        self.strings: dict[int, bytes] = {i: bytes(map(to_byte.__getitem__, s)) for s, i in ids.items()}
        self.byte_ids = [ids[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(ids[a] << 32 | ids[b], (rank, ids[a + b]))
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.pretokens = regex.compile(PATTERN)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        symbols = [self.byte_ids[b] for b in word]
        n, merges, push, pop = len(symbols), self.merges, heapq.heappush, heapq.heappop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [m[0] << 32 | i for i in range(n - 1) if (m := merges.get(symbols[i] << 32 | symbols[i + 1]))]
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or symbols[i] < 0:
                continue
            m = merges.get(symbols[i] << 32 | symbols[j])
            if m is None or m[0] != entry >> 32:
                continue
            symbols[i], symbols[j] = m[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get(symbols[i] << 32 | symbols[k]):
                    push(queue, m[0] << 32 | i)
            if (h := before[i]) >= 0 and (m := merges.get(symbols[h] << 32 | symbols[i])):
                push(queue, m[0] << 32 | h)
        return [s for s in symbols if s >= 0]

    def __missing__(self, word: str) -> bytes:
        if (packed := self.older.get(word)) is None:
            packed = np.array(self.merge(word.encode()), "<u4").tobytes()
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def blocks(self, text: str) -> Iterator[bytes]:
        """The ids as packed little-endian 32-bit integers, some pre-tokens at a time."""
        at = 0
        for hit in self.cut.finditer(text) if self.cut else ():
            yield from self._plain(text, at, hit.start())
            yield np.array([self.added[hit.group()]], "<u4").tobytes()
            at = hit.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, start: int, end: int) -> Iterator[bytes]:
        part = text if (start, end) == (0, len(text)) else text[start:end]
        if len(part) <= BLOCK:
            yield b"".join(map(self.__getitem__, self.pretokens.findall(part)))
            return
        words = (m.group() for m in self.pretokens.finditer(part))
        while block := list(islice(words, BLOCK)):
            yield b"".join(map(self.__getitem__, block))

    def encode(self, text: str) -> bytes:
        return b"".join(self.blocks(text))

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def codec_of(vocabulary: str) -> Codec:
    """The codec of a vocabulary, made once in each worker."""
    key = hash(vocabulary)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def read_vocabulary(path: str | None = None) -> str:
    """The text of a vocabulary file of the driver; by default of the public byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _mapped(df: DataFrame, keep: list[str], source: str, new: list[tuple[str, T.DataType]], vocabulary: str, make) -> DataFrame:
    """df's keep columns and new ones that make(codec, values of source) gives as Arrow arrays."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # one file of a fixed size, about 1.5 MB

    def run(batches):
        codec = codec_of(shared.value)
        for batch in batches:
            arrays = [batch.column(i) for i in range(len(keep))] + make(codec, batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *(n for n, _ in new)])

    kept = df.select(*(F.col(c) for c in keep), F.col(source).alias("_source"))
    return kept.mapInArrow(run, with_fields(df, keep, new))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The id column and ids: the packed little-endian unsigned 32-bit ids of each whole text. A null text is empty."""
    return _mapped(df, [id_col], text_col, [("ids", T.BinaryType())], read_vocabulary(path), lambda codec, texts: [pa.array([codec.encode(t or "") for t in texts], pa.binary())])


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """The id column and text: the decoded text of packed ids, special tokens included. Null ids are none."""
    return _mapped(df, [id_col], ids_col, [("text", T.StringType())], read_vocabulary(path), lambda codec, all_ids: [pa.array([codec.decode(x or b"") for x in all_ids], pa.string())])


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The id column, ids as encode() gives them, and decoded: what decode() makes of them.

    Null and empty texts have no ids and decode to the empty text. Texts of any length are encoded whole, a bounded
    number of pre-tokens at a time. Repeated rows give repeated rows; a null id stays null.
    """

    def make(codec, texts):
        ids = [codec.encode(t or "") for t in texts]
        return [pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.string())]

    return _mapped(df, [id_col], text_col, [("ids", T.BinaryType()), ("decoded", T.StringType())], read_vocabulary(path), make)


def unpacked(ids):
    """Packed ids of at most a few thousand tokens as array<bigint>."""
    byte = lambda i, k: F.conv(F.hex(F.substring(ids, 4 * i + k + 1, 1)), 16, 10).cast("long")
    count = (F.length(ids) / 4).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: byte(i, 0) + 256 * byte(i, 1) + 65536 * byte(i, 2) + 16777216 * byte(i, 3))).otherwise(F.array().cast("array<bigint>"))


def op1_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    made = round_trip(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
