"""Records from chunks of bytes, and file streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.errors import ParserError


@dataclass
class Diagnostics:
    """Warnings and counts that a parser leaves behind; drain() takes them."""

    warnings: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)

    def warn(self, text: str) -> None:
        self.warnings.append(text)

    def count(self, name: str, n: int = 1) -> None:
        self.counts[name] = self.counts.get(name, 0) + n

    def drain(self) -> tuple[list[str], dict[str, int]]:
        out = self.warnings, self.counts
        self.warnings, self.counts = [], {}
        return out


class RecordStream:
    """Feed bytes as they come; whole records come out. The end must be told, and no record may be cut short by it.

    parse(buffer, at_end, diagnostics) gives a record and how many bytes it took, or None if it needs more. What it passes
    over it tells the diagnostics, which the caller drains.
    """

    def __init__(self, parse: Callable[..., tuple[dict, int] | None], diagnostics: Diagnostics | None = None) -> None:
        self.parse, self.buffer, self.ended = parse, b"", False
        self.diagnostics = diagnostics if diagnostics is not None else Diagnostics()

    def feed(self, chunk: bytes) -> list[dict]:
        if self.ended:
            raise ParserError("the stream has ended")
        self.buffer += chunk
        return self._taken(False)

    def finish(self) -> list[dict]:
        self.ended = True
        out = self._taken(True)
        if self.buffer:
            raise ParserError("the input ends inside a record")
        return out

    def _taken(self, at_end: bool) -> list[dict]:
        out = []
        while self.buffer and (found := self.parse(self.buffer, at_end, self.diagnostics)) is not None:
            out.append(found[0])
            self.diagnostics.count("records")
            self.buffer = self.buffer[found[1] :]
        return out


def frames(buffer: bytes, at_end: bool, diagnostics: Diagnostics | None = None) -> tuple[dict, int] | None:
    """@<length>:k=v|k=v frames."""
    head, colon, rest = buffer.partition(b":")
    if not head.startswith(b"@") or colon and not head[1:].isdigit() or not colon and len(head) > 20:
        raise ParserError("a frame must begin with @<length>:")
    if not colon or len(rest) < int(head[1:]):
        return None
    body = rest[: int(head[1:])].decode()
    pairs = [p.partition("=") for p in body.split("|")]
    if any(not sign for _, sign, _ in pairs):
        raise ParserError("a frame holds k=v pairs only")
    return {k: v for k, _, v in pairs}, len(head) + 1 + int(head[1:])


def kv_lines(buffer: bytes, at_end: bool, diagnostics: Diagnostics | None = None) -> tuple[dict, int] | None:
    """k=v lines; tokens without a separator are passed over and counted."""
    line, feed, _ = buffer.partition(b"\n")
    if not feed and not at_end:
        return None
    tokens = line.decode().rstrip("\r").split(" ")
    if diagnostics is not None and (passed := sum(bool(t) and "=" not in t for t in tokens)):
        diagnostics.count("discarded_tokens", passed)
        diagnostics.warn(f"{passed} tokens without a separator")
    return dict(t.split("=", 1) for t in tokens if "=" in t), len(line) + len(feed)


def stream_records(spark: SparkSession, folder: str, parser: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A streaming DataFrame of records of all files in a folder, now and later; for formats of one line a record."""
    raw = spark.readStream.option("lineSep", "\n").text(folder)
    rows = raw.select(F.col("_metadata.file_path").alias("_file"), F.lit(0).cast("long").alias("_pos"), F.regexp_replace("value", "\r$", "").alias("line"))
    return parser(rows)


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there now as Parquet, exactly once, and ends."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
