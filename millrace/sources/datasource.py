"""A Python data source of text records in files that workers can open, cut between records, in batches or as a stream."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from millrace.sources.splitting import LOOK_BACK, Boundaries, planned_parts

#: Bytes that are read at a time beyond a part's end to complete its last record.
AHEAD = 64 << 10


class Part(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def boundaries_of(options: dict) -> Boundaries:
    """From the options blankLine (true), continuation (a character) and comments (prefixes between blanks)."""
    held = {k.lower(): v for k, v in options.items()}
    return Boundaries(blank_line=held.get("blankline", "false").lower() == "true", continuation=held.get("continuation") or None, comments=tuple(held.get("comments", "").split()))


def records(part: Part, boundaries: Boundaries) -> Iterator[tuple[str]]:
    """A part's records are those that begin in it; the last one is read to its end beyond the part. Blank ones are left out."""
    with open(part.path, "rb") as f:
        low = max(0, part.start - LOOK_BACK)
        f.seek(low)
        data = f.read(part.end - low)
        at = boundaries.next(data, part.start - low)
        while at < part.end - low:
            end = boundaries.next(data, at + 1)
            while end >= len(data) and (more := f.read(AHEAD)):
                data += more
                end = boundaries.next(data, at + 1)
            text = data[at:end].decode().rstrip("\r\n")
            if text.strip():
                yield (text,)
            at = end


def complete(path: str, boundaries: Boundaries) -> int:
    """Up to where a growing file holds whole records: the begin of its last record, or its end if lines are records and
    the last one is closed."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        reach = LOOK_BACK
        while True:
            low = max(0, size - reach)
            f.seek(low)
            data = f.read(size - low)
            if data.endswith(b"\n") and not boundaries.blank_line and not boundaries.continuation:
                return size
            last, at = 0, boundaries.next(data, 1)
            while at < len(data):
                last, at = at, boundaries.next(data, at + 1)
            if last or not low:
                return low + last
            reach *= 2


class _Reader(DataSourceReader):
    """Parts of partbytes, or else as many as planned_parts() has for the option threads."""

    def __init__(self, options: dict) -> None:
        self.path, self.boundaries = options["path"], boundaries_of(options)
        self.size, self.threads = int(options.get("partbytes", 0)), int(options.get("threads", 8))

    def partitions(self):
        n = os.path.getsize(self.path)
        size = self.size or max(1, -(-n // planned_parts(n, self.threads)))
        return [Part(self.path, a, min(n, a + size)) for a in range(0, max(1, n), size)]

    def read(self, partition):
        return records(partition, self.boundaries)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size, self.boundaries = options["path"], int(options.get("partbytes", 16 << 20)), boundaries_of(options)

    def initialOffset(self):
        return {"at": 0}

    def latestOffset(self):
        return {"at": complete(self.path, self.boundaries)}

    def partitions(self, start, end):
        return [Part(self.path, a, min(end["at"], a + self.size)) for a in range(start["at"], end["at"], self.size)]

    def read(self, partition):
        return records(partition, self.boundaries)

    def commit(self, end):
        pass


class RecordLines(DataSource):
    """spark.read.format("millrace_lines").load(path), or readStream: column line, which holds a whole record.

    Of a stream, a record is delivered once it is known to be complete.
    """

    @classmethod
    def name(cls):
        return "millrace_lines"

    def schema(self):
        return "line string"

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)
