"""Where records begin in bytes, and how to cut a file between records."""

from __future__ import annotations

from dataclasses import dataclass

#: Least bytes of a part, most parts for each thread and at all.
LEAST_PART, PER_THREAD, MOST_PARTS = 2 << 20, 16, 1024
#: How far back a region that hides boundaries is looked for.
LOOK_BACK = 64 << 10


@dataclass(frozen=True)
class Boundaries:
    """Records begin after each line feed, or after blank lines; not after a line that ends in an odd number of
    continuation characters, not at lines with a comment prefix, and not inside regions such as comments."""

    blank_line: bool = False
    continuation: str | None = None
    comments: tuple[str, ...] = ()
    regions: tuple[tuple[bytes, bytes], ...] = ()

    def next(self, data: bytes, at: int) -> int:
        """The first record start at or after a place; the length if there is none."""
        n = len(data)
        if at <= 0:
            return 0
        while at < n:
            feed = data.find(b"\n", at - 1)
            if feed < 0:
                return n
            start = feed + 1
            if start < n and self._begins(data, start):
                return start
            at = start + 1
        return n

    def _begins(self, data: bytes, start: int) -> bool:
        before = data.rfind(b"\n", 0, start - 1) + 1
        line = data[before : start - 1].removesuffix(b"\r")
        if self.blank_line and line.strip(b" \t"):
            return False
        if self.continuation:
            mark = self.continuation.encode()
            ends = len(line) - len(line.rstrip(mark))
            if ends % 2:
                return False
        if any(data.startswith(c.encode(), start) for c in self.comments):
            return False
        low = max(0, start - LOOK_BACK)
        return not any(data.rfind(a, low, start) > data.rfind(b, low, start) for a, b in self.regions)


def split(data: bytes, parts: int, boundaries: Boundaries, least: int = LEAST_PART) -> list[int]:
    """Ascending cut places from 0 to the length; each part begins with a record."""
    n = len(data)
    parts = max(1, min(parts, MOST_PARTS, n // max(1, least) or 1))
    cuts = {0, n} | {boundaries.next(data, n * k // parts) for k in range(1, parts)}
    return sorted(cuts)


def planned_parts(size: int, threads: int, streaming: bool = False, least: int = LEAST_PART) -> int:
    """How many parts a file is cut into: one for each `least` bytes, no fewer than threads, and no more than a few each."""
    most = threads * (PER_THREAD // 2 if streaming else PER_THREAD)
    return min(MOST_PARTS, max(threads, min(size // max(1, least), most)))
