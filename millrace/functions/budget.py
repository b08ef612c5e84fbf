"""Memory budgets and the choice of a reading mode."""

from __future__ import annotations

import math
import re
import time
from contextlib import contextmanager
from dataclasses import dataclass

from millrace.errors import MillraceError

#: Bytes of the units of a memory text.
UNITS = {"": 1, "b": 1} | {p + end: base**n for n, p in enumerate("kmgt", 1) for end, base in (("b", 1000), ("ib", 1024))}
SMALL, LARGE = 8 << 20, 100 << 20


def parse_memory(value: int | str) -> int:
    """Bytes of 65536, "64MiB" or "1.5 GB"; at least 1."""
    if isinstance(value, int):
        return max(1, value)
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", str(value))
    if not m or m[2].lower() not in UNITS:
        raise MillraceError(f"invalid memory size {value!r}; 64000000, '64MiB' and '1.5 GB' are valid")
    return max(1, math.floor(float(m[1]) * UNITS[m[2].lower()]))


def resolve_engine(file_size: int, memory: int | None = None, threads: int = 1, schema: bool = False, has_parallel: bool = True, has_columnar: bool = True) -> str:
    """Name of the reading mode for a file. Spark plans its tasks by itself; the name is for those who ask."""
    if threads == 0:
        raise ValueError("threads must not be 0")
    if memory is not None:
        return "parallel_streaming" if threads > 1 else "stream"
    if threads > 1:
        return "parallel_streaming" if file_size >= LARGE else "parallel"
    if schema and file_size >= LARGE:
        return "stream"
    if file_size < SMALL:
        return "columnar" if has_columnar else "stream"
    return "parallel" if has_parallel else "stream"


@dataclass
class StreamStats:
    """What a batch stream has delivered."""

    batches: int = 0
    rows: int = 0
    oversize_batches: int = 0
    peak_tracked_bytes: int = 0

    def add(self, batch, budget: int | None, strict: bool, held: int = 0) -> None:
        """Counts a batch that is handed out while `held` other bytes wait."""
        size = batch.nbytes
        self.batches, self.rows, self.peak_tracked_bytes = self.batches + 1, self.rows + batch.num_rows, max(self.peak_tracked_bytes, size + held)
        if budget is not None and size > budget:
            self.oversize_batches += 1
            if strict:
                raise MemoryError(f"a batch of {size} bytes is beyond the budget of {budget}")


class Profile:
    """Seconds and calls of named steps, as long as it is open: with Profile() as p: ...; p.snapshot()."""

    _open: list[Profile] = []

    def __init__(self) -> None:
        self.spent: dict[str, list[float]] = {}

    def __enter__(self) -> Profile:
        Profile._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Profile._open.remove(self)

    def snapshot(self) -> list[tuple[str, float, int]]:
        return [(name, seconds, int(calls)) for name, (seconds, calls) in self.spent.items()]


@contextmanager
def timed(name: str):
    """Accounts a step to every open profile; without one it costs a comparison."""
    began = time.perf_counter() if Profile._open else 0.0
    try:
        yield
    finally:
        for p in Profile._open:
            at = p.spent.setdefault(name, [0.0, 0])
            at[0] += time.perf_counter() - began if began else 0.0
            at[1] += 1
