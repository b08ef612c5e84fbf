"""Shares of kinds of characters in parts of texts, computed over a whole Arrow batch at once."""

from __future__ import annotations

import numpy as np

#: Kinds of bytes, by their place in a feature row.
KINDS = ("lower", "upper", "digit", "space", "stop", "exclaim", "pipe", "symbol", "other", "lead", "tail", "control")
FEATURES = (*KINDS, "log_bytes", "log_words", "word_length", "one_space_words")


def _kind_of_bytes() -> np.ndarray:
    kind = np.full(256, KINDS.index("other"), "i8")
    for name, members in (
        ("lower", range(ord("a"), ord("z") + 1)), ("upper", range(ord("A"), ord("Z") + 1)), ("digit", range(ord("0"), ord("9") + 1)),
        ("control", [*range(9), *range(14, 32), 127]), ("space", b" \t\n\v\f\r"), ("stop", b".,;:?"), ("exclaim", b"!"), ("pipe", b"|"),
        ("symbol", b"#*$%&<>@=_~^\\/{}[]+`"), ("lead", range(0xC0, 0x100)), ("tail", range(0x80, 0xC0)),
    ):
        kind[list(members)] = KINDS.index(name)
    return kind


KIND_OF = _kind_of_bytes()
#: Bytes that are counted at a time, unless one part alone is longer.
STRIDE = 1 << 20
_SPACE = KINDS.index("space")


def features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each part of data, a part reaching from its start to the next one's (the last to the end).

    starts ascend and may repeat: such a part is empty and gets the row of an empty text.
    """
    if len(data) > STRIDE and len(starts) > 1:
        cuts = np.unique(np.searchsorted(starts, np.arange(0, len(data), STRIDE)))
        cuts = np.r_[0, cuts[(cuts > 0) & (cuts < len(starts))], len(starts)]
        ends = np.r_[starts, len(data)]
        return np.concatenate([features(data[ends[a] : ends[b]], starts[a:b] - ends[a]) if b - a < len(starts) else _features(data, starts) for a, b in zip(cuts, cuts[1:], strict=False)])
    return _features(data, starts)


def _features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n, width = len(starts), len(KINDS)
    lengths = np.diff(np.r_[starts, len(data)])
    kinds = KIND_OF[data]
    part = np.repeat(np.arange(n), lengths)
    counts = np.bincount(part * width + kinds, minlength=n * width).reshape(n, width).astype("f8")
    spaced = kinds == _SPACE
    first = np.zeros(len(data), bool)
    first[starts[lengths > 0]] = True
    begins = ~spaced & (first | np.r_[True, spaced[:-1]]) if len(data) else spaced
    words = np.bincount(part[begins], minlength=n).astype("f8")
    ink = counts.sum(1) - counts[:, _SPACE] - counts[:, KINDS.index("tail")]
    shares = counts / np.maximum(1, ink)[:, None]
    return np.column_stack([shares, np.log1p(lengths), np.log1p(words), ink / np.maximum(1, words), words / np.maximum(1, counts[:, _SPACE] + 1)])


def buffers(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The texts as bytes (null: empty), all of them in one array, and where each begins there."""
    raw = [(t or "").encode() for t in texts]
    begins = np.r_[0, np.cumsum([len(r) for r in raw])].astype("i8")
    return raw, np.frombuffer(b"".join(raw), "u1"), begins[:-1]


class Scaler:
    """Brings features to mean 0 and deviation 1, within some deviations."""

    def __init__(self, rows: np.ndarray) -> None:
        self.mean, self.scale = rows.mean(0), np.maximum(rows.std(0), 1e-6)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -6, 6)


def adam(parameters: list[np.ndarray], gradients, steps: int, rate: float) -> list[np.ndarray]:
    """Minimizes by Adam; gradients(parameters, step) gives the gradient of each parameter."""
    parameters = [p.astype("f8").copy() for p in parameters]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for t in range(1, steps + 1):
        for p, g, m, v in zip(parameters, gradients(parameters, t), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return parameters
