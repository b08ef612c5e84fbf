"""Quality rules: counts over words and lines, and a line labeller.

A linear-chain conditional random field over a text's lines marks each as content or boilerplate; Viterbi decoding finds
the likeliest marks of all lines together. The share of words that lie in content lines decides whether a text is kept.
The field is trained on a bounded sample of documents with quality labels: at first all lines of a document bear its
label, then the lines of low documents are marked anew by the field itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import kept_rows, slim, small_batches, table
from millrace.llm.shapes import FEATURES, Scaler, adam, buffers, features

#: Fixed values of the base rules.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = "#*$%&|<>", 3, 50, 50
WHITE = " \t\n\v\f\r"
#: Labelled documents that the field is trained on at most: those whose ids hash lowest; and their bytes.
TRAINING_DOCS, TRAINING_BYTES = 2000, 32 << 20
#: Longer texts are trained on as several chains of so many lines.
CHAIN_LINES = 64
#: First characters of a text that tell it from others of the same id, with its hash.
TOLD_CHARS = 64
#: Least share of words in content lines of a kept text.
CONTENT_SHARE = 0.5
#: Places of lines that one decoding step lays out together, unless one text alone has more lines.
CELLS = 1 << 18
STEPS, RATE, RIDGE = 80, 0.08, 1e-3
#: Features of a line that the field doesn't look at: its length, in which clean texts differ freely.
UNSEEN = [FEATURES.index("log_bytes"), FEATURES.index("log_words")]
BOILERPLATE, CONTENT = 0, 1


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that are found twice or more in the text, first finds included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], "i8")
    key = ids[:n].copy()
    for k in range(1, window):
        # pairs are numbered anew, so that keys stay small and exact however many words there are
        key = key * len(number) + ids[k : n + k]
        if k + 1 < window and len(number) > 1 << 20:
            key = np.unique(key, return_inverse=True)[1]
    _, place, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times[place] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : n + k] |= again
    return int(covered.sum())


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; a null text has none."""
    text = text or ""
    words = text.encode().split()  # exactly [^\x20\x09-\x0D]+
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            again += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), again, repeated_words(words)


def lines_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, each line's words, and the number of the first line of each text (and the end)."""
    raw, data, begins = buffers(texts)
    breaks = np.flatnonzero(data == 0x0A)
    # a text opens a line, and so does each line feed, for the text that it stands in
    owner = np.r_[np.arange(len(raw)), np.searchsorted(begins, breaks, "right") - 1]
    starts = np.r_[begins, breaks + 1]
    order = np.lexsort((starts, owner))
    owner, starts = owner[order], starts[order]
    shape = features(data, starts)
    words = np.rint(np.expm1(shape[:, FEATURES.index("log_words")])).astype("i8")
    first = np.searchsorted(owner, np.arange(len(raw) + 1))
    repeat = np.zeros(len(starts))
    ends = np.r_[starts[1:], len(data)]
    for t in range(len(raw)):
        seen: set = set()
        for i in range(first[t], first[t + 1]):
            line = data[starts[i] : ends[i]].tobytes().rstrip(b"\n")
            repeat[i] = float(line in seen and words[i] > 0)
            seen.add(line)
    edge = np.zeros(len(starts))
    edge[first[:-1]] = 1
    return np.column_stack([np.delete(shape, UNSEEN, 1), repeat, edge]), words, first


def padded(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of values laid out as (text, line), and the mask of the places that are lines."""
    sizes = np.diff(first)
    mask = np.arange(sizes.max(initial=1))[None, :] < sizes[:, None]
    out = np.zeros((*mask.shape, *values.shape[1:]))
    out[mask] = values
    return out, mask


@dataclass
class Field:
    """A linear-chain conditional random field with two states."""

    scaler: Scaler
    weights: np.ndarray  # (features + 1, 2)
    moves: np.ndarray  # (2, 2), from and to

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        x = self.scaler(rows)
        return x @ self.weights[:-1] + self.weights[-1]

    def decode(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The likeliest states of all lines (Viterbi; ties go to content). Texts of like length are decoded together."""
        scores, sizes, states = self.emissions(rows), np.diff(first), np.zeros(len(rows), "i1")
        order, at = np.argsort(-sizes, kind="stable"), 0
        while at < len(order):
            some = order[at : at + max(1, CELLS // sizes[order[at]])]
            lines = np.concatenate([np.arange(first[t], first[t + 1]) for t in some])
            states[lines] = self._decoded(scores[lines], np.r_[0, np.cumsum(sizes[some])])
            at += len(some)
        return states

    def _decoded(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        scores, mask = padded(scores, first)
        texts, most = mask.shape
        best, back = scores[:, 0].copy(), np.zeros((texts, most, 2), "i1")
        for t in range(1, most):
            through = best[:, :, None] + self.moves[None]
            came = np.where(through[:, CONTENT] >= through[:, BOILERPLATE], CONTENT, BOILERPLATE)
            step = np.take_along_axis(through, came[:, None, :], 1)[:, 0] + scores[:, t]
            on = mask[:, t]
            best[on], back[on, t] = step[on], came[on]
        states = np.zeros((texts, most), "i1")
        now = np.where(best[:, CONTENT] >= best[:, BOILERPLATE], CONTENT, BOILERPLATE)
        for t in range(most - 1, -1, -1):
            on = mask[:, t]
            states[on, t] = now[on]
            if t:
                now = np.where(on, back[np.arange(texts), t, now], now)
        return states[mask]


def expectations(scores: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By forward and backward sums over chains of lines: each line's chances of the states (0 where there is no line),
    and each chain's expected numbers of moves. Sums are kept to 1 step by step instead of taking logarithms."""
    chains, most, _ = scores.shape
    weigh, step = np.exp(scores - scores.max(2, keepdims=True)), np.exp(moves - moves.max())
    ahead, behind, norm = np.empty_like(weigh), np.ones_like(weigh), np.ones((chains, most))
    ahead[:, 0] = weigh[:, 0] / weigh[:, 0].sum(1, keepdims=True)
    for t in range(1, most):
        now = ahead[:, t - 1] @ step * weigh[:, t]
        norm[:, t] = now.sum(1)
        ahead[:, t] = np.where(mask[:, t, None], now / norm[:, t, None], ahead[:, t - 1])
    for t in range(most - 2, -1, -1):
        now = (weigh[:, t + 1] * behind[:, t + 1]) @ step.T / norm[:, t + 1, None]
        behind[:, t] = np.where(mask[:, t + 1, None], now, 1)
    states = ahead * behind
    states *= mask[:, :, None] / states.sum(2, keepdims=True)
    later = weigh[:, 1:] * behind[:, 1:] * (mask[:, 1:] / norm[:, 1:])[:, :, None]
    return states, np.matmul(ahead[:, :-1].transpose(0, 2, 1), later) * step


def train_field(rows: np.ndarray, first: np.ndarray, labels: np.ndarray, weight: np.ndarray, steps: int = STEPS) -> Field:
    """Maximum likelihood over all texts together; weight is each text's."""
    scaler = Scaler(rows)
    x, mask = padded(np.column_stack([scaler(rows), np.ones(len(rows))]), first)
    y, _ = padded(labels.astype("f8"), first)
    truth = np.stack([1 - y, y], 2) * mask[:, :, None]
    true_moves = np.einsum("n,nab->ab", weight, np.matmul((truth[:, :-1] * mask[:, 1:, None]).transpose(0, 2, 1), truth[:, 1:]))
    total = (weight[:, None] * mask).sum()
    flat = x.reshape(-1, x.shape[2])

    def gradients(parameters, _):
        weights, moves = parameters
        states, moved = expectations((flat @ weights).reshape(*mask.shape, 2), moves, mask)
        off = ((states - truth) * weight[:, None, None]).reshape(-1, 2)
        return [flat.T @ off / total + RIDGE * weights, (np.einsum("n,nab->ab", weight, moved) - true_moves) / total + RIDGE * moves]

    weights, moves = adam([np.zeros((x.shape[2], 2)), np.zeros((2, 2))], gradients, steps, RATE)
    del x, flat, truth
    slim()
    return Field(scaler, weights, moves)


def fit(texts: list[str | None], quality: np.ndarray, steps: int = STEPS) -> Field | None:
    """The field for labelled texts; none if they don't bear both labels."""
    if len(set(quality.tolist())) < 2:
        return None
    rows, _, begins = lines_of(texts)
    chains = [np.arange(a, b, CHAIN_LINES) for a, b in zip(begins, begins[1:], strict=False)]
    first = np.r_[np.concatenate(chains), len(rows)]
    quality = np.repeat(quality, [len(c) for c in chains])
    of_line = np.repeat(quality, np.diff(first))
    field = train_field(rows, first, of_line, np.ones(len(quality)), steps)
    again = np.where(of_line == 1, CONTENT, field.decode(rows, first))
    # Chains of low documents in which no line looks like boilerplate have no say the second time.
    found = np.array([q == 1 or (again[a:b] == BOILERPLATE).any() for q, a, b in zip(quality, first, first[1:], strict=False)])
    return train_field(rows, first, again, found.astype("f8"), steps) if found[quality == 0].any() else field


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = TRAINING_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[list, np.ndarray]:
    """Whole texts and labels 0 or 1 of labelled documents: those whose ids hash lowest, at most `most` of them and no
    more than hold most_bytes together (the first is taken whatever its size). Rows that lack an id, or a label of 0 or
    1, are passed over; an id with both labels counts twice, and of repeated ids the text that is last by its first
    characters is taken.

    Ids are thinned by their hash before they are ordered, so that not much more than `most` reach the last task.
    """
    marks = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).filter(F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 32))
    thinned = marks.filter(place < math.ceil((1 << 32) * min(1.0, (2 * most + 1000) / max(1, marks.count()))))
    chosen = thinned.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi").distinct().orderBy(place, "_id", "_label").limit(most)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    # Texts themselves wait until their sizes have chosen them: one task orders the sizes, and long texts don't fit there.
    told = F.struct(F.substring("_text", 1, TOLD_CHARS), F.col("_hash").alias("hash"), F.octet_length("_text").alias("bytes"))
    one = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.max(told).alias("_told")).select("_id", "_label", F.col("_told.hash").alias("_hash"), F.col("_told.bytes").alias("_bytes"))
    so_far = F.sum(F.coalesce("_bytes", F.lit(0)) + 1).over(Window.orderBy(place, "_id", "_label").rowsBetween(Window.unboundedPreceding, -1))
    fit_in = one.withColumn("_before", F.coalesce(so_far, F.lit(0))).filter(F.col("_before") + F.when(F.col("_before") > 0, F.col("_bytes")).otherwise(0) <= most_bytes)
    rows = texts.join(F.broadcast(fit_in.select("_id", "_label", "_hash")), ["_id", "_hash"]).groupBy("_id", "_label").agg(F.max("_text").alias("_text")).collect()
    rows = sorted(rows, key=lambda r: (r["_id"], r["_label"], r["_text"] or ""))
    return [r["_text"] for r in rows], np.array([r["_label"] for r in rows], "i8")


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def verdicts(texts: list[str | None], field: Field | None, content_share: float = CONTENT_SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts (NAMES), whether the base rules fail, content share and whether it is kept, of each text."""
    counted = np.array([counts(t) for t in texts], "i8").reshape(-1, len(NAMES))
    rows, words, first = lines_of(texts)
    states = field.decode(rows, first) if field is not None else np.full(len(words), CONTENT)
    share = np.add.reduceat(np.where(states == CONTENT, words, 0), first[:-1]) / np.maximum(1, np.add.reduceat(words, first[:-1]))
    failed = (counted[:, 0] < LEAST_WORDS) | (100 * counted[:, 4] > MOST_REPEATED_PERCENT * counted[:, 0])
    return counted, failed, share, ~failed & (share >= content_share)


def judge(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text", content_share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id, the counts, base_failed, content_share and kept of every row.

    A null text has no words and fails the base rules, as an empty one does. Without a field all lines are content.
    A long text is read whole. Repeated rows are judged each alike. An empty table gives an empty one; other columns are
    not looked at.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # some hundred numbers

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                counted, failed, share, kept = verdicts(batch.column(1).to_pylist(), shared.value, content_share)
                columns = [batch.column(0), *(pa.array(counted[:, i]) for i in range(len(NAMES))), pa.array(failed), pa.array(share), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *NAMES, "base_failed", "content_share", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, {', '.join(n + ' long' for n in NAMES)}, base_failed boolean, content_share double, kept boolean")


def keep(docs: DataFrame, field: Field | None, text_col: str = "text", content_share: float = CONTENT_SHARE) -> DataFrame:
    """The rows that judge() keeps, with all their columns. Rows stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return kept_rows(docs, text_col, lambda texts: verdicts(texts, shared.value, content_share)[3])


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = fit(*training_sample(docs, table(spark, sf_dir, "labels"), "quality", TRAINING_DOCS))
    return judge(docs, field).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")
