"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_BYTES. A passage is encoded by its content: its byte grams are hashed into
buckets that each have a learnt embedding, and counted as known or not from good and from bad training texts. A gated
attention, learnt from the documents' labels alone, weighs the passages; the weighted sum of their encodings is scored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import held_out, kept_rows, slim, small_batches, table
from millrace.llm.rules import training_sample
from millrace.llm.shapes import Scaler, adam, buffers

PASSAGE_BYTES = 384
#: Labelled documents that the network is trained on at most: those whose ids hash lowest.
TRAINING_DOCS = 4000
#: Sizes of a passage's encoding and of the attention's hidden layer.
ENCODED, HIDDEN = 16, 8
STEPS, RATE, RIDGE, SEED, BATCH = 300, 0.02, 1e-4, 7, 256
#: Passages of a long document that one step of the training looks at, chosen anew each time.
CHOSEN_PASSAGES = 32
#: Bytes of a gram that is embedded and of one that is known or not; buckets of the embedding, cells of the known ones.
EMBEDDED, KNOWN, BUCKETS, CELLS = 3, 4, 512, 1 << 20
#: One in so many good training texts is shown in disorder as a bad one, and how much of it; the label that marks these.
NOISE_SHARE, NOISE_CHARS, NOISE = 8, 1 << 14, 2
#: Bytes of passages that are encoded at a time, unless one text alone is longer.
STRIDE = 1 << 19


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def neighbours(data: np.ndarray, starts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Of each passage, the share of words whose letters' sum equals that of the word before: words said again and again.
    texts: where texts that aren't empty begin."""
    n = len(starts)
    part = np.repeat(np.arange(n), np.diff(np.r_[starts, len(data)]))
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    after = np.r_[True, white[:-1]] if len(data) else white
    after[texts] = True
    begins = np.flatnonzero(~white & after)
    if len(begins) < 2:
        return np.zeros(n)
    place = np.arange(len(data)) - np.r_[0, begins][np.searchsorted(begins, np.arange(len(data)), "right")]
    sums = np.add.reduceat(np.where(white, 0, data.astype("i8") * (2 * place + 1)), begins)
    same = np.r_[False, (sums[1:] == sums[:-1]) & (part[begins[1:]] == part[begins[:-1]])]
    return np.bincount(part[begins], same, n) / np.maximum(1, np.bincount(part[begins], minlength=n))


def hashed(data: np.ndarray, size: int, cells: int, ends: np.ndarray) -> np.ndarray:
    """The cell of the gram of `size` bytes that begins at each byte; beyond the ends of texts (ascending) are zeros."""
    gram = np.zeros(len(data), "u8")
    for i in range(size):
        gram = gram << np.uint64(8)
        gram[: len(data) - i] |= data[i:]
    begins = np.r_[0, ends[:-1]]
    for held in range(1, size):
        at = (ends - held)[ends - held >= begins]
        gram[at] &= np.uint64((1 << 8 * size) - (1 << 8 * (size - held)))
    return (gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - cells.bit_length())).astype("i4")


def known_cells(texts: list[str | None], labels: np.ndarray) -> np.ndarray:
    """In how many texts of label 0 and of label 1 the grams of each cell are found, up to 255."""
    seen = np.zeros((2, CELLS), "u1")
    for text, label in zip(texts, labels.tolist(), strict=True):
        data = np.frombuffer((text or "").encode(), "u1")
        cells = np.unique(hashed(data, KNOWN, CELLS, np.array([len(data)])))
        seen[label, cells] += seen[label, cells] < 255
    return seen


def strides(texts: list[str | None], most: int = STRIDE) -> Iterator[tuple[int, int]]:
    """Where parts of a list begin and end whose texts hold `most` characters together at most, unless one alone is longer."""
    at, ends = 0, np.cumsum([len(t or "") + 1 for t in texts])
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, upto
        at = upto


def counted(texts: list[str | None], known: np.ndarray, own: np.ndarray | None = None, size: int = PASSAGE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Plain values, counts by bucket and bytes (1 at least) of all passages of the whole texts, and the number of each
    text's first (and the end). An empty text has one passage. own: the labels of texts that known_cells() has seen,
    which then don't count for themselves."""
    raw, data, begins = buffers(texts)
    each = np.array([max(1, -(-len(r) // size)) for r in raw], "i8")
    first = np.r_[0, np.cumsum(each)]
    starts = np.repeat(begins, each) + size * (np.arange(first[-1]) - np.repeat(first[:-1], each))
    n, lengths = len(starts), np.diff(np.r_[starts, len(data)])
    part = np.repeat(np.arange(n), lengths)
    ends, heard = begins + np.array([len(r) for r in raw], "i8"), np.maximum(1, lengths)
    cells = hashed(data, KNOWN, CELLS, ends)
    least = np.ones((2, len(data)), "u1")
    if own is not None:
        of_byte = np.repeat(np.repeat(own, each), lengths)
        least += np.stack([of_byte == 0, of_byte == 1])
    shares = [np.bincount(part, known[y][cells] >= least[y], n) / heard for y in (0, 1)]
    counts = np.bincount(part * BUCKETS + hashed(data, EMBEDDED, BUCKETS, ends), minlength=n * BUCKETS).reshape(n, BUCKETS)
    return np.column_stack([*shares, neighbours(data, starts, begins[ends > begins])]).astype("f4"), counts, heard, first


def spread(counts: np.ndarray, heard: np.ndarray) -> np.ndarray:
    """The roots of the buckets' shares of passages."""
    return np.sqrt(counts / heard[:, None], dtype="f4")


def passages(texts: list[str | None], known: np.ndarray, own: np.ndarray | None = None, size: int = PASSAGE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Values of all passages of the whole texts, plain ones and buckets' roots, and the number of each text's first (and
    the end); see counted()."""
    plain, counts, heard, first = counted(texts, known, own, size)
    return np.column_stack([plain, spread(counts, heard)]), first


#: Values of a passage before its buckets.
PLAIN = 3


@dataclass
class Scaled:
    """Brings the plain values to mean 0 and deviation 1, within some deviations, and leaves the buckets' roots of shares."""

    plain: Scaler

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The rows, changed in place."""
        rows[:, :PLAIN] = self.plain(rows[:, :PLAIN])
        rows[:, PLAIN:] *= EMPHASIS
        return rows


#: Weight of the buckets' values beside the plain ones.
EMPHASIS = 4.0


class TrainingRows:
    """The scaled values of all training passages, held as counts, which take half the bytes; rows are made as they are
    asked for."""

    def __init__(self, texts: list[str | None], known: np.ndarray, own: np.ndarray) -> None:
        self.first = np.r_[0, np.cumsum([max(1, -(-len((t or "").encode()) // PASSAGE_BYTES)) for t in texts])]
        n = int(self.first[-1])
        self.plain, self.counts, self.heard = np.empty((n, PLAIN), "f4"), np.empty((n, BUCKETS), "u2"), np.empty(n, "u2")
        for a, b in strides(texts, STRIDE // 8):  # what a stride takes comes on top of the held rows
            at = slice(self.first[a], self.first[b])
            self.plain[at], self.counts[at], self.heard[at], _ = counted(texts[a:b], known, own[a:b])
        self.scaler, self.shape = Scaled(Scaler(self.plain)), (n, PLAIN + BUCKETS)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.scaler.of(np.column_stack([self.plain[at], spread(self.counts[at], self.heard[at])]))


@dataclass
class Network:
    scaler: Scaled
    parameters: list[np.ndarray]
    known: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts, some bytes at a time."""
        out = np.zeros(len(texts))
        for at, upto in strides(texts):
            rows, first = passages(texts[at:upto], self.known)
            out[at:upto] = sigmoid(forward(self.parameters, self.scaler.of(rows), first)[0])
        return out


def forward(parameters: list[np.ndarray], x: np.ndarray, first: np.ndarray):
    """Logits of the bags, and what the gradients need."""
    encode, bias, value, gate, weigh, out, offset = parameters
    starts = first[:-1]
    bag = np.repeat(np.arange(len(starts)), np.diff(first))
    h = np.tanh(x @ encode + bias)
    v, u = np.tanh(h @ value), sigmoid(h @ gate)
    a = (v * u) @ weigh
    a = np.exp(a - np.maximum.reduceat(a, starts)[bag])
    a /= np.add.reduceat(a, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return z @ out + offset[0], (bag, h, v, u, a, z)


def gradient(parameters: list[np.ndarray], x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean logistic loss of some bags and RIDGE/2 times the parameters' squares."""
    _, _, value, gate, weigh, out, _ = parameters
    logits, (bag, h, v, u, a, z) = forward(parameters, x, first)
    d = (sigmoid(logits) - labels) / len(labels)
    dz = d[:, None] * out
    da = (dz[bag] * h).sum(1)
    ds = a * (da - np.add.reduceat(a * da, first[:-1])[bag])
    dvu = ds[:, None] * weigh
    dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
    dh = (a[:, None] * dz[bag] + dv @ value.T + du @ gate.T) * (1 - h * h)
    raw = [x.T @ dh, dh.sum(0), h.T @ dv, h.T @ du, (v * u).T @ ds, z.T @ d, d.sum(keepdims=True)]
    return [g + RIDGE * p for g, p in zip(raw, parameters, strict=True)]


def initial(width: int, rng: np.random.Generator) -> list[np.ndarray]:
    shapes = [(width, ENCODED), (ENCODED,), (ENCODED, HIDDEN), (ENCODED, HIDDEN), (HIDDEN,), (ENCODED,), (1,)]
    return [rng.normal(0, s[0] ** -0.5, s) if len(s) > 1 else rng.normal(0, 0.1, s) for s in shapes]


def train(x: np.ndarray | TrainingRows, first: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> list[np.ndarray]:
    """The parameters by logistic loss over the documents' labels, a batch of them at each step."""
    rng, sizes = np.random.default_rng(SEED), np.diff(first)

    def of_batch(parameters, _):
        chosen = rng.choice(len(labels), min(BATCH, len(labels)), replace=False)
        at = np.concatenate([np.arange(first[i], min(first[i + 1], first[i] + CHOSEN_PASSAGES)) if sizes[i] <= CHOSEN_PASSAGES else first[i] + rng.choice(sizes[i], CHOSEN_PASSAGES, replace=False) for i in chosen])
        return gradient(parameters, x[at], np.r_[0, np.cumsum(np.minimum(sizes[chosen], CHOSEN_PASSAGES))], labels[chosen])

    return adam(initial(x.shape[1], rng), of_batch, steps, RATE)


def noise(texts: list[str | None]) -> list[str]:
    """Every NOISE_SHARE-th of some good texts with the letters of each word in a random order: bad texts without a bad
    character, from which the classifier learns to look at content that it doesn't know."""
    rng, out = random.Random(SEED), []
    for text in texts[::NOISE_SHARE]:
        out.append(" ".join("".join(rng.sample(w, len(w))) for w in (text or "")[:NOISE_CHARS].split(" ")))
    return out


def fit(texts: list[str | None], labels: np.ndarray) -> Network | float:
    """The network, or the share of label 1 where the texts don't bear both labels (0.5 without any)."""
    if len(set(labels.tolist())) < 2:
        return float(labels.mean()) if len(labels) else 0.5
    known = known_cells(texts, labels)
    bad, own = noise([t for t, y in zip(texts, labels.tolist(), strict=True) if y == 1]), labels
    texts, labels, own = [*texts, *bad], np.r_[labels, np.zeros(len(bad), "i8")], np.r_[own, np.full(len(bad), NOISE)]
    rows = TrainingRows(texts, known, own)
    model = Network(rows.scaler, train(rows, rows.first, labels), (known > 0).astype("u1"))
    del rows
    slim()
    return model


def scored(texts: list[str | None], model: Network | float) -> np.ndarray:
    return np.full(len(texts), model) if isinstance(model, float) else model.scores(texts)


def classify(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) of every row's whole text. A null text is empty; an empty
    one is one passage without characters. Repeated rows score alike. An empty table gives an empty one; other columns
    are not looked at."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS bytes by label and some thousand numbers

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                scores = scored(batch.column(1).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype("i4"))], names=["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep(docs: DataFrame, model: Network | float, text_col: str = "text") -> DataFrame:
    """The rows that classify() predicts to be good, with all their columns. Rows stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, text_col, lambda texts: scored(texts, shared.value) >= 0.5)


def trained(spark, sf_dir: str) -> Network | float:
    """Fitted on labelled documents of the folds that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return fit(*training_sample(docs, labels.filter(~held_out(F.col("doc_id"), 3)), "quality", TRAINING_DOCS))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    made = classify(table(spark, sf_dir, "documents"), trained(spark, sf_dir))
    return made.select("doc_id", held_out(F.col("doc_id"), 3).alias("held_out"), "score", "predicted")
