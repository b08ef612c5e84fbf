"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates all pieces that end at each character; dynamic programming carries the best score
and its number of pieces. Ties go to the earliest start, as in the tokenizers library's unigram model; a character that
no piece covers alone is unknown, at the least score less UNKNOWN_PENALTY, and unknown characters side by side are one.

The box holds no unigram tokenizer. The pieces and scores of the public sentencepiece vocabulary are read as one; its
control, unknown and byte pieces never match text.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small_batches, table

UNKNOWN_PENALTY = 10.0
SPACE = "▁"
#: Words whose counts a worker remembers in each of two generations, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 500_000, 64
NO_MATCH = (-1, (0, 0.0))


def read_vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file of the driver; by default of the public one."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in usable]


class Counter(dict):
    """Counts of words met so far: (pieces, score, begins with an unknown character, ends with one)."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        super().__init__()
        self.older: dict = {}
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max((len(p) for p, _ in vocabulary), default=1)
        self.unknown = min(0.0, *(s for _, s in vocabulary)) - UNKNOWN_PENALTY
        # Words part before a space mark that follows another character, if no piece reaches across such a place.
        across = any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in vocabulary)
        self.words = re.compile(r"(?s).+" if across else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def best(self, text: str) -> tuple[int, float, bool, bool]:
        # Pieces are no longer than the longest one, so only so many places back are held, however long the text.
        width, unknown = min(self.longest, len(text)) + 1, self.unknown
        held: list = [(0, 0.0, False, False)] * width
        matches = self.automaton.iter(text)
        at, (length, value) = next(matches, NO_MATCH)
        for end in range(len(text)):
            best, alone = -math.inf, False
            while at == end:  # matches of one end come with the earliest start first
                pieces, score, first, last = held[(end - length) % width]
                if length == 1:
                    alone = True
                if score + value > best:
                    best, made = score + value, (pieces + 1, score + value, first and length <= end, False)
                at, (length, value) = next(matches, NO_MATCH)
            if not alone:
                pieces, score, first, last = held[(end - 1) % width]
                if score + unknown > best:
                    made = (pieces + (not last), score + unknown, first or not end, True)
            held[end % width] = made
        return held[(len(text) - 1) % width]

    def __missing__(self, word: str):
        found = self.older.get(word) or self.best(word)
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def count(self, text: str | None) -> tuple[int, float]:
        """Pieces and score of a whole text, with a space mark before it and for each space; an empty one has none."""
        total, score, open_end = 0, 0.0, False
        for m in self.words.finditer(SPACE + text.replace(" ", SPACE)) if text else ():
            pieces, value, begins, ends = self[m.group()]
            total, score = total + pieces - (open_end and begins), score + value
            open_end = ends
        return total, score


_counters: dict[int, Counter] = {}


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and score of every row's whole text. Null and empty texts have no tokens; repeated rows count alike;
    an empty table gives an empty one."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))  # one vocabulary of a fixed size

    def run(batches):
        key = hash(tuple(shared.value))
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(shared.value)
        for batch in batches:
            made = [_counters[key].count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array(np.array([s for _, s in made], "f8"))], names=["doc_id", "n_tokens", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, score double")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
