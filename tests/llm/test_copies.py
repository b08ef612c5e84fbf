"""The pipeline's near copies against brute force on the exact Jaccard similarity of five-word shingles."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from millrace.llm import copies as near


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_heads(rows):
    sets = [plain_shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and 5 * len(a & b) >= 4 * len(a | b):
                group[root(i)] = root(j)
    heads: dict = {}
    for i, (k, _) in enumerate(rows):
        heads[root(i)] = min(heads.get(root(i), k), k)
    return sorted(heads.values())


def test_near_dedup_finds_all_at_four_fifths(spark):
    """Only one of the five pairs of sf0.01 lies within four bits."""
    sf_dir = "/root/testdata/sf0.01"
    stage = corpus_pipeline.STAGES[2][1]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = stage(spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in made.collect()) == plain_heads([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize(("seed", "list_rows"), [(1, 1024), (2, 1024), (3, 4)])
def test_near_dedup_groups(spark, monkeypatch, seed, list_rows):
    """Loose groups about a middle that is no member, chains, texts just above and below the line, short and empty ones."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(100_000)}"
    texts = [None, "", " \n", "one two", "One  two", "one two three", "a b c d e f", "a b c d e f g"]
    for n, copies, edits in ((60, 30, 1), (200, 30, 4), (200, 15, 8), (30, 20, 1)):
        base = [word() for _ in range(n)]
        for _ in range(copies):
            text = list(base)
            for _ in range(edits):
                text[r.randrange(n)] = word()
            texts.append(" ".join(text))
    walk = [word() for _ in range(150)]
    for _ in range(40):
        walk[r.randrange(150)] = word()
        texts.append(" ".join(walk))
    walk = [word() for _ in range(104)]
    texts += [" ".join(walk), " ".join(walk[:84]), " ".join([word() for _ in range(100)] + walk[:4])]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    monkeypatch.setattr(near.heads, "__defaults__", (list_rows,))
    made = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(x["doc_id"] for x in made.collect()) == plain_heads(rows)
