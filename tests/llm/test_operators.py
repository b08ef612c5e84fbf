"""The training-data operators against brute force, and on awkward tables."""

from __future__ import annotations

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bpe, lm, packing, quality, rules, search, sharding, simhash, tokens, urls

DATA = "/root/testdata/sf0.001"
LONG = "word next " * 60_000
AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "same text here again"), (5, "same text here again"), (5, "same text here again"), (None, "no id"), (6, LONG), (7, "é 日本 <|endoftext|> | $$$ x\x85y\u2003z"), (8, "a|b|c\n" * 80)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), "x", 1) for i, t in AWKWARD], "doc_id long, text string, lang string, source string, n_chars long, row string, head int")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_bpe_like_the_library(spark, docs, real):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (docs, real):
        texts = Counter((r["doc_id"], r["text"] or "") for r in df.collect())
        made = bpe.round_trip(df)
        found = Counter()
        for (i, t), n in texts.items():
            ids = library.encode(t, add_special_tokens=False).ids
            found[(i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False))] += n
        assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in made.collect()) == found
    back = bpe.decode(bpe.encode(real))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r["doc_id"]: r["text"] for r in real.collect()}
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_bpe_remembers_two_generations(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "BLOCK", 4)
    codec, fresh = bpe.Codec(bpe.read_vocabulary()), bpe.Codec(bpe.read_vocabulary())
    text = " the cat sat on the mat with a cat" * 5
    assert codec.encode(text) == b"".join(fresh.encode(text[i:j]) for i, j in [(0, len(text))])
    assert len(codec) <= 3 and len(codec.older) <= 3


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    times = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_rules(spark, docs, real):
    made = rules.judge(docs, None).collect()
    for r in made:
        pass
    texts = {i: t for i, t in AWKWARD}
    for r in made:
        expected = plain_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected
        assert r["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
    for r in real.collect():
        assert rules.counts(r["text"]) == plain_counts(r["text"])
    assert rules.judge(docs.limit(0), None).count() == 0
    # one text of very many lines among short ones
    rng, width = np.random.default_rng(5), rules.lines_of(["a"])[0].shape[1]
    field = rules.Field(rules.Scaler(rng.normal(size=(9, width))), rng.normal(size=(width + 1, 2)), rng.normal(size=(2, 2)))
    lines = spark.createDataFrame([(i, "a b\n" * (100_000 if i == 3 else i)) for i in range(40)], "doc_id long, text string").coalesce(1)
    made = {r["doc_id"]: r["content_share"] for r in rules.judge(lines, field).collect()}
    for i in (2, 3, 39):
        rows, words, first = rules.lines_of(["a b\n" * (100_000 if i == 3 else i)])
        assert made[i] == pytest.approx(words[field.decode(rows, first) == rules.CONTENT].sum() / words.sum())


def test_lines_and_viterbi():
    texts = ["a\nb", "", "x\n", "\n\n", None, "q\nr\n"]
    rows, words, first = rules.lines_of(texts)
    assert np.diff(first).tolist() == [len((t or "").split("\n")) for t in texts]
    assert words.tolist() == [len(line.split()) for t in texts for line in (t or "").split("\n")]
    rng = np.random.default_rng(1)
    field = rules.Field(rules.Scaler(rng.normal(size=(9, rows.shape[1]))), rng.normal(size=(rows.shape[1] + 1, 2)), rng.normal(size=(2, 2)))
    got, scores = field.decode(rows, first), field.emissions(rows)
    for a, b in zip(first, first[1:], strict=False):
        n = b - a
        best = max(range(2**n), key=lambda m: sum(scores[a + t, m >> t & 1] for t in range(n)) + sum(field.moves[m >> t & 1, m >> t + 1 & 1] for t in range(n - 1)))
        assert got[a:b].tolist() == [best >> t & 1 for t in range(n)]


def test_chances_of_states_by_enumeration():
    rng = np.random.default_rng(4)
    scores, moves, lengths = rng.normal(size=(4, 5, 2)) * 3, rng.normal(size=(2, 2)), [1, 2, 5, 4]
    mask = np.arange(5)[None, :] < np.array(lengths)[:, None]
    states, moved = rules.expectations(scores, moves, mask)
    for c, n in enumerate(lengths):
        weights = {m: math.exp(sum(scores[c, t, m >> t & 1] for t in range(n)) + sum(moves[m >> t & 1, m >> t + 1 & 1] for t in range(n - 1))) for m in range(2**n)}
        whole = sum(weights.values())
        for t in range(5):
            assert states[c, t, 1] == pytest.approx(sum(w for m, w in weights.items() if m >> t & 1) / whole if t < n else 0)
        for a, b in np.ndindex(2, 2):
            assert moved[c, a, b] == pytest.approx(sum(w * sum((m >> t & 1, m >> t + 1 & 1) == (a, b) for t in range(n - 1)) for m, w in weights.items()) / whole)


def test_rules_and_classifier_tell_quality(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    kept = {r["doc_id"]: r for r in rules.op2_quality_rules(spark, d).join(labels, "doc_id").collect()}
    good = [r["content_share"] >= rules.CONTENT_SHARE for r in kept.values() if r["quality"] == 1]
    bad = [r["kept"] for r in kept.values() if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
    scored = quality.op5_quality_classifier(spark, d).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in scored]) > 0.95


def test_classifier_reads_content(spark):
    """Fluent texts, whose letters in another order are bad ones although no character of theirs is."""
    d = "/root/testdata/sf0.01"
    model = quality.trained(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1")
    texts = [r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").join(labels, "doc_id").filter(quality.held_out(F.col("doc_id"), 3) & (F.length("text") > 300)).collect()]
    rng = random.Random(1)
    mixed = [" ".join("".join(rng.sample(w, len(w))) for w in t.split(" ")) for t in texts]
    assert len(texts) > 50 and model.scores(texts).mean() > 0.95 and model.scores(mixed).mean() < 0.2


def test_classifier_edges(docs):
    assert {r["predicted"] for r in quality.classify(docs, quality.fit([], np.zeros(0, "i8"))).collect()} == {1}
    network = quality.fit(["good text here."] * 8 + ["$$$ ### &&&"] * 8, np.array([1] * 8 + [0] * 8))
    rows = quality.classify(docs, network).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(docs.limit(0), network).count() == 0
    texts = [t for _, t in AWKWARD]
    assert np.allclose(network.scores(texts), np.concatenate([network.scores([t]) for t in texts]), atol=1e-5)


def test_known_cells_leave_out_the_own_text():
    texts, labels = ["abcdefgh", "abcdefgh", "stuvwxyz", "01234567"], np.array([1, 1, 1, 0])
    known = quality.known_cells(texts, labels)
    shares = lambda own: quality.passages(texts, known, own)[0][:, :2]  # noqa: E731  of bad and of good texts' grams
    assert np.allclose(shares(None), [[0, 1], [0, 1], [0, 1], [1, 0]])
    assert np.allclose(shares(labels), [[0, 1], [0, 1], [0, 0], [0, 0]])
    assert np.allclose(shares(np.full(4, quality.NOISE)), shares(None))


def test_network_forward_and_gradient():
    rng = np.random.default_rng(0)
    x, first, labels = rng.normal(size=(12, 5)), np.array([0, 3, 4, 9, 12]), np.array([1, 0, 1, 0])
    parameters = quality.initial(5, rng)
    encode, bias, value, gate, weigh, out, offset = parameters
    logits, _ = quality.forward(parameters, x, first)
    for i in range(4):
        encoded = [np.tanh(r @ encode + bias) for r in x[first[i] : first[i + 1]]]
        attention = [math.exp(float(sum(np.tanh(h @ value) * (1 / (1 + np.exp(-(h @ gate)))) * weigh))) for h in encoded]
        whole = sum(a * h for a, h in zip(attention, encoded, strict=True)) / sum(attention)
        assert logits[i] == pytest.approx(whole @ out + offset[0])

    def loss(p):
        chance = quality.sigmoid(quality.forward(p, x, first)[0])
        return -np.mean(np.log(np.where(labels == 1, chance, 1 - chance))) + quality.RIDGE / 2 * sum((q**2).sum() for q in p)

    for k, g in enumerate(quality.gradient(parameters, x, first, labels)):
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 12)]:
            moved = [[q.copy() for q in parameters] for _ in range(2)]
            moved[0][k][at] += 1e-5
            moved[1][k][at] -= 1e-5
            assert g[at] == pytest.approx((loss(moved[0]) - loss(moved[1])) / 2e-5, abs=1e-7)
    trained = quality.train(x, first, labels, steps=200)
    assert loss(trained) < 0.3 < loss(quality.initial(5, np.random.default_rng(quality.SEED)))


def test_training_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(300)] + [(None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, 0), (None, 1), (400, 1)], "doc_id long, quality int")
    texts, marks = rules.training_sample(docs, labels, "quality", 1000)
    assert len(texts) == len(marks) == 201  # 5 bears both labels
    assert len(rules.training_sample(docs, labels, "quality", 20)[0]) == 20
    assert len(rules.training_sample(docs, labels, "quality", 1000, most_bytes=1000)[0]) <= 10
    assert len(rules.training_sample(docs, labels, "quality", 1000, most_bytes=1)[0]) == 1


def test_training_sample_orders_sizes_not_texts(spark):
    # long texts meet the byte limit before they are moved, not in the one task that orders them
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(3000)), lambda k: F.sha2(F.concat(F.col("id").cast("string"), k.cast("string")), 256))).alias("text"))
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))

    def stages():
        store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleReadBytes() for i in range(found.size())}

    before = stages()
    texts, marks = rules.training_sample(docs, labels, "quality", 1000, most_bytes=400_000)
    assert [len(t) for t in texts] == [64 * 3001] * 2 and len(marks) == 2
    assert max(n for k, n in stages().items() if k not in before) < 1_000_000  # the texts hold 11 MB


def test_training_holds_long_texts_once():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdefgh \n"), 120_000)) for _ in range(32)]
    labels = np.arange(32) % 2
    known = quality.known_cells(texts, labels)
    tracemalloc.start()
    rows = quality.TrainingRows(texts, known, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000  # 16 texts at a time and float values took 168 MB
    x, first = quality.passages(texts, known, labels)
    assert (rows.first == first).all() and rows.shape == x.shape
    at = rng.choice(len(x), 500, replace=False)
    assert np.array_equal(rows[at], rows.scaler.of(x)[at])


def test_urls(spark):
    rows = [(1, "https://Blog.Example.com/en/7x?q#f"), (2, "http://a.net/de/8"), (3, "http://example.net/de/8"), (4, None), (5, "nothing/com/en/"), (6, "x://com/en/"), (7, "http://xcom/en/"), (8, "http://h.org/es/é#/x"), (9, "http://com:80/en/"), (9, "http://com:80/en/"), (10, "")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("blog.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2] == ("a.net", "/de/8", "net/de/", "allow")
    assert got[3] == ("example.net", "/de/8", "example.net/de/8", "block")
    assert got[4][:3] == ("", "", None) and got[5][:3] == ("", "", None) and got[10][:3] == ("", "", None)
    assert got[6][2:] == ("com/en/", "block") and got[7][2] is None and got[8][2:] == ("org/es/", "block") and got[9][:3] == ("com:80", "/en/", None)
    assert all(v[3] in ("allow", "block") for v in got.values())
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def plain_ruling(url):
    head, sign, rest = (url or "").partition("://")
    if not sign:
        return "", "", None, None
    ends = [i for i, c in enumerate(rest) if c in "/?#"]
    host, after = (rest[: ends[0]], rest[ends[0] :]) if ends else (rest, "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = after[: min([i for i, c in enumerate(after) if c in "?#"], default=len(after))]
    fits = [(len(h + p), h + p, what) for what, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_urls_of_all_pages(spark):
    """Hosts, paths and rules against plain code; and the trees' verdicts against the trees on every url by itself."""
    d = "/root/testdata/sf0.01"
    odd = [(None, "http://a.com/en/"), (None, None), (-1, "http://" + "x" * 100_000 + ".net/de/"), (-2, "HTTP://A.COM/en/\u00e9?://b"), (-2, "http://org/es/\n://"), (-3, "://"), (-4, "http://net/de/#")]
    df = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", F.lit("x").alias("host"), F.lit(1).alias("_ruled"))
    df = df.union(spark.createDataFrame(odd, "page_id long, url string").select("page_id", "url", F.lit("x"), F.lit(1)))
    made = urls.judge(df).collect()
    expected = Counter((r["page_id"], *plain_ruling(r["url"])[:3]) for r in df.collect())
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in made) == expected
    verdict = {"/".join(r[1:2]) + r[2]: r[0] for r in urls.RULES}
    assert all(r["verdict"] == verdict[r["rule"]] for r in made if r["rule"]) and {r["verdict"] for r in made if not r["rule"]} <= {"allow", "block"}
    assert all(r["verdict"] == ("block" if r["block_chance"] >= 0.5 else "allow") for r in made if not r["rule"])


def test_suffix_rates_are_out_of_fold():
    known = urls.Suffixes.of(["http://a.x.com/1", "http://b.x.com/2", "http://c.y.org/3"], np.array([1.0, 1.0, 0.0]))
    one = "http://c.y.org/3"
    assert known.rates(one)[1] < known.rates(one, urls.fold_of(one))[1] == pytest.approx(known.overall)
    assert known.rates("http://z.x.com/9")[2] == pytest.approx(math.log1p(2))


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype("f8")
    model = urls.boost(x[:400], y[:400])
    assert np.mean((model.margin(x[400:]) > 0) == (y[400:] > 0)) > 0.93


def plain_tree_scores(texts, train):
    """log10 probabilities by the definition, one decision at a time."""
    seen: dict = {}
    padded = [b"\xff" * lm.DEPTH + t + b"\xff" for t in texts]

    def steps(y):
        for k in range(lm.DEPTH, len(y)):
            for level in range(8):
                yield y[k - lm.DEPTH : k], 1 << level | y[k] >> 8 - level, y[k] >> 7 - level & 1

    for y, learn in zip(padded, train, strict=True):
        for past, node, bit in steps(y) if learn else ():
            for depth in range(lm.DEPTH + 1):
                seen.setdefault((past[lm.DEPTH - depth :], node), [0, 0])[bit] += 1
    children: dict = {}
    for past, node in seen:
        if past:
            children.setdefault((past[1:], node), []).append(past)
    own = lambda s: math.lgamma(s[0] + 0.5) + math.lgamma(s[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(s) + 1)
    made: dict = {}

    def whole(past, node):
        if (past, node) not in made:
            s = seen.get((past, node), (0, 0))
            made[past, node] = own(s) if len(past) == lm.DEPTH else math.log(0.5) + np.logaddexp(own(s), sum(whole(c, node) for c in children.get((past, node), ())))
        return made[past, node]

    def one(past, depth, node):
        here = past[lm.DEPTH - depth :]
        s = seen.get((here, node), (0, 0))
        kt = (s[1] + 0.5) / (sum(s) + 1)
        if depth == lm.DEPTH:
            return kt
        w = math.exp(math.log(0.5) + own(s) - whole(here, node))
        return w * kt + (1 - w) * one(past, depth + 1, node)

    return [sum(math.log10(p if bit else 1 - p) for past, node, bit in steps(y) for p in [one(past, 0, node)]) for y in padded]


def test_language_model(spark):
    rows = [(0, "the cat sat"), (1, "The cat ran."), (2, None), (3, ""), (4, "zebra é"), (5, "the cat sat"), (6, "the hat")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = [i % 3 != 1 for i, _ in rows]
    made = {r["doc_id"]: r for r in lm.score(df, F.col("doc_id") % 3 != 1, block_bytes=16).collect()}
    texts = [(t or "").encode().lower() for _, t in rows]
    counts = Counter(w for t, x in zip(texts, train, strict=True) if x for w in [*t.split(), b""])
    n, v = sum(counts.values()), len(counts)
    for (i, _), t, x, expected in zip(rows, texts, train, plain_tree_scores(texts, train), strict=True):
        words = [*t.split(), b""]
        r = made[i]
        assert (r["train"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (x, len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
        assert abs(r["score"] - expected) <= (len(t) + 1) * 0.5 / lm.STEPS * lm.LOG10_2 + 1e-9
    untrained = lm.score(df, F.lit(False)).collect()
    assert all(r["score"] == pytest.approx(-8 * math.log10(2) * (r["n_bytes"] + 1)) and r["train_tokens"] == 0 for r in untrained)
    assert lm.score(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("range_bytes", [32, 200])
def test_language_model_over_many_ranges(spark, range_bytes):
    rng = np.random.default_rng(range_bytes)
    words = ["the", "cat", "cats", "é", "of", "a", "zzzzzzzzzzzzzzz", "Sat"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 14)))) for i in range(50)] + [(50, None), (3, "the cat sat"), (None, "the cat of the cat"), (None, "the cat of the cat")] + [(100 + i, "same row of a text") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = [i is None or i % 3 != 1 for i, _ in rows]
    made = lm.score(df, F.coalesce(F.col("doc_id") % 3 != 1, F.lit(True)), block_bytes=150, range_bytes=range_bytes).collect()
    texts = [(t or "").encode().lower() for _, t in rows]
    expected = plain_tree_scores(texts, train)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    for (i, n, s), r in zip(sorted(((i, len(t), s) for (i, _), t, s in zip(rows, texts, expected, strict=True)), key=key), sorted(made, key=lambda r: key((r["doc_id"], r["n_bytes"], r["score"]))), strict=True):
        assert (r["doc_id"], r["n_bytes"]) == (i, n) and abs(r["score"] - s) <= (n + 1) * 0.5 / lm.STEPS * lm.LOG10_2 + 1e-9


def test_grams_travel_whole():
    rng = np.random.default_rng(1)
    keys = np.unique(np.r_[rng.integers(0, 1 << 64, 500, "u8"), rng.integers(0, 1 << 16, 500).astype("u8"), np.array([0, 2**64 - 1], "u8")])
    counts = rng.integers(0, 600, len(keys))
    byte, got, times = lm.unpacked(lm.packed(200, keys, counts))
    assert byte == 200 and (got == keys).all() and (times == counts).all()
    numbers = np.cumsum(rng.integers(0, 400, 300))
    assert (lm._stepped(lm._steps(numbers)) == numbers).all()
    bits = np.r_[rng.uniform(0, 40, 300), 0.0]
    assert np.abs(lm._in_bits(lm._lengths(bits)) - bits).max() <= 0.5 / lm.STEPS


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, ids, bits):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups: dict = {}
    for i, x in enumerate(ids):
        if x is not None:
            groups[root(i)] = min(groups.get(root(i), x), x)
    return [groups.get(root(i)) for i in range(len(fps))]


def test_simhash_many_copies(spark):
    """A fingerprint that a third of all rows bear, among others."""
    rows = [(i, "one text that is copied again and again" if i % 3 == 0 else f"text number {i} of its own words {i * i}") for i in range(3000)]
    made = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    assert {r["id"]: (r["fp"] % 2**64, r["component"]) for r in made} == {i: (f, c) for (i, _), f, c in zip(rows, fps, plain_components(fps, [i for i, _ in rows], 4), strict=True)}
    assert len(made) == len(rows)


@pytest.mark.parametrize(("bits", "list_rows"), [(4, 4096), (4, 2), (3, 2)])
def test_simhash(docs, real, bits, list_rows):
    df = docs.select("doc_id", "text").union(real.select(F.col("doc_id") + 100, "text"))
    rows = simhash.near_duplicates(df, bits=bits, list_rows=list_rows).collect()
    texts = [(r["doc_id"], plain_fingerprint(r["text"])) for r in df.collect()]
    expected = Counter(zip(texts, plain_components([f for _, f in texts], [i for i, _ in texts], bits), strict=True))
    assert Counter(((r["id"], r["fp"] % 2**64), r["component"]) for r in rows) == expected


@pytest.mark.parametrize("bits", range(1, 8))
def test_place_sets_leave_no_pair_out(bits):
    for agreeing in combinations(range(8), 8 - bits):
        assert any(set(c) <= set(agreeing) for c in simhash.place_sets(bits))


def test_simhash_long_lists(spark):
    """Near copies that all share most bytes: their lists are far longer than a task takes, and dealt into chunks."""
    rng = random.Random(3)
    fps = [rng.getrandbits(64) & ~0xFFF0 for _ in range(20)]
    near = sorted({0x1234 << 48 | rng.getrandbits(12) << 4 for _ in range(900)} | {f for f in fps} | {f ^ 0b11011 for f in fps})
    prints = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(near)], "id long, fp long")
    made = {r["id"]: r["component"] for r in simhash.connected(prints, 4, list_rows=64).collect()}
    assert [made[i] for i in range(len(near))] == plain_components(near, list(range(len(near))), 4)


def test_simhash_long_chains(spark):
    chain = [0]
    for k in range(14):
        chain.append(chain[-1] ^ (0b1111 << 4 * k))
    links = spark.createDataFrame([(a, b) for a, b in zip(chain, chain[1:], strict=False)], "a long, b long")
    assert {r["root"] for r in simhash.components(links).collect()} == {0}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packing(spark, docs, real):
    for df in (docs, real):
        packed = packing.pack(packing.pieces(df).cache(), order=("doc_id", "piece", "length", "start", "ids")).collect()
        by_sequence: dict = {}
        for r in packed:
            by_sequence.setdefault(r["sequence_id"], []).append(r)
        for held in by_sequence.values():
            at = 0
            for r in sorted(held, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= packing.CAPACITY
        bound = math.ceil(sum(r["length"] for r in packed) / packing.CAPACITY)
        assert len(by_sequence) <= 1.03 * bound + 1
    import public_tokenizers
    from tokenizers import Tokenizer

    library, encoding = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing._encoding(bpe.read_vocabulary())
    for text in [*(t or "" for _, t in AWKWARD), *(r["text"] for r in real.limit(50).collect()), "<|endoftext|>a <|endoftext|>", "\u2028 it's ½ ²x"]:
        assert encoding.encode(text, allowed_special="all") == library.encode(text, add_special_tokens=False).ids
    got: dict = {}
    for r in packed:
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], bytes(r["ids"])))
    for r in real.collect():
        parts = sorted(got[r["doc_id"]])
        assert b"".join(p for _, _, p in parts) == np.append(encoding.encode_to_numpy(r["text"], allowed_special="all"), np.uint32(2)).astype("<u4").tobytes()
        assert [s for _, s, _ in parts] == np.cumsum([0, *(len(p) // 4 for _, _, p in parts)])[:-1].tolist()
        assert all(len(p) == 4 * packing.CAPACITY for _, _, p in parts[1:])
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0
    blank = spark.createDataFrame([(1, " " * 1_500_000), (2, "x" + "\n" * 1_500_000 + "y")], "doc_id long, text string")
    cut = {r["doc_id"]: bytes(r["ids"]) for r in packing.pieces(blank, capacity=1 << 22).collect()}
    assert all(cut[r["doc_id"]] == bytes(r["ids"]) + (2).to_bytes(4, "little") for r in bpe.encode(blank).collect())


def test_packing_fit_is_the_least_square(spark):
    """Against an active-set solver: the same sum of squares, and no pattern that more or fewer of would do better."""
    rng = np.random.default_rng(8)
    for _ in range(6):
        histogram = np.zeros(17, "i8")
        lengths = rng.choice(np.arange(1, 16), 5, replace=False)
        histogram[lengths] = rng.integers(1, 60, 5)
        patterns = packing.patterns_of(np.flatnonzero(histogram), 16)
        if not len(patterns):
            continue
        matrix = np.stack([np.bincount(p[p > 0], minlength=17) for p in patterns], 1).astype("f8")
        free, best = np.zeros(len(patterns), bool), np.zeros(len(patterns))
        while True:
            slope = matrix.T @ (histogram - matrix @ best)
            if free.all() or slope[~free].max() <= 1e-9:
                break
            free[np.flatnonzero(~free)[slope[~free].argmax()]] = True
            while True:
                tried = np.zeros(len(patterns))
                tried[free] = np.linalg.lstsq(matrix[:, free], histogram, rcond=None)[0]
                if tried.min() >= -1e-12:
                    break
                down = free & (tried < 0)
                best = best + (best[down] / (best[down] - tried[down])).min() * (tried - best)
                free &= best > 1e-12
                best[~free] = 0
            best = np.maximum(tried, 0)
        found = packing.fit(histogram, patterns, steps=5000)
        off = lambda x: float(((matrix @ x - histogram) ** 2).sum())
        assert found.min() >= 0 and off(found) == pytest.approx(off(best), abs=1e-4 * (1 + off(best)))


def test_packing_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, 0, 3 + i % 5, "x", {"a": i}) for i in range(40)], "doc_id long, piece int, length long, _number string, cell map<string,int>").withColumnRenamed("_number", "number")
    made = packing.pack(df)
    assert made.columns == [*df.columns, "sequence_id", "offset"] and made.filter("number = 'x'").count() == 40


def test_packing_plan_is_near_the_best():
    rng = np.random.default_rng(3)
    for _ in range(5):
        lengths = rng.integers(1, 33, 40)
        histogram = np.bincount(lengths, minlength=33)
        planned = packing.plan(histogram, 32)
        again = np.zeros(33, "i8")
        for parts, times in planned:
            assert sum(parts) <= 32
            np.add.at(again, list(parts), times)
        assert (again == histogram).all()
        assert sum(t for _, t in planned) <= math.ceil(lengths.sum() / 32) + 2


def test_sharding(docs, real):
    for df, shards in ((docs, 3), (real, 24), (real, 5)):
        rows = sharding.shard(df, shards=shards).collect()
        texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
        for k in {r["shard"] for r in rows}:
            assert 0 <= k < shards and sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    sizes = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], 5)
    assert sizes.max() - sizes.min() <= 2 * max(r["size"] for r in rows)
    assert sharding.shard(docs.limit(0), shards=4).count() == 0
    assert {r["shard"] for r in sharding.shard(real, target_bytes=10**9).collect()} == {0}


def plain_shards(rows, dims, leaves, group_tolerance):
    """Shard of each of (size, keys): nodes are cut one by one, by sorting their rows."""
    out = {}

    def split(some, leaves, first):
        if leaves == 1 or not some:
            out.update({i: first for i in some})
            return
        low_bits, left = sharding.TEXT_BITS + sharding.ID_BITS, leaves // 2
        spread = [max(rows[i][1][d] for i in some) // 2**low_bits - min(rows[i][1][d] for i in some) // 2**low_bits for d in range(dims)]
        dim = max(range(dims), key=lambda d: (spread[d], -d))
        total = sum(rows[i][0] for i in some)
        want, cut, below = total * left / leaves, None, 0
        for unit in (2**sharding.ID_BITS, 1):  # whole groups first, then rows
            cells: dict = {}
            for i in some:
                cells[rows[i][1][dim] // unit] = cells.get(rows[i][1][dim] // unit, 0) + rows[i][0]
            below = 0
            for cell, weight in sorted(cells.items()):
                if below + weight > want:
                    break
                below += weight
            cut = (cell if want - below <= below + weight - want else cell + 1) * unit
            if min(want - below, below + weight - want) <= group_tolerance * total / leaves:
                break
        split([i for i in some if rows[i][1][dim] < cut], left, first)
        split([i for i in some if rows[i][1][dim] >= cut], leaves - left, first + left)

    split(list(range(len(rows))), leaves, 0)
    return out


@pytest.mark.parametrize("group_tolerance", [0.0, 0.02, 0.5])
def test_sharding_like_a_plain_tree(spark, group_tolerance):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dims = ("n_chars", "doc_id", "source", "lang")
    keyed, n = sharding.keys(df, dims, "doc_id", "text")
    held = sorted(keyed.collect(), key=lambda r: r["doc_id"])
    expected = plain_shards([(r["_size"], [r[f"_key{d}"] for d in range(n)]) for r in held], n, 24, group_tolerance)
    made = {r["doc_id"]: r["shard"] for r in sharding.shard(df, shards=24, tolerance=0.0, group_tolerance=group_tolerance).collect()}
    assert made == {r["doc_id"]: expected[i] for i, r in enumerate(held)}


def test_shards_keep_equal_texts_together(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = sharding.shard(df, shards=24).join(df.select("doc_id", "text"), "doc_id")
    parted = made.groupBy("text").agg(F.countDistinct("shard").alias("n"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    split, groups = parted.filter("n > 1").count(), parted.count()
    assert groups > 40 and split <= 6
    sizes = [r[0] for r in made.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= df.agg(F.max(F.octet_length("text"))).first()[0]
    # a group that is too large for a shard is parted; ties of all dimensions, nulls, clashing names
    hot = spark.createDataFrame([(i if i % 7 else None, "the same", 8, "z") for i in range(600)] + [(i, f"text {i}", None, None) for i in range(600, 700)], "doc_id long, text string, n_chars long, _size string")
    sizes = np.bincount([r["shard"] for r in sharding.shard(hot, shards=6).collect()], minlength=6)
    assert sizes.sum() == 700 and sizes.min() > 60


def test_search(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 64]) for i in range(90)]
    odd = [(100, None), (120, [None] * 5), (140, [float("nan")] * 5), (160, []), (180, [1.0]), (None, [1.0] * 5), (3, vectors[3][1])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>")
    made = search.top_k(df.filter("vec_id % 20 = 0"), df, k=20)
    got: dict = {}
    for r in made.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in [*vectors, (3, vectors[3][1])]]
    for q, v in ((i, v) for i, v in usable if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q)[:20]
        assert got.pop(q) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert not got
    assert search.top_k(df.limit(0), df).count() == 0
    few = search.top_k(df.filter("vec_id = 20"), df.filter("vec_id in (20, 21)")).collect()
    assert [(r["rank"], r["vec_id"]) for r in few] == [(1, 21)]
    huge = spark.createDataFrame([(0, [1e300]), (1, [2e300])], "vec_id long, embedding array<double>")
    assert search.top_k(huge, huge).first()["score"] == 2**63 - 1


def test_search_over_a_grid(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_ROWS", 7)
    monkeypatch.setattr(search, "TILE_ROWS", 9)
    monkeypatch.setattr(search, "CELL_BLOCKS", 2)
    monkeypatch.setattr(search, "CELL_TILES", 3)
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 64], i, "x") for i in range(300)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, number long, cell string")
    made = search.top_k(df.filter("vec_id % 6 = 0"), df, k=5).collect()
    whole = np.array([[math.floor(64 * x) for x in v] for _, v, *_ in vectors])
    for q in range(0, 300, 6):
        scored = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:5]
        assert [(r["vec_id"], r["score"]) for r in sorted(made, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, -s) for s, i in scored]
    assert len(made) == 250


def test_search_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{DATA}/embeddings.parquet')")
    expected = sorted(con.sql(search.ORACLES["op10_exact_top_k"]).fetchall())
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search.op10_exact_top_k(spark, DATA).collect()) == expected


def test_pipeline_stages(spark, docs, tmp_path):
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, seen, DATA)
        if name != "best_fit_packing":
            assert made.columns == docs.columns
        made.write.parquet(str(tmp_path / name))
        seen = spark.read.parquet(str(tmp_path / name))
    clean = spark.read.parquet(f"{DATA}/documents.parquet")
    once = corpus_pipeline.simhash_near_dedup(spark, clean.union(clean), DATA)
    expected = {c for c in plain_components([plain_fingerprint(r["text"]) for r in clean.collect()], [r["doc_id"] for r in clean.collect()], 4)}
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(expected)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, clean.limit(0), DATA).count() == 0


def test_stages_keep_rows_as_they_are(spark):
    """Maps and structs, names with dots and of the operators' own, nulls, repeated rows and ties."""
    clean = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()
    kind = "doc_id long, text string, lang string, number long, `a.b` map<string,array<int>>, _row struct<key:string,rank:int>"
    rows = [(r["doc_id"], r["text"], r["lang"], i, {"k": [i, None]}, ("x", i)) for i, r in enumerate(clean)]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, None, None), (None, None, "en", 1, {}, None), (7, "", None, None, None, None), (None, LONG, None, None, None, None)]
    docs = spark.createDataFrame(rows, kind)
    key = lambda r: repr(r)
    for name, stage in corpus_pipeline.STAGES[:3]:
        made = stage(spark, docs, DATA)
        assert made.columns == docs.columns and [f.dataType for f in made.schema] == [f.dataType for f in docs.schema]
        held = sorted(map(key, docs.collect()))
        kept = sorted(map(key, made.collect()))
        assert not Counter(kept) - Counter(held) and len(kept) >= 40, name
    field = rules.fit(*rules.training_sample(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"), "quality", rules.TRAINING_DOCS))
    judged = [r["kept"] for r in rules.judge(docs, field).collect()]
    assert sorted(map(key, rules.keep(docs, field).collect())) == sorted(key(r) for r, ok in zip(docs.collect(), judged, strict=True) if ok)
    model = quality.trained(spark, DATA)
    good = [r["predicted"] for r in quality.classify(docs, model).collect()]
    assert sorted(map(key, quality.keep(docs, model).collect())) == sorted(key(r) for r, ok in zip(docs.collect(), good, strict=True) if ok)
    once = corpus_pipeline.near_dedup(spark, docs, DATA).collect()
    assert sum(r["text"] == rows[0][1] for r in once) == 1
    assert sum(not (r["text"] or "").strip() for r in once) == 1 and [r["doc_id"] for r in once if r["text"] == rows[1][1]] == [None]


def test_token_counts_like_the_library(spark, docs, real):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    vocabulary = tokens.read_vocabulary()
    library = Tokenizer(Unigram([("<unk>", 0.0), *vocabulary], unk_id=0, byte_fallback=False))
    counter = tokens.Counter(vocabulary)
    texts = [r["text"] for r in real.limit(60).collect()] + [t for _, t in AWKWARD if t and t != LONG] + ["\u4e00\u9fff \u4e00a\u2603\u2603 \u2603", "  two  spaces ", "aaaa bbbb" * 9]
    for t in texts:
        expected = library.encode(tokens.SPACE + t.replace(" ", tokens.SPACE), add_special_tokens=False).ids
        assert counter.count(t)[0] == len(expected), t[:60]
    rng = random.Random(6)
    pieces = [p for p, _ in vocabulary if tokens.SPACE not in p]
    for _ in range(3000):
        t = "".join(rng.choice(["", "", " "]) + (p := rng.choice(pieces))[: rng.randrange(1, len(p) + 1)] for _ in range(rng.randrange(1, 9))).strip()
        if t:
            expected = library.encode(tokens.SPACE + t.replace(" ", tokens.SPACE), add_special_tokens=False).ids
            assert counter.count(t)[0] == len(expected), t
    assert counter.best(" " * 200_000)[0] > 0 and counter.best("")[0] == 0
    rows = tokens.count_tokens(docs).collect()
    assert len(rows) == len(AWKWARD) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert tokens.count_tokens(docs.limit(0)).count() == 0
