"""URL filters: allow and block rules, and for all other URLs gradient-boosted trees on lexical features.

The rules label the URLs that they fit; the trees learn from a bounded sample of those and judge the rest.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small_batches, table

#: (what, host, path): fixed by the contract of op4.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Labelled URLs that the trees are trained on at most: those that hash lowest.
TRAINING_URLS = 20_000
ROUNDS, LEAVES_DEPTH, RATE, BINS, RIDGE, LEAST_ROWS = 60, 3, 0.15, 32, 1.0, 5
#: Folds of the training URLs for their suffix rates.
FOLDS = 5
#: Weight of the overall rate in a suffix's rate, in URLs.
PRIOR = 10.0
FEATURES = (
    "length", "host_length", "path_length", "query_length", "depth", "host_labels", "digits", "host_digits", "entropy", "host_entropy", "parameters",
    "hyphens", "percents", "secure", "longest_part", "number_part", "has_extension", "fragment", "top_suffix_rate", "suffix_rate", "suffix_count",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ://."""
    url = F.coalesce(url, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(url, "^[\\s\\S]*?://([^/?#]*)", 1), upper, lower), F.regexp_extract(url, "^[\\s\\S]*?://[^/?#]*([^?#]*)", 1)


def ruling(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, else nulls; of equally long rules the last."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffixes(url: str) -> tuple[str, str]:
    """Last label of the host, and the last two."""
    host = url.partition("://")[2] if "://" in url else ""
    labels = host.split("/")[0].split("?")[0].split("#")[0].lower().split(".")
    return labels[-1], ".".join(labels[-2:])


@dataclass
class Suffixes:
    """Rates of blocked URLs by suffix in the training sample, drawn towards the overall rate; as many as the sample has.

    Counts are kept by folds of the sample, so that a training URL's rates come from the other folds alone: with its own
    label among them the trees would learn to read it off.
    """

    overall: float
    seen: dict[str, np.ndarray]  # URLs and blocked ones, by fold

    @classmethod
    def of(cls, urls: list[str], blocked: np.ndarray) -> Suffixes:
        seen: dict[str, np.ndarray] = {}
        for u, b in zip(urls, blocked.tolist(), strict=True):
            for s in set(suffixes(u)):
                seen.setdefault(s, np.zeros((2, FOLDS), "i8"))[:, fold_of(u)] += (1, int(b))
        return cls(float(blocked.mean()) if len(blocked) else 0.0, seen)

    def counts(self, suffix: str, without: int | None) -> tuple[int, int]:
        if (held := self.seen.get(suffix)) is None:
            return 0, 0
        n, b = held.sum(1) if without is None else held.sum(1) - held[:, without]
        return int(n), int(b)

    def rates(self, url: str, without: int | None = None) -> tuple[float, float, float]:
        """Of the last label and the last two, and how often these are seen."""
        (n1, b1), (n2, b2) = (self.counts(s, without) for s in suffixes(url))
        return (b1 + PRIOR * self.overall) / (n1 + PRIOR), (b2 + PRIOR * self.overall) / (n2 + PRIOR), math.log1p(n2)


def fold_of(url: str) -> int:
    return zlib.crc32(url.encode()) % FOLDS


def lexical(url: str | None, known: Suffixes, without: int | None = None) -> list[float]:
    """FEATURES of a url; a null one is empty. without: the fold whose counts are left out."""
    url = url or ""
    rest = url.partition("://")[2] if "://" in url else url
    before, _, fragment = rest.partition("#")
    address, _, query = before.partition("?")
    host, slash, path = address.partition("/")
    parts = [p for p in path.split("/") if p]
    digits = lambda s: sum(map(str.isdigit, s)) / max(1, len(s))
    return [
        len(url), len(host), len(slash + path), len(query), len(parts), host.count(".") + 1, digits(url), digits(host), entropy(url), entropy(host),
        len([q for q in query.split("&") if q]), url.count("-"), url.count("%"), float(url.lower().startswith("https")), max(map(len, parts), default=0),
        sum(p.isdigit() for p in parts), float("." in parts[-1]) if parts else 0.0, float(bool(fragment)), *known.rates(url, without),
    ]


@dataclass
class Trees:
    """Sum of regression trees; a tree is (feature, threshold) of its inner nodes in heap order and the leaves' values."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def margin(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        for feature, threshold, value in self.trees:
            node = np.zeros(len(rows), "i8")
            for _ in range(LEAVES_DEPTH):
                node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out


def boost(rows: np.ndarray, blocked: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Second-order boosting of the logistic loss on binned features."""
    n, width = rows.shape
    rate = float(np.clip(blocked.mean(), 1e-3, 1 - 1e-3)) if n else 0.0
    model = Trees(math.log(rate / (1 - rate)) if n else -1.0, [])
    if not n or blocked.min() == blocked.max():
        return model
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(edges)])
    margin = np.full(n, model.base)
    inner = (1 << LEAVES_DEPTH) - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - blocked, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, node = np.zeros(inner, "i8"), np.full(inner, np.inf), np.zeros(n, "i8")
        for level in range(LEAVES_DEPTH):
            for k in range((1 << level) - 1, (2 << level) - 1):
                at = np.flatnonzero(node == k)
                best = 1e-6
                for f in range(width) if len(at) >= 2 * LEAST_ROWS else ():
                    b = binned[at, f]
                    g, h, c = (np.bincount(b, w, BINS + 1).cumsum() for w in (grad[at], hess[at], np.ones(len(at))))
                    gain = g**2 / (h + RIDGE) + (g[-1] - g) ** 2 / (h[-1] - h + RIDGE) - g[-1] ** 2 / (h[-1] + RIDGE)
                    gain[(c < LEAST_ROWS) | (c[-1] - c < LEAST_ROWS)] = 0
                    gain = gain[: len(edges[f])]
                    if len(gain) and gain.max() > best:
                        best, feature[k], threshold[k] = gain.max(), f, edges[f][gain.argmax()]
            node = 2 * node + 1 + (rows[np.arange(n), feature[node]] > threshold[node])
        g, h = np.bincount(node - inner, grad, inner + 1), np.bincount(node - inner, hess, inner + 1)
        value = -RATE * g / (h + RIDGE)
        margin += value[node - inner]
        model.trees.append((feature, threshold, value))
    return model


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, most: int = TRAINING_URLS) -> DataFrame:
    """page_id, host, path, rule, verdict and block_chance of every row.

    The longest rule that fits decides; else the trees do, blocking from an even chance on. A null url, or one without
    ://, has an empty host and path, fits no rule and is judged as the text that it is. Without rule-labelled URLs all
    others are allowed; with one label alone, that label goes to all. Repeated rows and ids, null ones too, are judged
    each alike; of equally long rules the last stands; a url of any length is judged as a whole. An empty table gives an
    empty one; other columns are not looked at.
    """
    spark = df.sparkSession
    small_batches(spark, 5000)
    host, path = host_and_path(F.col(url_col))
    rule, verdict = ruling(F.col("host"), F.col("path"), rules)
    parsed = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("_ruled", verdict)
    # Ruled URLs are thinned by their hash before they are ordered, so that not much more than `most` reach the last task.
    ruled, place = parsed.filter(F.col("_ruled").isNotNull()).select("_url", "_ruled"), F.pmod(F.xxhash64("_url"), F.lit(1 << 32))
    found = ruled.agg(F.approx_count_distinct("_url")).first()[0]
    thinned = ruled.filter(place < math.ceil((1 << 32) * min(1.0, (2 * most + 1000) / max(1, found))))
    chosen = thinned.distinct().orderBy(place, "_url").limit(most).collect()
    urls, blocked = [r["_url"] for r in chosen], np.array([r["_ruled"] == "block" for r in chosen], "f8")
    known = Suffixes.of(urls, blocked)
    model = boost(np.array([lexical(u, known, fold_of(u)) for u in urls]).reshape(-1, len(FEATURES)), blocked)
    shared = spark.sparkContext.broadcast((known, model))  # suffixes of at most `most` URLs, and ROUNDS trees

    def run(batches):
        known, model = shared.value
        for batch in batches:
            rows = np.array([lexical(u, known) for u in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            chance = 1 / (1 + np.exp(-model.margin(rows)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 2, 3, 4, 5)), pa.array(chance)], names=["page_id", "host", "path", "rule", "_ruled", "block_chance"])

    kind = df.schema[id_col].dataType.simpleString()
    made = parsed.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, _ruled string, block_chance double")
    return made.select("page_id", "host", "path", "rule", F.coalesce("_ruled", F.when(F.col("block_chance") >= 0.5, "block").otherwise("allow")).alias("verdict"), "block_chance")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
