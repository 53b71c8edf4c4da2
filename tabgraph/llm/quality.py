"""Operators 7 and 8: a hashed n-gram classifier of quality, and rules with an isolation forest over their statistics."""

from __future__ import annotations

import math
import re
import string
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, fold, free, load, row_pass, written

#: Labelled rows that the classifier is fitted on, at most twice as many; everything else is over all rows.
SAMPLE = 3000


def labelled(spark: SparkSession, docs: DataFrame, labels: DataFrame, use: Column, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, text, quality) of a bounded sample of labelled documents where `use` (over doc_id) holds, one row an id.

    Null ids and labels are left out; of several labels of an id the least counts, and of several rows with it the one
    whose text has the least hash. The sample is drawn from the labels by a hash of the id, so its size is bounded before
    any text is read, and another run draws the same.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & use).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = written(spark, bounded_sample(known, [F.col("doc_id")], rows, known.count()), "labels")
    met = docs.select("doc_id", "text").join(F.broadcast(some.withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id"))
    return met.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.min("quality").alias("quality"))


# --- 7: classifier ---------------------------------------------------------------------------------------------------

BITS = 18
_MASK = (1 << BITS) - 1
_SHAPE = bytes(ord("0") if chr(b).isdigit() and b < 128 else ord("a") if b >= 128 or 97 <= b <= 122 else ord("A") if 65 <= b <= 90 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


class _Words(dict):
    """Hash of a word in lower case, and above it the hash of its shape: letters and digits as a, A and 0, runs as one."""

    def __missing__(self, w: bytes) -> int:
        v = xxhash.xxh32_intdigest(w.lower()) & _MASK | (xxhash.xxh32_intdigest(_RUNS.sub(rb"\1", w.translate(_SHAPE)), 1) & _MASK) << 32
        if len(w) <= 32:
            if len(self) >= 300_000:
                self.clear()
            self[w] = v
        return v


_words = _Words()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- and 2-grams of words and of word shapes (with a mark where a word stands twice in a row) with the square
    roots of their frequencies in the whole text."""
    words = text.encode().split()
    n = len(words)
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    both = np.fromiter(map(_words.__getitem__, words), np.int64, n)
    h, s = both & _MASK, both >> 32
    mix = lambda a, b, salt: (a * 0x9E3779B1 + b * 0x85EBCA77 + salt * 0xC2B2AE3D) >> 7 & _MASK
    same = (h[1:] == h[:-1]).astype(np.int64)
    grams = np.concatenate([mix(h, h, 1), mix(h[:-1], h[1:], 2), mix(s, s, 3), mix(s[:-1], s[1:] + (same << 20), 4)])
    at, count = np.unique(grams, return_counts=True)
    return at.astype(np.int32), np.sqrt(count / n).astype(np.float32)


def ftrl(rows: Iterable[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression by follow-the-regularised-leader (proximal) updates: weights and bias (the last coordinate)."""
    rows, size = list(rows), _MASK + 2
    z, n = np.zeros(size), np.zeros(size)
    one = (np.array([size - 1]), np.array([1.0]))

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    for _ in range(epochs):
        for at, x, y in rows:
            at, x = np.concatenate([at, one[0]]), np.concatenate([x, one[1]])
            w = weights(at)
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, float(w @ x))))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(size))
    return w[:-1].astype(np.float32), float(w[-1])


def fit_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Learns from labels outside the fold crc32(doc_id) mod 4 = 2, in the order of a hash of the id. Without labels the
    weights are 0, so that every score is 0.5."""
    add = T.StructType().add("at", T.ArrayType(T.IntegerType())).add("x", T.ArrayType(T.FloatType()))

    def fn(texts: list[str]) -> dict[str, list]:
        got = [features(x) for x in texts]
        return {"at": [a for a, _ in got], "x": [x for _, x in got]}

    t = row_pass(labelled(spark, docs, labels, fold(F.col("doc_id"), 4) != 2, rows), fn, add, drop=["text"]).toArrow()
    order = sorted(range(t.num_rows), key=lambda i: xxhash.xxh64_intdigest(str(t["doc_id"][i])))
    return ftrl((t["at"][i].values.to_numpy(), t["x"][i].values.to_numpy(), int(t["quality"][i].as_py() > 0)) for i in order)


def score_texts(texts: Sequence[str], weights: np.ndarray, bias: float) -> list[float]:
    out = []
    for text in texts:
        at, x = features(text)
        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(weights[at] @ x) + bias)))))
    return out


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs; a null text scores as an empty one, by the bias alone.
    Null ids count as the empty text in the fold."""
    weights, bias = fit_quality(spark, docs, labels)
    add = T.StructType().add("score", "double")
    scored = row_pass(docs.select("doc_id", "text"), lambda x: {"score": score_texts(x, weights, bias)}, add, drop=["text"])
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without the rows that the classifier scores below the threshold; all columns as they were."""
    weights, bias = fit_quality(spark, docs, labels)
    return row_pass(docs, lambda x: {"score": score_texts(x, weights, bias)}, T.StructType(), keep=lambda got: [s >= threshold for s in got["score"]])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


# --- 8: rules --------------------------------------------------------------------------------------------------------

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\f\r"
_MARKS = string.punctuation.encode()
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("word length", "symbols a word", "marks a word", "log of n_words", "share of duplicate lines", "share of repeated words")
#: The statistics that each forest looks at. Shared passages repeat in a few clean texts too, which would make those the
#: anomalies of a single forest and leave nothing to what texts are made of.
FORESTS = ((0, 1, 2, 3), (3, 4, 5))
MIN_WORDS, MAX_REPEAT = 50, 0.5
DEPTH = 7  # of the trees, whatever the number of rows
PART = 16_384  # labelled rows a task


def repeated_words(words: Sequence[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice in the text, first occurrences included."""
    n, ids = len(words), {}
    if n < 4:
        return 0
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pair = at[:-1] * len(ids) + at[1:]
    if len(ids) >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, which, count = np.unique(pair[:-1] * len(ids) + at[2:], return_inverse=True, return_counts=True)
    twice = count[which] >= 2
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base counts of a whole text, and the RATIOS made of them and of its ASCII punctuation marks."""
    raw = text.encode()
    words = raw.split()
    n, lines, seen, dup = len(words), 0, set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    repeat = repeated_words(words)
    marks = len(raw) - len(raw.translate(None, _MARKS))
    m = max(n, 1)
    return [n, chars, symbols, dup, repeat], [chars / m, symbols / m, marks / m, math.log1p(n), dup / max(lines, 1), repeat / m]


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat_words > MAX_REPEAT * n_words)


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Trees of random splits of full depth, kept as arrays; a point's score is 2 ** (-mean path length / expected).

    Every point goes through every tree. A level needs only the number of points at each node of the one before and the least
    and greatest of their values, which parts of the points give apart: `extents` of each part, merged, go to `grow`.

    The share `fences` of the splits stands just outside a random statistic's values at its node, where it parts none of the
    points: what lies beyond all that was seen, even of a statistic that never varied, is alone there.
    """

    def __init__(self, points: np.ndarray | None = None, size: int = 0, trees: int = 100, depth: int = DEPTH, seed: int = 7, fences: float = 0.15):
        self.size, self.seed, self.fences = size if points is None else len(points), seed, fences
        self.depth = max(1, min(depth, math.ceil(math.log2(max(2, self.size)))))
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((trees, inner), np.int64)
        self.split = np.full((trees, inner), np.inf)
        self.path = np.zeros((trees, inner + 1))
        self.stop = np.full((trees, 1), self.depth)  # of the level last grown: the depth that a node's path ends at
        if points is not None:
            for level in range(self.depth + 1):
                self.grow(level, *self.extents(points, level))

    def nodes(self, points: np.ndarray, level: int) -> np.ndarray:
        """The place among its level's nodes that each point comes to in each tree."""
        at, trees = np.zeros((len(points), len(self.path)), np.int64), np.arange(len(self.path))
        rows = np.arange(len(points))[:, None]
        for _ in range(level):
            at = 2 * at + 1 + (points[rows, self.feature[trees, at]] > self.split[trees, at])
        return at - ((1 << level) - 1)

    def extents(self, points: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of points at each node of a level, tree by tree, and by statistic their least and greatest values (not
        of the last level, which has no splits)."""
        trees, wide = len(self.path), len(self.path) << level
        at = (self.nodes(points, level) + (np.arange(trees) << level)).ravel()
        lo, hi = np.full((points.shape[1], wide), np.inf), np.full((points.shape[1], wide), -np.inf)
        for f in range(points.shape[1] if level < self.depth else 0):
            x = np.repeat(points[:, f], trees)
            np.minimum.at(lo[f], at, x)
            np.maximum.at(hi[f], at, x)
        return np.bincount(at, minlength=wide), lo, hi

    def grow(self, level: int, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Sets a level's splits, or the path lengths at the last, by the extents of all points. A node whose points are equal
        has no split: they go on left, and their path ends there."""
        shape = (len(self.path), 1 << level)
        stop = np.repeat(self.stop, 2, axis=1) if level else self.stop
        if level == self.depth:
            self.path = stop + np.vectorize(_expected, otypes=[float])(n.reshape(shape))
            return
        lo, hi = lo.reshape(-1, *shape), hi.reshape(-1, *shape)
        spread = hi > lo
        some = spread.any(0)
        fence, side, which, place = np.random.default_rng([self.seed, level]).random((4, *shape))
        fence = fence < self.fences
        f = np.where(fence, which * len(lo), (np.cumsum(spread, axis=0) > np.floor(which * spread.sum(0))).argmax(0)).astype(np.int64)
        least, most = (np.where(some, np.take_along_axis(x, f[None], 0)[0], 0.0) for x in (lo, hi))
        cut = np.where(fence, np.where(side < 0.5, most, np.nextafter(least, -np.inf)), least + place * (most - least))
        here = slice((1 << level) - 1, (2 << level) - 1)
        self.feature[:, here], self.split[:, here] = np.where(some, f, 0), np.where(some, cut, np.inf)
        self.stop = np.minimum(stop, np.where(some, self.depth, level))

    def scores(self, points: np.ndarray) -> np.ndarray:
        if not len(points) or self.size < 2:
            return np.zeros(len(points))
        return 2.0 ** (-self.path[np.arange(len(self.path)), self.nodes(points, self.depth)].mean(1) / _expected(self.size))


def calibrated(clean: np.ndarray, bad: np.ndarray, clean_loss: float) -> float:
    """The least score to reject. Of those that reject at most the share `clean_loss` of the clean scores it is one that
    rejects the most bad ones, and of those the middle of the highest gap; without bad ones the least that keeps within that
    share. Without clean scores nothing is rejected."""
    if not len(clean):
        return math.inf
    clean, bad = np.sort(clean), np.sort(bad)
    least = np.nextafter(clean[len(clean) - 1 - int(clean_loss * len(clean))], 2)
    caught = bad[bad >= least]
    if not len(caught):
        return float(least)
    below = np.concatenate([clean, bad])
    return float((caught[0] + below[below < caught[0]].max(initial=0.0)) / 2)


def calibrated_rows(scores: DataFrame, clean_loss: float) -> float:
    """`calibrated` over all rows of (good, bits): a score's bits as a long, which order as scores do. The clean score that the
    share falls on is found by counts, 16 bits at a time, so that the driver sees at most 65,536 of them at once."""
    clean, prefix, skip = scores.where("good"), 0, None
    for shift in (48, 32, 16, 0):
        own = clean.where(F.shiftright("bits", shift + 16) == prefix) if shift < 48 else clean
        counts = own.groupBy(F.shiftright("bits", shift).alias("prefix")).count().toArrow().to_pylist()
        if skip is None:
            skip = int(clean_loss * sum(r["count"] for r in counts))
        for r in sorted(counts, key=lambda r: -r["prefix"]):
            prefix = r["prefix"]
            if skip < r["count"]:
                break
            skip -= r["count"]
        if not counts:
            return math.inf
    value = lambda bits: float(np.int64(bits).view(np.float64))
    caught = scores.where(~F.col("good") & (F.col("bits") > prefix)).agg(F.min("bits")).first()[0]
    if caught is None:
        return value(prefix + 1)
    return (value(caught) + value(scores.where(F.col("bits") < caught).agg(F.max("bits")).first()[0])) / 2


def measured(spark: SparkSession, docs: DataFrame, name: str, drop: Sequence[str] = ()) -> DataFrame:
    """docs, written, with an array of each text's BASE counts and RATIOS."""
    add = T.StructType().add(name, T.ArrayType(T.DoubleType()))
    return written(spark, row_pass(docs, lambda texts: {name: [[*c, *r] for c, r in map(statistics, texts)]}, add, drop=drop), "measures")


def _matrix(arrays: pa.ListArray, width: int) -> np.ndarray:
    return arrays.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def base_count(measures: Column, name: str) -> Column:
    return measures[BASE.index(name)].cast("long")


def failed(measures: Column) -> Column:
    return base_failed(base_count(measures, "n_words"), base_count(measures, "n_repeat_words"))


def grown(points: DataFrame, size: int) -> list[IsolationForest]:
    """A forest for each of FORESTS that all `size` rows of points (ratios) go through, a pass over them for each level."""
    forests = [IsolationForest(size=size) for _ in FORESTS]
    ends = [f"{end}{k}" for end in ("lo", "hi") for k in range(max(map(len, FORESTS)))]

    def extents(level: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_ = [forest.extents(np.empty((0, len(at))), level) for at, forest in zip(FORESTS, forests)]
            for batch in batches:
                x = _matrix(batch.column("ratios"), len(RATIOS))
                for k, (at, forest) in enumerate(zip(FORESTS, forests)):
                    n, lo, hi = forest.extents(x[:, at], level)
                    all_[k] = (all_[k][0] + n, np.minimum(all_[k][1], lo), np.maximum(all_[k][2], hi))
            for k, (n, lo, hi) in enumerate(all_):
                some = np.flatnonzero(n)
                own = {"forest": np.full(len(some), k, np.int32), "node": some.astype(np.int32), "n": n[some].astype(np.int64)}
                for name in ends:
                    x = (lo if name[:2] == "lo" else hi)[int(name[2:]) % len(lo)]
                    own[name] = x[some]
                yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in own.items()})

        return run

    for level in range(forests[0].depth + 1):
        parts = points.select("ratios").mapInArrow(extents(level), "forest int, node int, n long, " + ", ".join(f"{c} double" for c in ends))
        t = parts.groupBy("forest", "node").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) if c[:2] == "lo" else F.max(c).alias(c) for c in ends)).toArrow()
        t = {c: t[c].to_numpy() for c in t.column_names}
        for k, (at, forest) in enumerate(zip(FORESTS, forests)):
            n, lo, hi = forest.extents(np.empty((0, len(at))), level)
            own = t["forest"] == k
            n[t["node"][own]] = t["n"][own]
            for f in range(len(at)):
                lo[f, t["node"][own]], hi[f, t["node"][own]] = t[f"lo{f}"][own], t[f"hi{f}"][own]
            forest.grow(level, n, lo, hi)
    return forests


def fit_measured(spark: SparkSession, measures: DataFrame, name: str, labels: DataFrame, clean_loss: float = 0.005) -> list[tuple[IsolationForest, float]]:
    """A forest for each of FORESTS, grown on all rows that pass the base rules and whose id has a label, and its threshold, which
    its share of `clean_loss` calibrates on the labels of all of them. Null ids and labels are left out; of several labels
    of an id the least counts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg((F.min("quality") > 0).alias("good"))
    known = written(spark, known, "labels")
    passed = measures.where(~failed(F.col(name))).select("doc_id", F.slice(name, len(BASE) + 1, len(RATIOS)).alias("ratios"))
    points = passed.join(known.hint("merge"), F.col("doc_id") == F.col("__id")).select("ratios", "good")
    points = written(spark, points.repartition(max(1, -(-known.count() // PART))), "points")
    forests = grown(points, points.count())
    names = [f"bits{k}" for k in range(len(FORESTS))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("ratios"), len(RATIOS))
            yield pa.RecordBatch.from_arrays([batch.column("good"), *(pa.array(forest.scores(x[:, at]).view(np.int64)) for at, forest in zip(FORESTS, forests))], ["good", *names])

    scores = written(spark, points.mapInArrow(run, "good boolean, " + ", ".join(f"{c} long" for c in names)), "scores")
    return [(forest, calibrated_rows(scores.select("good", F.col(c).alias("bits")), clean_loss / len(FORESTS))) for forest, c in zip(forests, names)]


def fit_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> list[tuple[IsolationForest, float]]:
    """`fit_measured` of docs."""
    return fit_measured(spark, measured(spark, docs.select("doc_id", "text"), "measures", drop=["text"]), "measures", labels)


def anomaly(forests: list[tuple[IsolationForest, float]]) -> Callable[[Column], Column]:
    """Of the column of measures: the most that a forest's score is over its threshold, at 0 and above a rejection."""

    @F.arrow_udf("double")
    def over(measures: pa.Array) -> pa.Array:
        x = _matrix(measures, len(BASE) + len(RATIOS))[:, len(BASE) :]
        return pa.array(np.max([forest.scores(x[:, at]) - threshold for at, (forest, threshold) in zip(FORESTS, forests)], axis=0))

    return over


def rule_verdicts(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the base counts, base_failed, kept, anomaly) of each row; a null text has no words and fails."""
    m = F.col("measures")
    rows = measured(spark, docs.select("doc_id", "text"), "measures", drop=["text"])
    over = anomaly(fit_measured(spark, rows, "measures", labels))
    out = rows.select("doc_id", *(base_count(m, c).alias(c) for c in BASE), failed(m).alias("base_failed"), over(m).alias("anomaly"))
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("anomaly") < 0)).alias("kept"), "anomaly")


def within_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the base rules or the forest reject; all columns as they were."""
    name = free(docs, "measures")
    rows = measured(spark, docs, name)
    over = anomaly(fit_measured(spark, rows, name, labels))
    return rows.where(~failed(F.col(name)) & (over(F.col(name)) < 0)).select(*docs.columns)


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_verdicts(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
