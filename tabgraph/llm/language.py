"""Operator 4: language identification by nearest centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, load, row_pass, written

BITS = 15
_SIZE = 1 << BITS
_ASCII = np.array([not chr(i).isalpha() for i in range(128)])


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams of a whole text's lower-case letters, everything else one blank, with the roots of their counts.
    Empty without a letter."""
    if not any(map(str.isalpha, text)):
        return np.empty(0, np.int32), np.empty(0, np.float32)
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    c[(c < 128) & _ASCII[np.minimum(c, 127).astype(np.int64)]] = 32
    c = c[(c != 32) | (np.concatenate([c[:1] * 0, c[:-1]]) != 32)]
    mix = lambda x, salt: (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
    two = c[:-1] << np.uint64(21) | c[1:]
    three = two[:-1] * np.uint64(0x2545F4914F6CDD1D) + c[2:]
    grams = np.concatenate([mix(c, 1), mix(two, 2), mix(three, 3)]).astype(np.int64)
    count = np.bincount(grams, minlength=_SIZE)
    at = np.flatnonzero(count)
    return at.astype(np.int32), np.sqrt(count[at]).astype(np.float32)


class Centroids:
    """idf: weight of each hashed n-gram; table: centroids by n-gram (rows) and centroid (columns), of unit length; of:
    each centroid's language; reject: each centroid's least cosine to be taken as its language."""

    def __init__(self, idf: np.ndarray, table: np.ndarray, of: list[str], reject: np.ndarray):
        self.idf, self.table, self.of, self.reject = idf, table, of, reject

    def nearest(self, at: np.ndarray, x: np.ndarray) -> tuple[str, float, bool]:
        """Language, cosine (0 to 1) and whether it is too far from the centroid; "und" without n-grams or centroids."""
        if not len(at) or not self.of:
            return "und", 0.0, True
        w = x * self.idf[at]
        cos = w @ self.table[at] / max(float(np.linalg.norm(w)), 1e-9)
        k = int(cos.argmax())
        return self.of[k], min(1.0, max(0.0, float(cos[k]))), bool(cos[k] < self.reject[k])


def fit_centroids(spark: SparkSession, docs: DataFrame, rows: int = 300, centroids: int = 4, rejected: float = 0.01, rounds: int = 8) -> Centroids:
    """Learns from documents with a language and a letter outside the fold crc32(doc_id) mod 5 = 0: for each language
    about `rows` of them, chosen by a hash of the id, whole texts. Each language's unit vectors are clustered by
    spherical k-means from its farthest-first points; the share `rejected` of them lies below its centroid's least cosine."""
    known = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), 5) != 0)).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return Centroids(np.ones(_SIZE, np.float32), np.zeros((_SIZE, 0), np.float32), [], np.zeros(0))
    shares = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows / n))))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < shares[F.col("lang")] * 2**31
    add = T.StructType().add("at", T.ArrayType(T.IntegerType())).add("x", T.ArrayType(T.FloatType()))

    def fn(texts: list[str]) -> dict[str, list]:
        got = [ngrams(t) for t in texts]
        return {"at": [a for a, _ in got], "x": [x for _, x in got]}

    some = known.where(drawn).withColumns({"h": F.xxhash64("doc_id"), "h2": F.xxhash64("text")})
    t = row_pass(some, fn, add, drop=["text"]).orderBy("h", "doc_id", "h2").limit(2 * rows * len(counts)).toArrow()
    order = sorted(range(t.num_rows), key=lambda i: xxhash.xxh64_intdigest(str(t["doc_id"][i])))
    vectors = [(t["lang"][i].as_py(), t["at"][i].values.to_numpy(), t["x"][i].values.to_numpy()) for i in order]
    vectors = [v for v in vectors if len(v[1])]
    df = np.zeros(_SIZE)
    for _, at, _ in vectors:
        df[at] += 1
    idf = (np.log((1 + len(vectors)) / (1 + df)) + 1).astype(np.float32)
    columns, of, reject = [], [], []
    for lang in sorted(counts):
        own = np.zeros((sum(v[0] == lang for v in vectors), _SIZE), np.float32)
        if not len(own):
            continue
        for row, (_, at, x) in zip(own, (v for v in vectors if v[0] == lang)):
            row[at] = x * idf[at]
        own /= np.linalg.norm(own, axis=1, keepdims=True)
        c = own[:1]
        while len(c) < min(centroids, len(own)):
            c = np.concatenate([c, own[[(own @ c.T).max(1).argmin()]]])
        for _ in range(rounds):
            of_row = (own @ c.T).argmax(1)
            c = np.stack([own[of_row == k].sum(0) if (of_row == k).any() else c[k] for k in range(len(c))])
            c /= np.linalg.norm(c, axis=1, keepdims=True)
        cos = own @ c.T
        for k in range(len(c)):
            mine = cos[cos.argmax(1) == k, k]
            columns.append(c[k])
            of.append(lang)
            reject.append(float(np.quantile(mine, rejected)) if len(mine) else 0.0)
    return Centroids(idf, np.ascontiguousarray(np.array(columns, np.float32).reshape(-1, _SIZE).T), of, np.array(reject))


def languages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each row of docs.

    lang_pred is the language of the nearest centroid, whatever the distance; `rejected` says that the text is farther from
    it than all but the farthest hundredth of what it was learned from. Texts that are null or have no letter, and all texts
    if nothing could be learned, are "und" with score 0, rejected. Null ids count as held out.
    """
    model = fit_centroids(spark, docs)
    add = T.StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def fn(texts: Sequence[str]) -> dict[str, list]:
        got = [model.nearest(*ngrams(t)) for t in texts]
        return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [g[2] for g in got]}

    scored = row_pass(docs.select("doc_id", "text"), fn, add, drop=["text"])
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(spark, load(spark, sf_dir, "documents"))
