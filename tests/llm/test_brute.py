"""Operators 4, 7, 8 and 10 against plain re-implementations, row by row."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tabgraph.llm import language, quality, urls

DIR = "/root/testdata/sf0.001"


def table(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{DIR}/{name}.parquet").collect()]


def fold(i, parts):
    return zlib.crc32(str(i).encode()) % parts


# 4


def plain_ngrams(text):
    """n-grams of lower-case letters, all else one blank, by number."""
    chars = [ord(c) for c in f" {text.lower()} "]
    chars = [32 if c < 128 and not chr(c).isalpha() else c for c in chars]
    chars = [c for k, c in enumerate(chars) if c != 32 or k == 0 or chars[k - 1] != 32]
    out, m = Counter(), 2**64
    for k in range(len(chars)):
        values = [(chars[k], 1)]
        if k + 1 < len(chars):
            values.append((chars[k] << 21 | chars[k + 1], 2))
        if k + 2 < len(chars):
            values.append(((chars[k] << 21 | chars[k + 1]) * 0x2545F4914F6CDD1D + chars[k + 2], 3))
        for v, salt in values:
            out[(v + salt) * 0x9E3779B97F4A7C15 % m >> 64 - language.BITS] += 1
    return out


def test_language_row_by_row(spark):
    docs = table(spark, "documents")
    got = {r.doc_id: r for r in language.op4_language(spark, DIR).collect()}
    model = language.fit_centroids(spark, spark.read.parquet(f"{DIR}/documents.parquet"))
    learned = [plain_ngrams(d["text"]) for d in docs if d["lang"] and d["text"] and fold(d["doc_id"], 5) and any(map(str.isalpha, d["text"]))]
    seen = Counter(g for x in learned for g in x)
    assert all(model.idf[g] == pytest.approx(math.log((1 + len(learned)) / (1 + seen[g])) + 1, rel=1e-5) for g in range(0, 1 << language.BITS, 17))
    assert np.linalg.norm(model.table, axis=0) == pytest.approx(1, rel=1e-4)
    for d in docs[:120]:
        r, text = got[d["doc_id"]], d["text"] or ""
        assert r.held_out == (fold(d["doc_id"], 5) == 0)
        if not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        x = {g: math.sqrt(n) * float(model.idf[g]) for g, n in plain_ngrams(text).items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        cos = [sum(v * float(model.table[g, k]) for g, v in x.items()) / size for k in range(len(model.of))]
        assert r.score == pytest.approx(max(cos), abs=1e-4)
        assert r.lang_pred in {lang for lang, c in zip(model.of, cos) if c > max(cos) - 1e-4}


# 7


def plain_features(text):
    m = (1 << quality.BITS) - 1
    mix = lambda a, b, salt: (a * 0x9E3779B1 + b * 0x85EBCA77 + salt * 0xC2B2AE3D) >> 7 & m
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    kind = lambda c: 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 97 if c >= 128 or 97 <= c <= 122 else c
    shapes = [bytes(kind(c) for c in w) for w in words]
    shapes = [bytes(c for k, c in enumerate(w) if k == 0 or w[k - 1] != c) for w in shapes]
    h, s = [xxhash.xxh32_intdigest(w.lower()) & m for w in words], [xxhash.xxh32_intdigest(w, 1) & m for w in shapes]
    out = Counter(mix(x, x, 1) for x in h) + Counter(mix(x, x, 3) for x in s)
    for k in range(len(words) - 1):
        out[mix(h[k], h[k + 1], 2)] += 1
        out[mix(s[k], s[k + 1] + ((h[k] == h[k + 1]) << 20), 4)] += 1
    return {g: math.sqrt(n / len(words)) for g, n in out.items()}


def plain_ftrl(rows, epochs=4, alpha=0.3, beta=1.0, l1=0.05, l2=0.1):
    z, n = defaultdict(float), defaultdict(float)
    w = lambda g: 0.0 if abs(z[g]) <= l1 else -(z[g] - math.copysign(l1, z[g])) / ((beta + math.sqrt(n[g])) / alpha + l2)
    for _ in range(epochs):
        for x, y in rows:
            x = x | {"bias": 1.0}
            own = {g: w(g) for g in x}
            p = 1 / (1 + math.exp(-sum(own[g] * v for g, v in x.items())))
            for g, v in x.items():
                d = (p - y) * v
                z[g] += d - (math.sqrt(n[g] + d * d) - math.sqrt(n[g])) / alpha * own[g]
                n[g] += d * d
    return w


def test_quality_row_by_row(spark):
    docs, labels = table(spark, "documents"), {r["doc_id"]: r["quality"] for r in table(spark, "labels")}
    learned = [d for d in docs if labels.get(d["doc_id"]) is not None and fold(d["doc_id"], 4) != 2]
    learned.sort(key=lambda d: xxhash.xxh64_intdigest(str(d["doc_id"])))
    assert 20 < len(learned) < quality.SAMPLE
    w = plain_ftrl([(plain_features(d["text"] or ""), int(labels[d["doc_id"]] > 0)) for d in learned])
    got = {r.doc_id: r for r in quality.op7_quality(spark, DIR).collect()}
    for d in docs:
        want = 1 / (1 + math.exp(-w("bias") - sum(w(g) * v for g, v in plain_features(d["text"] or "").items())))
        r = got[d["doc_id"]]
        assert r.score == pytest.approx(want, abs=1e-4) and r.held_out == (fold(d["doc_id"], 4) == 2)
        assert r.predicted == int(r.score >= 0.7)


# 8


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spans = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice, covered = Counter(spans), set()
    for k, s in enumerate(spans):
        if twice[s] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def plain_path(forest, tree, point):
    at = 0
    for _ in range(forest.depth):
        at = 2 * at + 1 + int(point[forest.feature[tree, at]] > forest.split[tree, at])
    return forest.path[tree, at - forest.feature.shape[1]]


def test_rules_row_by_row(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    odd = [(10**6 + k, x) for k, x in enumerate(["", None, "a b c " * 40, "x\n" * 60, "\n".join(f"line {k % 30} of the text\t{k}" for k in range(60)), "w " * 49 + "end", "é# " * 60])]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    forests = quality.fit_rules(spark, docs, labels)
    expected = lambda n: 2 * (sum(1 / k for k in range(1, n))) - 2 * (n - 1) / n
    verdicts = Counter()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality.rule_verdicts(spark, docs, labels).collect():
        n, chars, symbols, dup, repeat, lines = plain_counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        marks = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text[r.doc_id])
        m = max(n, 1)
        point = [chars / m, symbols / m, marks / m, math.log1p(n), dup / max(lines, 1), repeat / m]
        over = []
        for at, (forest, threshold) in zip(quality.FORESTS, forests):
            mean = sum(plain_path(forest, t, [point[k] for k in at]) for t in range(len(forest.path))) / len(forest.path)
            over.append(2 ** (-mean / expected(forest.size)) - threshold)
        assert r.anomaly == pytest.approx(max(over), abs=2e-3)  # the logarithm stands for the harmonic number
        if abs(max(over)) > 2e-3:
            assert r.kept == (not r.base_failed and max(over) < 0)
        verdicts[r.base_failed, r.kept] += 1
    assert verdicts[True, True] == 0 and verdicts[False, True] > 50


def test_thresholds_are_the_best_of_all():
    rng = random.Random(2)
    for _ in range(200):
        clean, bad = ([round(rng.random(), 2) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        share = rng.choice([0, 0.05, 0.3])
        t = quality.calibrated(np.array(clean), np.array(bad), share)
        lost = lambda x: sum(s >= x for s in clean) / len(clean)
        caught = lambda x: sum(s >= x for s in bad)
        assert lost(t) <= share
        assert caught(t) == max(caught(x) for x in [*clean, *bad, 2] if lost(x) <= share)


# 10


def plain_verdicts(keys, rule, n, order):
    """Scores of distinct host + path with their rule's verdict (None without a rule), and the threshold."""
    pad = lambda k: "\x02" * order + k + "\x03"
    grams = {k: [pad(k)[i : i + order + 1] for i in range(len(k) + 1)] if k else [] for k in keys}
    held = {k: xxhash.xxh64_intdigest(k.encode(), 42) % 2**64 for k in keys}
    held = {k: (h - 2**64 if h >= 2**63 else h) % 5 == 0 for k, h in held.items()}
    tails = {s: Counter() for s in (True, False)}
    for k in keys:
        if rule[k] is not None and not held[k]:
            for g in grams[k]:
                for j in range(order + 1):
                    tails[rule[k]][g[order - j :]] += n[k]
    after = {s: defaultdict(set) for s in (True, False)}
    total = {s: Counter() for s in (True, False)}
    for s, own in tails.items():
        for g, c in own.items():
            after[s][g[:-1]].add(g[-1])
            total[s][g[:-1]] += c
    letters = len({g[-1] for x in grams.values() for g in x})

    def p(g, s):
        below = p(g[1:], s) if len(g) > 1 else 1 / (letters + 1)
        t, c = len(after[s][g[:-1]]), total[s][g[:-1]]
        return (tails[s][g] + t * below) / (c + t) if c + t else below

    score = {}
    for k in keys:
        x = sum(math.log(p(g, True) / p(g, False)) for g in grams[k])
        score[k] = round(max(-20.0, min(20.0, x / len(grams[k]))), 6) if grams[k] else 0.0
    known = [k for k in keys if held[k] and rule[k] is not None]
    good, bad = (sum(n[k] for k in known if rule[k] == s) for s in (True, False))
    if not good or not bad:
        return score, 0.0
    errs = lambda t: sum(n[k] for k in known if rule[k] and math.floor(score[k] * 100) < t) / good + sum(n[k] for k in known if not rule[k] and math.floor(score[k] * 100) >= t) / bad
    return score, min((errs(b), b) for b in {math.floor(score[k] * 100) for k in known})[1] / 100


@pytest.mark.parametrize("sides", ["ab", "a", ""])
def test_url_verdicts_row_by_row(spark, sides):
    rng = random.Random(4)
    host = lambda: "".join(rng.choice("abc") for _ in range(3))
    rows = [f"http://{host()}.net/de/{''.join(rng.choice('xyz') for _ in range(6))}" for _ in range(60 if "a" in sides else 0)]
    rows += [f"http://{host()}.org/es/{''.join(rng.choice('pqr') for _ in range(6))}" for _ in range(50 if "b" in sides else 0)]
    rows += [f"http://{host()}.io/{''.join(rng.choice('pqrxyz') for _ in range(8))}" for _ in range(60)] + rows[:20] + [None, "none", "x://", "x://", "x://a", "x://é.io/日本"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judged(spark, pages, order=2).collect()}
    key = {i: r.host + r.path for i, r in got.items()}
    rule = {key[i]: None if r.rule is None else r.rule == "net/de/" for i, r in got.items()}
    score, threshold = plain_verdicts(set(rule), rule, Counter(key.values()), 2)
    for i, r in got.items():
        assert r.score == pytest.approx(score[key[i]], abs=2e-6)
        if rule[key[i]] is not None:
            assert r.verdict == ("allow" if rule[key[i]] else "block")
        elif abs(score[key[i]] - threshold) > 1e-5 or score[key[i]] == threshold == 0:
            assert r.verdict == ("allow" if score[key[i]] >= threshold else "block")
    assert len(got) == len(rows)
