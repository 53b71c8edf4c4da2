import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tabgraph.llm import language, mixing, neighbours, quality, simhash, urls
from tabgraph.llm.components import components

DIR = "/root/testdata/sf0.01"


def docs_of(spark, rows):
    """With a column whose name operators use themselves."""
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, score string")


# 3


def filled(sizes, weights=(5, 2, 1)):
    w = {s: weights[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    goal, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = sum(w[s] for s in sizes if s not in full)
        level = (goal - sum(2 * sizes[s] for s in full)) / rest if rest else 0
        more = {s for s in sizes if s not in full and level * w[s] > 2 * sizes[s]}
        if not more:
            return {s: 2 * sizes[s] if s in full else level * w[s] for s in sizes}
        full |= more


def test_mixing(spark):
    rows = [(i, "w " * (i % 17 + 1), "en", f"s{i % 7}" if i % 11 else None) for i in range(400)] + [(None, "a b", "en", None), (7, None, "en", "s1"), (7, "", "en", "empty")]
    docs = docs_of(spark, rows)
    got = mixing.plan(spark, docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = filled(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.05 * want[s])
    assert sorted(map(str, mixing.plan(spark, docs).collect())) == sorted(map(str, got))
    m = mixing.mixed(spark, docs)
    assert m.columns == docs.columns and m.count() == sum(r.copies for r in got)
    assert mixing.plan(spark, docs.limit(0)).count() == mixing.mixed(spark, docs.limit(0)).count() == 0


# 4


def test_language_on_held_out_rows(spark):
    got = {r.doc_id: r for r in language.op4_language(spark, DIR).collect()}
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) == len(rows) and all(got[r.doc_id].held_out for r in held)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97


def test_language_of_odd_texts(spark):
    rows = [(k, t, lang, "s") for k in range(30) for t, lang in (("the cat and the dog of the house", "en"), ("der hund und die katze im haus", "de"))]
    odd = [(1000, None, None, "s"), (1001, "12 34 !", None, "s"), (None, "the dog", None, "s"), (1002, "und die katze " * 5000, None, "s"), (1002, "und die katze", None, "s")]
    got = language.languages(spark, docs_of(spark, rows + odd)).where("doc_id is null or doc_id >= 1000").collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "en"), (1000, "und"), (1001, "und"), (1002, "de"), (1002, "de")]
    assert all(0 <= r.score <= 1 for r in got)
    nothing = language.languages(spark, docs_of(spark, [(1, "abc", None, "s")])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
    assert language.languages(spark, docs_of(spark, rows[:1]).limit(0)).count() == 0


# 6


def test_every_code_within_the_radius_is_found():
    """By probing and by comparing all, whichever the radius calls for."""
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**64, (6000, 4), dtype=np.uint64)
    for i in range(200):
        codes[i] = codes[5000]
        for bit in rng.choice(256, i, replace=False):
            codes[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    index = neighbours.Index(codes)
    assert index.probing(31) and not index.probing(48)
    asked = np.concatenate([codes[:60:7], codes[5000:5002]])
    for r in (0, 1, 15, 16, 31, 40, 100, 256):
        for q, got in zip(asked, index.within(asked, r), strict=True):
            assert got.tolist() == np.flatnonzero(np.bitwise_count(codes ^ q).sum(1) <= r).tolist()
    assert len(next(index.within(codes[5000:5001], 31))) == 33


def brute_neighbours(rows, k):
    """Per query the best (-score, vec_id), repeats included; of several vectors of a query's id the least is asked for."""
    rows = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    asked = {}
    for i, v in rows:
        if i % 20 == 0:
            asked[i] = min(asked.get(i, v), v, key=lambda x: (len(x), x))
    dot = lambda a, b: float((np.array(a) * np.array(b)).sum())
    return {i: sorted((-dot(q, v), j) for j, v in rows if j != i and len(v) == len(q))[:k] for i, q in asked.items()}


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((900, 24)) * rng.uniform(0.5, 2, (900, 1))
    v[100:140] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2020, [0.0] * 24), (2040, [math.nan] * 24), (2060, [1.0, None]), (2080, []), (None, v[0].tolist()), (3000, [1.0, 2.0]), (3001, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(spark, df).collect()
    want, hit, total = brute_neighbours(rows, 20), 0, 0
    for q in range(0, 900, 20):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        assert all(r.score == pytest.approx(float(v[q] @ v[r.vec_id]), abs=1e-12) for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hit, total = hit + len({j for _, j in want[q]} & {r.vec_id for r in own}), total + 20
    assert hit / total >= 0.9
    assert [(r.vec_id, r.score) for r in got if r.query_id == 3000] == [(3001, 5.0)]
    assert {r.query_id for r in got} == {*range(0, 900, 20), 3000}
    assert neighbours.nearest(spark, df.limit(0)).count() == 0


def test_neighbours_of_equal_vectors_and_repeated_ids(spark):
    """Fewer rows than k, so that the result is exact: ties, repeated rows, one id with several vectors."""
    a, b = [1.0, 2.0, 0.5], [2.0, 1.0, 0.5]
    rows = [(i, a) for i in (20, 21, 22, 7, 7, 40, 40)] + [(40, b), (3, b), (60, [-1.0, 0.0, 0.0]), (60, [-2.0, 0.0, 0.0]), (-20, b)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    for k in (1, 2, 5, 30):
        got = sorted(map(tuple, neighbours.nearest(spark, df, k=k).collect()))
        want = [(q, n + 1, j, -s) for q, best in sorted(brute_neighbours(rows, k).items()) for n, (s, j) in enumerate(best)]
        assert got == [(*w[:3], pytest.approx(w[3])) for w in want]


def test_recall_on_the_given_vectors(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = Counter((r.query_id, r.vec_id) for r in neighbours.op6_neighbours(spark, "/root/testdata/sf0.1").collect())
    want = brute_neighbours(rows, 20)
    assert sum((q, j) in got for q, best in want.items() for _, j in best) / sum(map(len, want.values())) >= 0.9


# 7 and 8


def test_quality_on_held_out_rows(spark):
    got = {r.doc_id: r for r in quality.op7_quality(spark, DIR).collect()}
    held = [r for r in spark.read.parquet(f"{DIR}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in held)
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.95


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_of_odd_tables(spark):
    docs = docs_of(spark, [(1, None, "en", "s"), (None, "", "en", "s"), (2, "word " * 30000, "en", "s"), (2, "word", "en", "s")])
    for labels in ([], [(1, None, 0), (None, 1, 0)], [(1, 1, 0), (1, 0, 0), (2, 1, 0)]):
        assert quality.quality_scores(spark, docs, labels_of(spark, labels)).count() == 4
        got = quality.rule_verdicts(spark, docs, labels_of(spark, labels)).collect()
        assert len(got) == 4 and not any(r.kept for r in got)
        kept = quality.accepted(spark, docs, labels_of(spark, labels))
        assert kept.columns == docs.columns and kept.count() <= 4
    assert {r.score for r in quality.quality_scores(spark, docs, labels_of(spark, [])).collect()} == {0.5}
    assert quality.within_rules(spark, docs.limit(0), labels_of(spark, [])).count() == 0


def test_rule_statistics():
    text = "a b c a b c x\n\nline one\nline one\n \n \n#1 $2 | é\tz\x0bq"
    words = text.encode().split()
    covered = set()
    spans = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    for i, w in enumerate(spans):
        if spans.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    (n, chars, symbols, dup, repeat), _ = quality.statistics(text)
    assert (n, dup, repeat, symbols) == (len(words), 1, len(covered), 3) and chars == sum(len(w.decode()) for w in words)
    assert quality.statistics("")[0] == [0] * 5
    assert quality.repeated_words([b"x"] * 5) == 5 and quality.repeated_words([b"x"] * 3) == 0


def test_rules_keep_the_clean(spark):
    got = {r.doc_id: r for r in quality.op8_rules(spark, DIR).collect()}
    rows = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()]
    good, bad = ([g.kept for g, q in rows if q == k and not g.base_failed] for k in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.4


def test_the_forest_finds_what_stands_apart():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), rng.normal(8, 0.1, (10, 3))])
    s = quality.IsolationForest(x).scores(x)
    assert s[500:].min() > np.quantile(s[:500], 0.97)


# 9


def brute(texts, radius=3):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        out.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)))
    parent = list(range(len(out)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(out)):
        for j in range(i):
            if (out[i] ^ out[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return out, [find(i) for i in range(len(out))]


@pytest.mark.parametrize("crowd", [64, 1])
def test_simhash_is_brute_force(spark, monkeypatch, crowd):
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join([*base[:i], f"new{i}", *base[i + 1 :]]) for i in range(60)] * 2 + [" ".join(base)] * 5 + ["", None, "one", "One two", "ONE TWO", "a b c d", "A  b\tc d"]
    monkeypatch.setattr(simhash, "CROWD", crowd)
    docs = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    fps, comp = brute(texts)
    got = {r.doc_id: r for r in simhash.near_duplicates(spark, docs).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i].component_id for i in range(len(texts))] == comp
    kept = simhash.deduplicated(spark, docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(comp))


def test_balls_alone_lose_no_link(spark, monkeypatch):
    """Random walks of 1 to 4 bits, all sent through the whole-ball way."""
    monkeypatch.setattr(simhash, "CROWD", 0)
    rng = np.random.default_rng(4)
    fps = [int(x) for x in rng.integers(0, 2**63, 12, dtype=np.uint64)]
    for _ in range(150):
        x = fps[rng.integers(len(fps))]
        for k in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(k)
        fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    root = {r.node: r.root for r in components(spark, simhash.links(spark, df)).collect()}
    label = [root.get(simhash.signed(x), simhash.signed(x)) for x in fps]
    _, want = brute_links(fps)
    assert all((label[i] == label[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))


def brute_links(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return None, label


def test_simhash_of_odd_tables(spark):
    rows = [(5, "a b c", "en", "s"), (5, "a b c", "en", "s"), (None, "a b c", "en", "s"), (None, "zz", "en", "s"), (9, "q " * 50000, "en", "s")]
    docs = docs_of(spark, rows)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark, docs).collect()), key=str)
    assert got == [(5, 5), (5, 5), (9, 9), (None, 5), (None, None)]
    assert simhash.deduplicated(spark, docs).count() == 3
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == simhash.deduplicated(spark, docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, 301), (301, 300), (400, 400)], "a long, b long")
    assert {r.node: r.root for r in components(spark, e).collect()} == {i: 0 for i in range(201)} | {300: 300, 301: 300}


# 10


def python_model(counts, order):
    """The recursion of the two models, gram by gram."""
    letters = len({g[-1] for g in counts})

    def p(g, side):
        below = p(g[1:], side) if len(g) > 1 else 1 / (letters + 1)
        k = len(g)
        n = sum(c[side] for x, c in counts.items() if x[-k:-1] == g[:-1]) if k > 1 else sum(c[side] for c in counts.values())
        t = len({x[-1] for x, c in counts.items() if c[side] and (k == 1 or x[-k:-1] == g[:-1])})
        own = sum(c[side] for x, c in counts.items() if x[-k:] == g)
        return (own + t * below) / (n + t) if n + t else below

    return {g: math.log(p(g, 0) / p(g, 1)) for g in counts}


def test_url_models(spark):
    counts = {"aab": (3, 0), "abc": (2, 5), "bca": (0, 1), "xab": (0, 0), "cab": (1, 1)}
    df = spark.createDataFrame([(g, a, r) for g, (a, r) in counts.items()], "gram string, acc long, rej long")
    want = python_model(counts, 2)
    for r in urls.log_ratios(df, 2).collect():
        assert r.ratio == pytest.approx(want[r.gram], abs=1e-12)


def test_url_rules_and_verdicts(spark):
    rows = [("https://WWW.Example.COM/en/71?q", "www.example.com", "/en/71", "example.com/en/7", "allow"), ("http://a.com/en/8", "a.com", "/en/8", "com/en/", "block"), ("x://net/de/", "net", "/de/", "net/de/", "allow"), ("x://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"), ("x://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"), ("x://a.org/es/1#x", "a.org", "/es/1", "org/es/", "block"), ("x://a.org?b/es/", "a.org", "", None, None), ("a.com/en/1", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("x://ÀB.com", "Àb.com", "", None, None)]
    pages = spark.createDataFrame([(i, r[0], "h") for i, r in enumerate(rows)] * 2 + [(None, "x://a.com/fr/" + "z" * 5000, "h")], "page_id long, url string, host string")
    got = urls.judged(spark, pages).collect()
    assert len(got) == 2 * len(rows) + 1
    for r in got:
        if r.page_id is not None:
            _, host, path, rule, verdict = rows[r.page_id]
            assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert urls.judged(spark, pages.limit(0)).count() == 0


# pipeline


def test_pipeline(spark):
    import corpus_pipeline as P
    from tabgraph.llm import bytebpe

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    score = {r.doc_id for r in quality.quality_scores(spark, docs, labels).where("predicted = 1").collect()}
    kept = docs.where(docs.doc_id.isin(list(score)))
    rules = {r.doc_id for r in quality.rule_verdicts(spark, kept, labels).where("kept").collect()}
    rows = kept.where(docs.doc_id.isin(list(rules))).orderBy("doc_id").collect()
    _, comp = brute([r.text for r in rows])
    unique = {rows[i].doc_id for i in set(comp)}
    left = kept.where(docs.doc_id.isin(list(unique)))
    copies = {r.doc_id: r.copies for r in mixing.plan(spark, left).collect()}
    got = P.run(spark, DIR).collect()
    assert Counter(r.doc_id for r in got) == {k: n for k, n in copies.items() if n}
    text = {r.doc_id: r.text for r in rows}
    codec = bytebpe.codec(bytebpe.TOKENIZERS + "byte_bpe_multi_50k.tiktoken")
    assert all(r.n_tokens == len(codec.encode(text[r.doc_id])) // 4 for r in got)
