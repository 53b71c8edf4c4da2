"""Operator 8 learns from every labelled row, however many there are."""

import math
import random

import numpy as np
import pytest

from tabgraph.llm import quality

ROWS = 2 * quality.SAMPLE + 500


def tables(spark):
    """(doc_id, text, measures) and labels for all but each 13th row; the last column only stands in the way."""
    rng = random.Random(5)
    rows = []
    for i in range(ROWS):
        mark = "#|" if i % 10 == 0 else ""
        rows.append((i, " ".join("w" * rng.randint(2, 8) + str(rng.randrange(10**5)) + mark * rng.randint(0, 2) for _ in range(rng.randint(48, 70))), i % 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string, measures int").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(ROWS) if i % 13], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def whole(rows):
    """The forests and thresholds of all labelled rows, grown in memory, and each row's verdict by them."""
    got = [quality.statistics(text) for _, text, _ in rows]
    x = np.array([r for _, r in got])
    passed = np.array([c[0] >= 50 and 2 * c[4] <= c[0] for c, _ in got])
    ids = np.arange(len(rows))
    known, good = passed & (ids % 13 > 0), ids % 10 > 0
    out, kept = [], passed.copy()
    for at in quality.FORESTS:
        forest = quality.IsolationForest(x[known][:, at])
        score = forest.scores(x[:, at])
        out.append((forest, quality.calibrated(score[known & good], score[known & ~good], 0.0025)))
        kept &= score < out[-1][1]
    return out, int(known.sum()), kept


def test_forests_and_thresholds_of_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "PART", 1500)
    docs, labels, rows = tables(spark)
    want, n, kept = whole(rows)
    assert n > 2 * quality.SAMPLE - 1000
    got = quality.fit_rules(spark, docs, labels)
    for (forest, threshold), (own, limit) in zip(got, want):
        assert forest.size == own.size == n
        for name in ("feature", "split", "path"):
            assert np.array_equal(getattr(forest, name), getattr(own, name))
        assert threshold == pytest.approx(limit, rel=1e-12)
    verdicts = {r.doc_id: r.kept for r in quality.rule_verdicts(spark, docs, labels).collect()}
    assert len(verdicts) == ROWS and all(verdicts[i] == kept[i] for i in range(ROWS))


def test_the_pipelines_stage_learns_from_all_labelled_rows(spark, tmp_path):
    import corpus_pipeline as P

    docs, labels, rows = tables(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    _, _, kept = whole(rows)
    got = P.quality_rules(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [r for r, k in zip(rows, kept) if k]


@pytest.mark.parametrize("clean, bad, share", [(40, 30, 0.05), (900, 50, 0.3), (25, 0, 0.1), (0, 9, 0.1), (7, 7, 0)])
def test_thresholds_by_counts(spark, clean, bad, share):
    rng = random.Random(clean)
    sides = [np.array([round(rng.random(), 2) for _ in range(n)]) for n in (clean, bad)]
    rows = [(k == 0, int(b)) for k, side in enumerate(sides) for b in side.view(np.int64)]
    got = quality.calibrated_rows(spark.createDataFrame(rows, "good boolean, bits long"), share)
    assert got == quality.calibrated(*sides, share) or math.isinf(got) and not clean
