import math
import random

from tabgraph.llm import quality


def test_the_forest_decides_without_bad_labels(spark):
    rng = random.Random(3)
    plain = [(i, " ".join("w" * rng.randint(3, 7) + str(rng.randrange(10**6)) for _ in range(80))) for i in range(300)]
    odd = (300, " ".join(f"{'A' * 30}!|#{i}|!" for i in range(80)))
    docs = spark.createDataFrame([*plain, odd], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    assert all(math.isfinite(t) for _, t in quality.fit_rules(spark, docs, labels))
    kept = {r.doc_id for r in quality.within_rules(spark, docs, labels).collect()}
    assert 300 not in kept and len(kept) >= 0.99 * 300
