"""Rows that the search makes before it ranks them."""

import numpy as np
from sievework.llm import ann


def test_rows_found_grow_with_queries(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUCKETS", 4, raising=False)
    monkeypatch.setattr(ann, "LEAF_ROWS", 8)
    made, ranked = [], ann._ranked
    monkeypatch.setattr(ann, "_ranked", lambda hits, k: made.append(hits) or ranked(hits, k))
    points = np.random.default_rng(1).normal(size=(600, 8))
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    out = ann.search(rows, every=10)
    assert out.count() == 60 * 5
    assert made[-1].count() <= 60 * 4 * 5
