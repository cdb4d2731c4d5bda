"""Nearest neighbours against brute force: norms that are far apart, hubs, many rows."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from spanloom.llm import ann  # noqa: E402


def nearest_and_wanted(spark, x, every):
    x = x.astype(np.float32)
    queries = np.arange(0, len(x), every)
    exact = x[queries].astype(np.float64) @ x.astype(np.float64).T
    exact[np.arange(len(queries)), queries] = -np.inf
    want = {(int(q), int(v)) for q, row in zip(queries, exact, strict=True) for v in np.argsort(-row, kind="stable")[:20]}
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    return {(r.query_id, r.vec_id) for r in ann.nearest(frame, F.col("vec_id") % every == 0).collect()}, want


@pytest.mark.parametrize("ratio", [1e8])
def test_one_vector_of_a_large_norm(spark, ratio):
    x = np.random.default_rng(6).standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= ratio
    got, want = nearest_and_wanted(spark, x, 20)
    assert len(got & want) >= 0.95 * len(want)


def test_recall_of_many_vectors_with_hubs(spark, monkeypatch):
    # hubs are asked for by all queries: their blocks' requests are dealt over parts
    monkeypatch.setattr(ann, "REQUEST_BYTES", 64 << 10)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20_000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:40] *= 3.0
    x[41] *= 1e6
    got, want = nearest_and_wanted(spark, x, 100)
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
