"""The pipeline's near-dedup takes its pairs from SimHash, and from the prefix filter what SimHash leaves apart."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from spanloom.llm import near_copies  # noqa: E402
from test_near_copies import brute_kept, shingle_set  # noqa: E402


def copies(rates, many):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    base = [[rng.choice(words) for _ in range(200)] for _ in range(12)]
    return [(k, " ".join(w if rng.random() > rng.choice(rates) else "new%d" % rng.randrange(10**6) for w in base[k % 12])) for k in range(many)]


def kept(spark, rows):
    return sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())


def linked_far(rows):
    """Pairs with Jaccard >= 0.8 whose fingerprints are over RADIUS bits apart."""
    sets = [shingle_set(t) for _, t in rows]
    fps = [near_copies.majority(near_copies.shingles(t.encode())) for _, t in rows]
    close = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return sum((fps[i] ^ fps[j]).bit_count() > near_copies.RADIUS for i, j in close)


def test_simhash_alone_finds_what_is_within_its_radius(spark, monkeypatch):
    # the prefix filter gives nothing
    none = lambda rows, parts: rows.sparkSession.createDataFrame([], "a long, b long")
    monkeypatch.setattr(near_copies, "_first_pairs", none)
    monkeypatch.setattr(near_copies, "_further_pairs", none)
    rows = copies((0.001,), 60)
    assert linked_far(rows) == 0
    assert kept(spark, rows) == sorted(brute_kept(rows)) == list(range(12))


@pytest.mark.parametrize("links, most, bins", [(4, 64, 1 << 15), (1, 1, 1 << 15), (2, 64, 8)])
def test_no_pair_is_lost_beyond_the_radius_or_over_the_caps(spark, monkeypatch, links, most, bins):
    monkeypatch.setattr(near_copies, "LINKS", links)
    monkeypatch.setattr(near_copies, "MOST", most)
    monkeypatch.setattr(near_copies, "BIN", bins)
    rows = copies((0.005, 0.015, 0.025), 120)
    assert linked_far(rows) > 0
    assert kept(spark, rows) == sorted(brute_kept(rows))


def test_pairs_within_the_radius_come_once(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [int(base[k % 40]) ^ sum(1 << int(b) for b in rng.choice(64, k % 9, replace=False)) for k in range(200)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    sets = spark.createDataFrame([(k, 100, signed(x)) for k, x in enumerate(fps)], "id long, n long, fp long")
    old, near_copies.LINKS = near_copies.LINKS, 1000
    try:
        got = [tuple(r) for r in near_copies._fingerprint_pairs(sets, 4).collect()]
    finally:
        near_copies.LINKS = old
    want = {(i, j) for j in range(200) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= near_copies.RADIUS}
    assert len(got) == len(set(got)) and set(got) == want
