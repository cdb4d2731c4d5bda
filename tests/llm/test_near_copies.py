"""The pipeline's near-dedup against brute force."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from spanloom.llm import near_copies  # noqa: E402


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    left, kept = set(sets), set()
    while left:
        i = min(left)
        seen, todo = {i}, [i]
        while todo:
            x = sets[todo.pop()]
            new = {j for j in left - seen if x == sets[j] or 5 * len(x & sets[j]) >= 4 * len(x | sets[j])}
            seen |= new
            todo += new
        kept.add(i)
        left -= seen
    return kept


@pytest.mark.parametrize("group, block", [(64, 4096), (3, 4096), (3, 5)])
def test_near_copies_at_all_similarities(spark, monkeypatch, group, block):
    monkeypatch.setattr(near_copies, "GROUP", group)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    base = [[rng.choice(words) for _ in range(rng.choice((30, 120, 300)))] for _ in range(25)]
    line = " ".join(words[:12])
    rows = []
    for k in range(160):
        rate = rng.choice((0, 0.01, 0.02, 0.03, 0.05))
        rows.append((k, " ".join(w if rng.random() > rate else "new%d" % rng.randrange(10**6) for w in rng.choice(base)) + (" " + line if k % 3 else "")))
    rows += [(200, None), (201, " "), (202, "A b"), (203, "a  B"), (204, line), (205, line.upper())]
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sorted(got) == sorted(brute_kept(rows))


def test_repeated_doc_ids_lose_no_component(spark):
    one, two, other = ("the first text of five words or more", "a second text that shares nothing with it", "something else again in quite other words")
    # doc_id 3 stands on two components: one has a smaller doc_id elsewhere, the other has not
    rows = [(1, one), (3, one), (3, two), (3, two), (4, two), (3, other), (None, one)]
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sorted(got, key=str) == sorted([(1, one), (3, two), (3, other), (None, one)], key=str)
