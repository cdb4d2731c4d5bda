"""Decontamination where ids are null or repeated."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from spanloom.llm import decontam  # noqa: E402


def test_null_and_repeated_ids_are_judged(spark):
    item, other = "how many moons does the planet jupiter have", "what is the capital of the old kingdom"
    rows = [(None, f"so {item} then"), (1, f"so {item} then"), (2, f"see {other} here"), (2, "a clean text"), (None, "another clean text"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (7, other), (8, None)], "item_id long, text string")
    got = {tuple(r) for r in decontam.without_leaks(docs, bench).collect()}
    assert got == {(2, "a clean text"), (None, "another clean text"), (3, None)}
    assert {tuple(r) for r in decontam.find_leaks(docs, bench).select("doc_id", "item_id").collect()} == {(2, 7)}
