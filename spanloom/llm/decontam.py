"""Benchmark decontamination by pigeonhole edit matching.

A document leaks an item if some part of it is within the item's error budget (RATE of its length) in edit
distance, both lower-cased and with runs of white space as one blank. An item is split into one piece more than
its budget, so a leak holds at least one piece unchanged. One pass of an Aho-Corasick automaton over each whole
document finds all pieces; around each hit, Myers' bit-parallel algorithm verifies the distance. Items go through
in blocks of BLOCK_CHARS, each a pass of its own, so that an automaton has a bounded size whatever the benchmark's.

Defined results: null and blank items leak nowhere, null texts leak nothing; items with one text are found each;
rows with one doc_id each give their own result rows; items with a null item_id have no result rows, but the
pipeline's stage judges by texts alone and drops what leaks them, whatever the doc_ids; empty tables give no rows; other columns, whatever their
names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, written

RATE = 0.05
BLOCK_CHARS = 2_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item's budget + 1 pieces with their places."""
    n = budget + 1
    cuts = [k * len(item) // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def peq(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << k
    return out


def least_distance(m: int, masks: dict[str, int], text: str) -> tuple[int, int]:
    """Myers: the least edit distance between the item and any part of text, and where that part ends."""
    every, high = (1 << m) - 1, 1 << m - 1
    plus, minus, score = every, 0, m
    best, at = m, 0
    for k, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (every & ~(xh | plus))
        down = plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            if score < best:
                best, at = score, k + 1
        up = up << 1 & every
        down = down << 1 & every
        plus = down | (every & ~(xv | up))
        minus = up & xv
    return best, at


class Finder:
    """An automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, int(len(t) * rate), peq(t)) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, budget, _) in enumerate(self.items):
            for at, piece in pieces(t, budget):
                places.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def leaks(self, text: str) -> list[tuple[int, int, int]]:
        """item_id, least distance and the end of that place in the normalized text."""
        if not self.any or not text:
            return []
        starts: dict[int, set[int]] = {}
        for end, (n, found) in self.automaton.iter(text):
            for k, at in found:
                starts.setdefault(k, set()).add(end + 1 - n - at)
        out = []
        for k, found in starts.items():
            item, t, budget, masks = self.items[k]
            best, where = budget + 1, 0
            todo = sorted(found)
            i = 0
            while i < len(todo) and best:
                j = i
                while j + 1 < len(todo) and todo[j + 1] - todo[i] <= len(t):
                    j += 1
                a, b = max(0, todo[i] - budget), todo[j] + len(t) + budget
                d, end = least_distance(len(t), masks, text[a:b])
                if d < best:
                    best, where = d, a + end
                i = j + 1
            if best <= budget:
                out.append((item, best, where))
        return sorted(out)



def _found(texts: DataFrame, items: DataFrame, rate: float, block_chars: int) -> DataFrame:
    """texts: k1, k2 (a key), text; items: item_id, text, no nulls. Gives k1, k2, item_id, distance, end."""
    spark = texts.sparkSession
    items = items.filter("trim(text) <> ''")
    sizes = written(items.select("item_id", F.length("text").cast("long").alias("n")).groupBy("item_id").agg(F.sum("n").alias("n")), "item-sizes")
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_chars))
    out = None
    for k in range(blocks):
        # a block of bounded size: items are dealt by hash over total / block_chars blocks
        mine = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).select("item_id", "text").collect()
        block = spark.sparkContext.broadcast(sorted((r["item_id"], t) for r in mine if (t := normal(r["text"]))))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            finder = Finder(block.value, rate)
            for batch in batches:
                rows = [(j, d, *leak) for j, d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True) for leak in finder.leaks(normal(t.as_py()))]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["k1", "k2", "item_id", "distance", "end"])

        found = texts.mapInArrow(run, "k1 long, k2 long, item_id long, distance long, end long")
        out = found if out is None else out.unionByName(found)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, end (in the normalized text): a row for each document and item it leaks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("item_id is not null")
    texts = docs.select(F.col("doc_id").cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "text").filter("text is not null")
    return _found(texts, items, rate, block_chars).select(F.col("k1").alias("doc_id"), "item_id", "distance", "end")


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs but for those whose text leaks an item; the ids of either may be null or repeated."""
    items = benchmark.select(F.xxhash64("text").alias("item_id"), "text")
    keyed = docs.withColumns({"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(1), "text")})
    texts = keyed.filter("text is not null").select(F.col("_h1").alias("k1"), F.col("_h2").alias("k2"), "text")
    leaking = written(_found(texts, items, rate, BLOCK_CHARS).select(F.col("k1").alias("_h1"), F.col("k2").alias("_h2")).distinct(), "leaking")
    return keyed.join(few(leaking), ["_h1", "_h2"], "left_anti").select(*docs.columns)
