"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then Hamming distance.

Fingerprints: a shingle's XXH64 bits are counted over the whole text; a bit is 1 if set in over half of the
shingles. Equal fingerprints are one class. Two fingerprints that differ in at most 4 bits agree in one of 5
blocks of the 64 bits, and the bits outside that block again agree in one of 5 blocks; so each distinct
fingerprint has 25 keys, each of 23 exact bits, and linked fingerprints share a key. Where a key still has
more than GROUP fingerprints, its bits outside are split into 5 blocks again and so on, which leaves fewer
than 2^17 distinct fingerprints at the last level, whatever the input. Within a key every pair is verified by
its Hamming distance, in blocks, but only one link for each fingerprint and tree of links goes out: as many
links as fingerprints, not as pairs. Links become components.

Defined results: a null or blank text has fingerprint zero and is linked like any other; null doc_ids get a
row, take no part in a component's smallest doc_id, and have a null component if nothing else is in it;
repeated rows each get a row; an empty table gives no rows; other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, written
from .graph import components

WORDS, BITS, SEED = 4, 4, 42
GROUP = 20_000
LEVELS = 6


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    h = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest

    split = text.lower().split()  # of bytes: A-Z alone, and splits at \x20 and \x09-\x0D
    if not split:
        return 0
    joined, n = b" ".join(split), len(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if n <= words:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _split(masks: list[int]) -> list[int]:
    """Each mask of fixed bits with, besides, each of 5 blocks of the other bits."""
    out = []
    for mask in masks:
        free = [b for b in range(64) if not mask >> b & 1]
        for k in range(BITS + 1):
            out.append(mask | sum(1 << b for b in free[k * len(free) // (BITS + 1) : (k + 1) * len(free) // (BITS + 1)]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _first_keys(fps: DataFrame) -> DataFrame:
    """fp, path (which of the 25 masks), key (the bits under it)."""
    masks = F.array(*[F.lit(_signed(m)) for m in _split(_split([0]))])
    return fps.select("fp", F.posexplode(masks).alias("path", "mask")).select("fp", "path", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def _further_keys(rest: DataFrame, level: int) -> DataFrame:
    """fp, path, key with 5 finer masks for each row (fp, path) of the level before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [0]
        for _ in range(level + 1):
            masks = _split(masks)
        finer = np.array(masks, np.uint64)
        for batch in batches:
            path = (batch.column(1).to_numpy()[:, None] * (BITS + 1) + np.arange(BITS + 1)).ravel()
            fp = np.repeat(batch.column(0).to_numpy(), BITS + 1)
            key = (fp.view(np.uint64) & finer[path]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(path, pa.int32()), pa.array(key)], ["fp", "path", "key"])

    return rest.select("fp", "path").mapInArrow(run, "fp long, path int, key long")


def tree_links(fps: np.ndarray, bits: int = BITS, block: int = 1024) -> list[tuple[int, int]]:
    """Pairs of positions that link what pairs within `bits` link, a tree for each component: at most a pair
    for each fingerprint. Every pair of components is compared until one link is found or none is left."""
    n = len(fps)
    root = np.arange(n)
    links: list[tuple[int, int]] = []
    for i in range(0, n, block):
        a = fps[i : i + block]
        for j in range(0, i + 1, block):
            b = fps[j : j + block]
            near = np.bitwise_count(a[:, None] ^ b[None, :]) <= bits
            near &= root[i : i + block][:, None] != root[j : j + block][None, :]
            x, y = np.nonzero(near)
            while len(x):
                # one link for each pair of trees
                rx, ry = root[i + x], root[j + y]
                lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
                keep = lo != hi
                if not keep.any():
                    break
                x, y, lo, hi = x[keep], y[keep], lo[keep], hi[keep]
                first = np.unique(hi, return_index=True)[1]  # each tree with a larger root joins one other
                to = np.arange(n)
                to[hi[first]] = lo[first]
                links += zip((i + x[first]).tolist(), (j + y[first]).tolist(), strict=True)
                while (to[to] != to).any():
                    to = to[to]
                root = to[root]
    return links


def _link_groups(keyed: DataFrame) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        fps = np.sort(group.column("fp").to_numpy().view(np.uint64))
        found = tree_links(fps)
        a, b = (np.array(found, np.int64).reshape(-1, 2)).T
        return pa.table({"a": fps[a].view(np.int64), "b": fps[b].view(np.int64)})

    return keyed.groupBy("path", "key").applyInArrow(run, "a long, b long")


def links(fps: DataFrame) -> DataFrame:
    """a, b: pairs of distinct fingerprints (fp) whose components are those of all pairs within 4 bits."""
    out, keyed = None, _first_keys(fps)
    for level in range(2, LEVELS + 1):
        keyed = written(keyed, "blocks")
        sizes = keyed.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        most = sizes.agg(F.max("n").alias("n")).first()["n"] or 0
        last = level == LEVELS or most <= GROUP
        now = sizes if last else sizes.filter(F.col("n") <= GROUP)
        found = _link_groups(keyed.join(now.select("path", "key"), ["path", "key"], "left_semi"))
        out = found if out is None else out.unionByName(found)
        if last:
            break
        keyed = _further_keys(keyed.join(sizes.filter(F.col("n") > GROUP).select("path", "key"), ["path", "key"], "left_semi"), level)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (long), fingerprint (hex), component_id."""
    made = written(fingerprints(docs, words), "fingerprints")
    classes = written(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprint-classes")
    joined = written(components(links(classes.select("fp"))), "fingerprint-nodes")
    linked = joined.join(classes, joined["node"] == classes["fp"]).select("fp", "least", "component")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "component").select("fp", "component_id")
    classes = classes.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    joined = join_counted(made, written(classes, "fingerprint-components"), "fp", "n")
    return joined.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
