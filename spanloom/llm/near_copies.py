"""The pipeline's near-dedup: all pairs of texts whose sets of five-word shingles have Jaccard >= 0.8.

SimHash, with settings of its own (op5 keeps the contract's): a set's fingerprint has the bits that over half of its
shingles' hashes have. Two fingerprints within RADIUS bits agree in two of RADIUS + 2 blocks of the 64 bits, so each set has
a key for every two blocks, and sets that share a key are compared by Hamming distance. A set is a candidate with
the LINKS nearest of the first MOST sets before it, in an order by hash, that are within RADIUS under a key, and with LINKS
in all, so that copies in any number give a few candidates each; sets of a key with more than about BIN fall into bins.
Candidates get their exact Jaccard, pairs at 0.8 or more are links, links become components.

Fingerprints at Jaccard 0.8 differ in about 10 bits, some in up to 20: no radius that can be searched has all pairs. The rest, pairs
that are in different components after that, comes from a prefix filter, which loses none: with all shingles in
one fixed order, two sets with Jaccard >= 0.8 share one of the first n - ceil(0.8 n) + 1 shingles of each. Any order is
right; shingles that are frequent in a sample of the texts come last, which keeps the groups of texts that share a
shingle small. All pairs of a group that have fitting lengths and different components are candidates. In groups of over about
GROUP sets a pair comes from its smallest shared shingle alone, and what there is to compare is dealt by pairs
of blocks of about BLOCK sets, so that no large group meets in one task. A sample of the sets tells which groups are
large, which decides the way alone: either way finds all pairs. A candidate goes if its bucket counts alone prove too many
differences; the rest get their exact Jaccard too.

Shingles are XXH64 hashes of lower-cased words as in op5; a text of fewer words is one shingle. Equal sets are one
class. Defined results: null and blank texts are copies of each other; rows with a null doc_id stay; an empty table
gives no rows; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ann import _flat, _groups
from .common import discard, few, join_counted, written
from .graph import components
from .simhash import majority

WORDS, SEED = 5, 42
RADIUS, LINKS, MOST, BIN = 10, 4, 64, 1 << 15
GROUP, BLOCK = 64, 4096
BUCKETS, LEAST = 256, 8
#: One of so many is sampled for the order of shingles and the sizes of groups; those found in COMMON of them, at most MOST_COMMON, come last.
SAMPLED, COMMON, MOST_COMMON = 8, 3, 200_000


def shingles(text: bytes) -> np.ndarray:
    """The set of the text's shingles, sorted."""
    from xxhash import xxh64_intdigest

    split = text.lower().split()  # of bytes: A-Z alone, and splits at \x20 and \x09-\x0D
    if not split:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(split), len(split)
    if n <= WORDS:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: n - WORDS + 1].tolist(), ends[WORDS - 1 :].tolist(), strict=True)), np.uint64, n - WORDS + 1))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _buckets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_buffer() for v in column), np.uint8).reshape(-1, BUCKETS)


def _may_be_similar(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sets with Jaccard >= 0.8 differ in a ninth of the sum n of their sizes at most, and bucket counts, even cut off at
    255, in no more."""
    return 9 * np.abs(x.astype(np.int16) - y).sum(axis=1, dtype=np.int64) <= n


def _text_key() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that are frequent in the sample, and how frequent: for the order alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_buffer().to_pybytes()) for t in batch.column(0)]
            s, n = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n.astype(np.int64))], ["s", "n"])

    sample = docs.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64(F.lit(2), "text"), F.lit(SAMPLED)) == 0)).select(F.col("text").cast("binary").alias("text"))
    counts = sample.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "s").limit(MOST_COMMON).toArrow()
    s = found.column("s").to_numpy().view(np.uint64)
    o = np.argsort(s)
    return s[o], found.column("n").to_numpy()[o]


def _classes(docs: DataFrame) -> DataFrame:
    """id, least (doc_id and text key of the row with the smallest doc_id), h1, h2 (the key of one of the texts),
    n, fp, prefix, counts: a row for each distinct set."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(_common(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = order.value
        for batch in batches:
            digest, size, fps, prefix, counts = [], [], [], [], []
            for t in batch.column(3):
                s = shingles(t.as_buffer().to_pybytes())
                n = len(s)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                size.append(n)
                fps.append(majority(s))
                counts.append(np.minimum(np.bincount((s % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes())
                rank = np.zeros(n, np.int64)
                if len(common) and n:
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    rank = np.where(common[at] == s, often[at], 0)
                first = np.lexsort((s, rank))[: n - -(-4 * n // 5) + 1 if n else 0]
                prefix.append(s[first].view(np.int64))
            offsets = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*prefix, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), lists, pa.array(counts, pa.binary())], ["doc_id", "h1", "h2", "digest", "n", "fp", "prefix", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_key(), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, h1 long, h2 long, digest binary, n long, fp long, prefix array<long>, counts binary")
    of_set = F.first(F.struct("h1", "h2", "n", "fp", "prefix", "counts")).alias("x")
    # ids hold as the table is written once
    return written(rows.groupBy("digest").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h1", "h2"))).alias("least"), of_set).select(F.monotonically_increasing_id().alias("id"), "least", "x.*"), "shingle-classes")


def _blocks() -> list[tuple[int, int]]:
    """First bit and width of each of RADIUS + 2 blocks of a fingerprint."""
    starts = [64 * k // (RADIUS + 2) for k in range(RADIUS + 3)]
    return [(a, b - a) for a, b in zip(starts, starts[1:], strict=False)]


def _keyed(sets: DataFrame) -> DataFrame:
    """id, n, fp, key (path << 32 and more) for every two blocks (path); sets has id, n, fp."""
    blocks = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in _blocks()]
    wide = max(w for _, w in _blocks())
    keys = [(F.lit(path).cast("long") * (1 << 2 * wide)) + blocks[i] * (1 << wide) + blocks[j] for path, (i, j) in enumerate(combinations(range(len(blocks)), 2))]
    keyed = sets.select("id", "n", "fp", F.explode(F.array(*keys)).alias("key"))
    some = keyed.filter(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(SAMPLED)) == 0)
    # one for each BIN rows at most
    large = some.groupBy("key").agg((SAMPLED * F.count(F.lit(1))).alias("m")).filter(F.col("m") > BIN)
    bins = F.coalesce(F.ceil(F.col("m") / F.lit(BIN)), F.lit(1)).cast("long")
    path = F.shiftright("key", 2 * wide)
    place = F.pmod(F.col("key"), F.lit(1 << 2 * wide)) * F.lit(1 << 32 - 2 * wide) + F.pmod(F.xxhash64("id", F.lit(5)), bins)
    return keyed.join(F.broadcast(large), "key", "left").select("id", "n", "fp", (F.shiftleft(path, 32) + place).alias("key"))


def _nearest(fps: np.ndarray, n: np.ndarray, differ: list[np.uint64], radius: int, links: int, most: int, block: int = 1024) -> tuple[np.ndarray, ...]:
    """a, b, h: positions of each set and its `links` nearest of about the first `most` sets before it that are within
    radius (h bits), of a fitting length, and differ under each of the masks."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i in range(0, len(fps), block):
        end = min(i + block, len(fps))
        left, found, near = np.arange(i, end), np.zeros(end - i, np.int64), []
        for j in range(0, end, block):
            x = fps[left][:, None] ^ fps[j : min(j + block, end)][None]
            u, v = np.nonzero(np.bitwise_count(x) <= radius)
            x, u, v = x[u, v], left[u], j + v
            keep = v < u
            if not keep.any():
                continue
            x, u, v = x[keep], u[keep], v[keep]
            keep = 5 * np.minimum(n[u], n[v]) >= 4 * np.maximum(n[u], n[v])
            for mask in differ:
                keep &= x & mask != 0
            near.append((u[keep], v[keep], np.bitwise_count(x[keep]).astype(np.int64)))
            found += np.bincount(u[keep] - i, minlength=end - i)
            left = left[found[left - i] < most]
            if not len(left):
                break
        if near:
            u, v, h = (np.concatenate(c) for c in zip(*near, strict=True))
            o = np.lexsort((v, h, u))
            u, v, h = u[o], v[o], h[o]
            few_ = np.arange(len(u)) - np.searchsorted(u, u) < links
            out.append((u[few_], v[few_], h[few_]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _fingerprint_pairs(classes: DataFrame, parts: int) -> DataFrame:
    """a, b: each set with LINKS at most of those whose fingerprints are within RADIUS."""
    masks = [((1 << w) - 1) << a for a, w in _blocks()]
    # of the keys that a pair shares the first alone gives it: that of its first two equal blocks
    differ = [[np.uint64(masks[k]) for k in range(j) if k != i] for i, j in combinations(range(len(masks)), 2)]
    radius, links, most = RADIUS, LINKS, MOST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "key"):
            key, ids, n, fps = (t.column(c).to_numpy() for c in ("key", "id", "n", "fp"))
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(first, len(key)))
            fps = fps.view(np.uint64)
            for a, m in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                x, y, h = _nearest(fps[a : a + m], n[a : a + m], differ[int(key[a]) >> 32], radius, links, most)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + x]), pa.array(ids[a + y]), pa.array(h)], ["a", "b", "h"])

    keyed = _keyed(classes.select("id", "n", "fp")).repartition(parts, "key").sortWithinPartitions("key", F.xxhash64("id"), "id")
    near = keyed.mapInArrow(run, "a long, b long, h long")
    nearest = Window.partitionBy("a").orderBy("h", F.xxhash64("b"), "b")
    near = near.withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= LINKS)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _first_pairs(tokens: DataFrame, parts: int) -> DataFrame:
    """a, b: the pairs of fitting lengths and different components in each token's group of rows (id, n, component, token),
    about GROUP of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "token"):
            token, ids, n, tree = (t.column(c).to_numpy() for c in ("token", "id", "n", "component"))
            first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in range(1, int(np.diff(np.append(first, len(token))).max())):
                near = np.flatnonzero((token[:-d] == token[d:]) & (tree[:-d] != tree[d:]) & (5 * n[:-d] >= 4 * n[d:]))  # sorted by n
                out_a.append(ids[near])
                out_b.append(ids[near + d])
            pairs = _once(np.concatenate(out_a), np.concatenate(out_b))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in pairs], ["a", "b"])

    return tokens.repartition(parts, "token").sortWithinPartitions("token", "n", "id").mapInArrow(run, "a long, b long")


def _further_pairs(large: DataFrame, parts: int) -> DataFrame:
    """a, b out of rows (token, id, n, m, component, counts, least): pairs of a token whose components are different and
    whose bucket counts leave room for 0.8. Of the tokens that a pair shares the smallest alone gives it, as far as the
    LEAST smallest of both sets' prefixes tell; that one's group, if it is a small one, gives the pair. A token's
    sets fall into blocks, and each pair of blocks is a group (key) of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "key"):
            key, token, block, one, ids, n, tree = (t.column(c).to_numpy(zero_copy_only=False) for c in ("key", "token", "block", "one", "id", "n", "component"))
            counts = t.column("counts").combine_chunks()
            counts = _buckets(pa.concat_arrays(counts.chunks) if isinstance(counts, pa.ChunkedArray) else counts)
            size, values = _flat(t.column("least"))
            least = np.full((len(size), LEAST), np.iinfo(np.int64).max)
            least[np.arange(LEAST)[None] < size[:, None]] = values
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
                for i in range(a, b, 512):
                    rows = slice(i, min(i + 512, b))
                    end = a + int(np.searchsorted(n[a:b], n[rows][-1] * 5 // 4, side="right"))  # sorted by n
                    for j in range(i, end, 4096):
                        others = slice(j, min(j + 4096, end))
                        due = (block[rows][:, None] != block[others][None]) | one[rows][:, None]
                        x, y = np.nonzero(due & (tree[rows][:, None] != tree[others][None]) & (5 * n[rows][:, None] >= 4 * n[others][None]) & (np.arange(i, rows.stop)[:, None] < np.arange(j, others.stop)[None]))
                        for k in range(0, len(x), 1 << 16):
                            p, q = i + x[k : k + (1 << 16)], j + y[k : k + (1 << 16)]
                            before = ((least[p][:, :, None] == least[q][:, None, :]) & (least[p][:, :, None] < token[p][:, None, None])).any(axis=(1, 2))
                            p, q = p[~before], q[~before]
                            fit = _may_be_similar(counts[p], counts[q], n[p] + n[q])
                            pairs = _once(ids[p[fit]], ids[q[fit]])
                            yield pa.RecordBatch.from_arrays([pa.array(v) for v in pairs], ["a", "b"])

    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    dealt = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("key", F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other"))).withColumn("one", F.col("block") == F.col("other"))
    dealt = dealt.repartition(parts, "key").sortWithinPartitions("key", "n", "id")
    return dealt.select("key", "token", "block", "one", "id", "n", "component", "counts", "least").mapInArrow(run, "a long, b long")


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity is 0.8 or more."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            x, y = (_buckets(batch.column(k)) for k in (4, 5))
            yield batch.filter(pa.array(_may_be_similar(x, y, n))).select(["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column(2), batch.column(3), strict=True)
            yield batch.filter(pa.array([similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in sets], pa.bool_())).select(["a", "b"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_buffer().to_pybytes()).tobytes() for t in batch.column(1)], pa.binary())], ["id", "s"])

    side = lambda df, id_, *names: df.select(F.col("id").alias(id_), *[F.col(c).alias(c + id_) for c in names])
    both = pairs.join(side(classes, "a", "n", "counts"), "a").join(side(classes, "b", "n", "counts"), "b")
    left = written(both.select("a", "b", "na", "nb", "countsa", "countsb").mapInArrow(possible, "a long, b long"), "near-possible")
    wanted = left.select(F.col("a").alias("id")).unionByName(left.select(F.col("b").alias("id"))).distinct()
    wanted = written(classes.select("id", "h1", "h2").join(wanted, "id", "left_semi"), "near-wanted")
    texts = docs.select(*_text_key(), F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(few(wanted), ["h1", "h2"])
    sets = written(texts.groupBy("id").agg(F.first("text").alias("text")).mapInArrow(make, "id long, s binary"), "near-sets")
    both = left.join(side(sets, "a", "s"), "a").join(side(sets, "b", "s"), "b")
    links = written(both.select("a", "b", "sa", "sb").mapInArrow(exact, "a long, b long"), "near-links", instead_of=sets)
    discard(left, wanted)
    return links


def near_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of docs, and id, component of those that have links."""
    classes = _classes(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = written(_fingerprint_pairs(classes, parts), "near-fingerprints")
    links = _links(docs, classes, pairs)
    discard(pairs)
    joined = written(components(links).withColumnRenamed("node", "id"), "near-components")
    # the rest: what SimHash has left in different components
    tokens = classes.select("id", "n", F.explode("prefix").alias("token"))
    some = tokens.filter(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(SAMPLED)) == 0)
    sizes = written(some.groupBy("token").agg((SAMPLED * F.count(F.lit(1))).alias("m")).filter(F.col("m") > GROUP), "near-sizes")
    large = written(join_counted(tokens, sizes, "token", "m").select("token", "id", "n", "m"), "near-large")
    component = F.coalesce("component", "id").alias("component")
    small = classes.select("id", "n", "prefix").join(joined, "id", "left").select("id", "n", component, F.explode("prefix").alias("token"))
    small = small.join(few(sizes.select("token")), "token", "left_anti")
    named = large.join(joined, "id", "left").withColumn("component", component)
    apart = named.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("token")
    named = named.join(apart, "token", "left_semi").join(classes.select("id", "counts", F.slice(F.array_sort("prefix"), 1, LEAST).alias("least")), "id")
    rest = written(_first_pairs(small, parts).unionByName(_further_pairs(named, parts)).distinct(), "near-pairs")
    discard(sizes, large)
    if not rest.isEmpty():
        more = _links(docs, classes, rest)
        joined = written(components(links.unionByName(more)).withColumnRenamed("node", "id"), "near-components", instead_of=joined)
        discard(more)
    discard(rest, links)
    return classes, joined


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id. Rows with a null doc_id stay."""
    classes, joined = near_copies(docs)
    named = classes.select("id", "least").join(joined, "id", "left").select("least", F.coalesce("component", "id").alias("component"))
    # a doc_id may stand on rows of several components: a row is known by its doc_id and text
    keep = named.groupBy("component").agg(F.min("least").alias("x")).filter("x is not null")
    keep = written(keep.select(F.col("x.doc_id").alias("_doc_id"), F.col("x.h1").alias("_h1"), F.col("x.h2").alias("_h2")), "near-kept", instead_of=classes)
    discard(joined)
    h1, h2 = _text_key()
    keyed = docs.withColumns({"_h1": h1, "_h2": h2})
    same = (keyed["doc_id"] == keep["_doc_id"]) & (keyed["_h1"] == keep["_h1"]) & (keyed["_h2"] == keep["_h2"])
    once = Window.partitionBy("doc_id", "_h1", "_h2").orderBy("_h1")
    named = keyed.join(keep, same, "left_semi").withColumn("_nth", F.row_number().over(once)).filter("_nth = 1").drop("_h1", "_h2", "_nth")
    return named.unionByName(docs.filter("doc_id is null"))
