"""Toxicity by cumulative-link ordinal regression.

Grades 0 to 3: labelled clean documents are 0; labelled toxic ones are 1 to 3, by thirds of how toxic they look to a
model fitted on the other half of the sample (two folds, near copies in one), so that no document's grade comes from
a model that has seen it. One weight vector is shared by the three ordered thresholds, P(grade >= k) = sigmoid(w.x - t_k), so a
word moves all grades alike. Features are the log counts of telling words and beginnings of words (4 to 6 bytes).
Candidates are the MOST_FEATURES whose document frequencies among toxic and clean documents differ by most standard
errors, MIN_Z at least, in either direction. Of those that tell toxic documents, one after the other is taken that
best tells those toxic documents that have fewer than COVER of those taken before (and is not in SAME of the
documents of one of them), so that the other words of a much-copied toxic document stay out; of those that tell
clean documents, the MOST_CLEAN best. Fitting takes PER_CLASS labelled documents of either kind (those with the
smallest hashes), all features on all of them; all documents are scored, over their whole texts. The output is the
expected severity, the sum of P(grade >= k), the most likely grade, and whether w.x is past the cut at which the
sample has the fewest errors (a clean document flagged counts as FALSE_ALARM missed ones).

Defined results: a null text has no words and gets what the thresholds alone give. Without labels of both kinds
there is nothing to learn: severity and grade are 0 and toxic is false. With both kinds but no telling feature, the
model is its thresholds: every document gets the sample's mean severity, and toxic is false. A document with more
than one label counts with the larger, one with more than one text with the smallest; null doc_ids and repeated
rows each get a row; an empty table gives no rows; other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled
from .simhash import fingerprint, tree_links

PER_CLASS, MIN_Z, MIN_DOCS, MOST_FEATURES, MOST_CLEAN, COVER, GRADES, COPY_BITS, SAME, FALSE_ALARM = 1500, 4.0, 5, 512, 16, 3, 4, 10, 0.8, 5
_BLANKS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
LOWER_WORDS = bytes(ord(chr(c).lower()) if 65 <= c <= 90 else c for c in _BLANKS)


def words(text: bytes) -> list[bytes]:
    """Words of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased."""
    return text.translate(LOWER_WORDS).split()


def tokens(word: bytes) -> list[bytes]:
    """The features that a word gives: itself and its beginnings."""
    return [b"=" + word, *(b"^" + word[:n] for n in (4, 5, 6) if len(word) >= n)]


class Counter:
    """Counts known features in texts; a word is looked at closely only if its first 4 bytes begin one."""

    def __init__(self, known: list[bytes]):
        self.known = {w: k for k, w in enumerate(known)}
        self.heads = {w[1:5] for w in known}

    def __call__(self, text: bytes) -> dict[int, int]:
        heads, found = self.heads, {}
        for w in words(text):
            if w[:4] in heads:
                for t in tokens(w):
                    k = self.known.get(t)
                    if k is not None:
                        found[k] = found.get(k, 0) + 1
        return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int = GRADES, l2: float = 1e-3, steps: int = 800, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the cumulative-link likelihood. Thresholds are the first one and
    positive steps from it, so they stay in order."""
    n, k = x.shape[1], grades - 1
    p = np.concatenate((np.zeros(n), [1.0], np.zeros(k - 1)))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        gaps = np.exp(p[n + 1 :])
        t = p[n] + np.concatenate(([0.0], np.cumsum(gaps)))
        s = x @ p[:n]
        above = np.hstack((np.ones((len(s), 1)), _sigmoid(s[:, None] - t[None, :]), np.zeros((len(s), 1))))
        prob = np.maximum(above[np.arange(len(y)), y] - above[np.arange(len(y)), y + 1], 1e-12)
        slope = above * (1 - above)
        up, down = slope[np.arange(len(y)), y] / prob, slope[np.arange(len(y)), y + 1] / prob
        g_s = up - down
        g_t = np.zeros(k)
        np.add.at(g_t, y[y > 0] - 1, -up[y > 0])
        np.add.at(g_t, y[y < k], down[y < k])
        grad = np.concatenate((x.T @ g_s / len(y) - l2 * p[:n], [g_t.sum() / len(y)], np.cumsum(g_t[::-1])[::-1][1:] * gaps / len(y)))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:n], p[n] + np.concatenate(([0.0], np.cumsum(np.exp(p[n + 1 :]))))


def select_words(has: np.ndarray, toxic: np.ndarray, width: list[int]) -> list[int]:
    """The columns of has (documents by features) to take, in their order: of those that tell about as well as
    the best, the widest, which is the least likely to begin other words too."""
    clean_share = has[~toxic].mean(axis=0)
    taken: list[int] = []
    same = np.zeros(has.shape[1], bool)
    while True:
        open_ = toxic & (has[:, taken].sum(axis=1) < COVER)
        share = has[open_].sum(axis=0) / max(1, toxic.sum())
        both = (share * toxic.sum() + clean_share * (~toxic).sum()) / len(toxic)
        z = (share - clean_share) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / max(1, toxic.sum()) + 1 / max(1, (~toxic).sum())))
        z[same] = -1
        near = np.flatnonzero(z >= 0.97 * z.max()) if len(z) else []
        best = max(near, key=lambda k: (width[k], z[k], -k)) if len(near) else 0
        if not len(z) or z[best] <= (0 if not taken else MIN_Z / 5):
            return taken
        taken.append(best)
        mine = has[:, best]
        same |= (has & mine[:, None]).sum(axis=0) >= SAME * (has | mine[:, None]).sum(axis=0)


def best_cut(s: np.ndarray, toxic: np.ndarray) -> float:
    values = np.unique(s)
    cuts = np.concatenate(((values[:-1] + values[1:]) / 2, [values[-1] + 1]))
    errors = [(toxic & (s < c)).sum() + FALSE_ALARM * (~toxic & (s >= c)).sum() for c in cuts]
    return float(cuts[int(np.argmin(errors))])


def _counts(texts: DataFrame, vocabulary: list[bytes]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """toxic, the text's fingerprint, counts: in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vocabulary)
        for batch in batches:
            found = [sorted(count(t.as_buffer().to_pybytes()).items()) for t in batch.column(1)]
            lists = [pa.array([[x[j] for x in f] for f in found], pa.list_(pa.int32())) for j in (0, 1)]
            fps = np.array([fingerprint(t.as_buffer().to_pybytes()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(fps)], ["toxic", "k", "n", "fp"])

    rows = texts.select("toxic", "text").mapInArrow(run, "toxic int, k array<int>, n array<int>, fp long").collect()  # of the sample
    return sorted((r["toxic"], r["fp"], sorted(zip(r["k"], r["n"], strict=True))) for r in rows)


def _without_copies(texts: DataFrame) -> DataFrame:
    """One document of each group of near copies, so that a much-copied document's own words tell nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = sorted((r["doc_id"], r["fp"]) for r in texts.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long").collect())  # of the sample
    near = tree_links(np.array([fp for _, fp in rows], np.int64).view(np.uint64), bits=COPY_BITS)
    root = list(range(len(rows)))
    for a, b in sorted((min(x), max(x)) for x in near):
        ra, rb = root[a], root[b]
        root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    keep = [(rows[k][0],) for k in range(len(rows)) if root[k] == k]
    kept = texts.sparkSession.createDataFrame(keep, "doc_id long").distinct()
    return texts.join(F.broadcast(kept), "doc_id")  # no more rows than the sample


def graded(x: np.ndarray, toxic: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """0 for clean documents; for toxic ones 1 to 3, by thirds of what a model fitted on the other fold gives them."""
    y = np.zeros(len(toxic), np.int64)
    for k in (0, 1):
        mine, other = fold == k, fold != k
        if not (mine & toxic).any():
            continue
        if not (other & toxic).any() or not (other & ~toxic).any():
            other = np.ones(len(toxic), bool)  # too few documents for two folds
        w, _ = fit_ordinal(x[other], toxic[other].astype(np.int64), grades=2)
        s = x[mine] @ w
        cuts = np.quantile(s[toxic[mine]], [1 / 3, 2 / 3])
        y[mine] = np.where(toxic[mine], 1 + (s > cuts[0]) + (s > cuts[1]), 0)
    return y


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[bytes], np.ndarray, np.ndarray, float] | None:
    """Telling features, weights, thresholds, the cut; none without labels of both kinds."""
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = sampled(marked, "toxic", per_class, [F.xxhash64("doc_id", F.lit("sample")), "doc_id"])
    texts = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * per_class rows
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").cast("binary").alias("text"))  # a doc_id may stand on any number of rows
    texts = _without_copies(texts).select("toxic", "text").persist()

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [(k, w) for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for w in {b"", *(x for w in set(words(t.as_buffer().to_pybytes())) for x in tokens(w))}]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in each], pa.int32()), pa.array([w for _, w in each], pa.binary())], ["toxic", "word"])

    per_word = texts.mapInArrow(distinct, "toxic int, word binary").groupBy("word").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    whole = per_word.filter(F.length("word") == 0).first()
    if not whole or not whole["a"] or not whole["b"]:
        texts.unpersist()
        return None
    rate = (F.col("a") + F.col("b")) / (whole["a"] + whole["b"])
    z = (F.col("a") / whole["a"] - F.col("b") / whole["b"]) / F.sqrt(rate * (1 - rate) * (1 / whole["a"] + 1 / whole["b"]))
    telling = per_word.filter((F.length("word") > 0) & (F.col("a") + F.col("b") >= MIN_DOCS) & (rate < 1)).withColumn("z", z).filter(F.abs("z") >= MIN_Z)
    ranked = lambda rows, most: [bytes(r["word"]) for r in rows.orderBy(F.abs("z").desc(), F.length("word"), "word").limit(most).collect()]
    candidates, clean = ranked(telling.filter("z > 0"), MOST_FEATURES), ranked(telling.filter("z < 0"), MOST_CLEAN)
    rows = _counts(texts, candidates + clean)
    texts.unpersist()
    counts = np.zeros((len(rows), len(candidates) + len(clean)))
    for i, (_, _, found) in enumerate(rows):
        for k, n in found:
            counts[i, k] = n
    toxic = np.array([r[0] for r in rows]) == 1
    taken = select_words(counts[:, : len(candidates)] > 0, toxic, [len(f) + 100 * (f[:1] == b"=") for f in candidates]) if candidates else []
    taken += range(len(candidates), counts.shape[1])
    x = np.log1p(counts[:, taken])
    fold = np.array([r[1] for r in rows], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)
    vocabulary = [(candidates + clean)[k] for k in taken]
    w, t = fit_ordinal(x, graded(x, toxic, fold))
    return vocabulary, w, t, best_cut(x @ w, toxic) if vocabulary else float("inf")


def severity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, severity (expected grade), grade (most likely), toxic."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))  # MOST_FEATURES words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, w, t, cut = model.value or ([], np.zeros(0), np.full(GRADES - 1, 40.0), 1.0)
        count, weight = Counter(vocabulary), w.tolist()
        for batch in batches:
            s = np.array([sum(weight[k] * np.log1p(n) for k, n in sorted(count(x.as_buffer().to_pybytes()).items())) for x in batch.column(1)], float)
            above = _sigmoid(s[:, None] - t[None, :])
            each = -np.diff(np.hstack((np.ones((len(s), 1)), above, np.zeros((len(s), 1)))), axis=1)
            total = above.sum(axis=1) if model.value else np.zeros(len(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(s >= cut)], ["doc_id", "severity", "grade", "toxic"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")
