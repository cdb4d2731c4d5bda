"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's byte n-grams (2 to 4 bytes, A-Z lower-cased) are hashed into BUCKETS embeddings; the average of a
text's embeddings goes through a linear layer and a softmax. As both are linear, prediction uses the product
of the two, a row of scores for each bucket, so that a text costs one look-up for each n-gram. Training
takes PER_LANG labelled documents of each language at most (those with the smallest hashes; this bounds what
the driver holds), each also as a snippet of a few words, and sets a fifth aside, near copies of a document always
with it: on these the softmax's temperature is fitted (calibration), and then the rejection threshold, below which errors outweigh
KEEP times the correct documents lost, or half of the lowest score of a correct one where none errs.

Defined results: a text that is null or has no letter is `und` with score 0 and is rejected; with no labelled
document at all, every text is `und`; a null doc_id is not held out and not trained on; repeated rows each
get a row; an empty table gives no rows; other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled
from .simhash import fingerprint, tree_links

BUCKETS_LOG2, DIM, ORDERS = 15, 16, (2, 3, 4)
PER_LANG, EPOCHS, RATE = 400, 6, 8.0
KEEP, COPY_BITS = 50, 10
SLICE = 1 << 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # a row for each bucket: what it adds to each language
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0


def buckets(text: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets of a text's n-grams, in runs of bounded length."""
    for at in range(0, len(text), SLICE):
        piece = LOWER[text[at : at + SLICE + max(ORDERS) - 1]].astype(np.uint32)
        for n in ORDERS:
            m = min(SLICE, len(piece) - n + 1)
            if m <= 0:
                continue
            code = piece[:m].copy()
            for k in range(1, n):
                code <<= np.uint32(8)
                code |= piece[k : k + m]
            code += np.uint32(0x9E3779B1) * np.uint32(n % 2)
            yield (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS_LOG2)


def features(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and their share of all."""
    counts = np.zeros(1 << BUCKETS_LOG2, np.int64)
    for b in buckets(text):
        counts += np.bincount(b, minlength=len(counts))
    found = np.flatnonzero(counts)
    return found.astype(np.int32), (counts[found] / max(1, counts.sum())).astype(np.float32)


def logits(text: np.ndarray, model: Model) -> np.ndarray:
    total, n = np.zeros(len(model.langs)), 0
    for b in buckets(text):
        total += model.scores[b].sum(axis=0, dtype=np.float64)
        n += len(b)
    return total / max(1, n) + model.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], langs: list[str], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares, language) rows to (scores, bias)."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (1 << BUCKETS_LOG2, DIM)).astype(np.float32) / DIM
    w, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            idx, share, lang = rows[k]
            rate = np.float32(RATE * (1 - done / steps))
            own = emb[idx]
            x = share @ own
            g = -_softmax(x @ w + bias).astype(np.float32)
            g[lang] += 1
            back = w @ g
            w += rate * 0.1 * np.outer(x, g)
            bias += rate * 0.01 * g
            emb[idx] = own + rate * np.outer(share, back)
            done += 1
    return emb @ w, bias.astype(np.float64)


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """Sets the temperature (least log loss on rows) and the rejection threshold."""
    if not rows:
        return
    z = np.array([share @ model.scores[idx] + model.bias for idx, share, _ in rows])
    y = np.array([lang for _, _, lang in rows])

    def probabilities(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(probabilities(t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = probabilities(model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    lowest = 1.0 / len(model.langs)
    if right.all():
        model.threshold = float(top.min() / 2)
    else:
        cuts = np.concatenate(([lowest], np.sort(top[~right]) + 1e-9))
        gain = [(top[~right] < c).sum() - KEEP * (top[right] < c).sum() for c in cuts]
        model.threshold = float(cuts[int(np.argmax(gain))])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _folds(fps: list[int], folds: int = 5) -> list[int]:
    """A fold for each fingerprint; near copies are in one."""
    names, of = np.unique(np.array(fps, np.int64), return_inverse=True)
    root = np.arange(len(names))
    for a, b in tree_links(names.view(np.uint64), bits=COPY_BITS):
        root[root == max(root[a], root[b])] = min(root[a], root[b])
    return (names[root[of]].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) % np.uint64(folds)).tolist() if len(names) else []


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Fits on the labelled rows (doc_id, text, lang) of docs, per_lang of each language at most."""
    labelled = docs.filter("doc_id is not null and text is not null and lang is not null")
    chosen = sampled(labelled.select("doc_id", "lang").distinct(), "lang", per_lang, [F.xxhash64("doc_id", F.lit("sample")), "doc_id"])
    texts = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])  # per_lang rows of each language
    texts = texts.groupBy("doc_id", "lang", "nth").agg(F.min("text").cast("binary").alias("text"))  # a doc_id may stand on any number of rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"lang": [], "nth": [], "idx": [], "share": [], "fp": []}
            for lang, text, nth in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                whole = np.frombuffer(text.as_buffer(), np.uint8)
                words, fp = text.as_buffer().to_pybytes().split(), fingerprint(text.as_buffer().to_pybytes())
                at = nth * 7919 % max(1, len(words))
                snippet = np.frombuffer(b" ".join(words[at : at + 2 + nth % 7]), np.uint8)
                for part in (whole, snippet):
                    idx, share = features(part)
                    if len(idx):
                        for k, v in zip(out, (lang, nth, idx.tobytes(), share.tobytes(), fp), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["lang"], pa.string()), pa.array(out["nth"], pa.int32()), pa.array(out["idx"], pa.binary()), pa.array(out["share"], pa.binary()), pa.array(np.array(out["fp"], np.uint64).view(np.int64))], list(out))

    sample = texts.select("lang", "text", "nth").mapInArrow(run, "lang string, nth int, idx binary, share binary, fp long").collect()
    sample = sorted((r["lang"], r["nth"], bytes(r["idx"]), bytes(r["share"]), r["fp"]) for r in sample)
    langs = sorted({r[0] for r in sample})
    fold = _folds([r[4] for r in sample])
    rows = [(k, (np.frombuffer(i, np.int32), np.frombuffer(s, np.float32), langs.index(lang))) for k, (lang, _, i, s, _) in zip(fold, sample, strict=True)]
    if not rows:
        return Model([], np.zeros((1 << BUCKETS_LOG2, 0)), np.zeros(0))
    scores, bias = train([r for k, r in rows if k] or [r for _, r in rows], langs)
    model = Model(langs, scores.astype(np.float32), bias)
    calibrate(model, [r for k, r in rows if not k])
    return model


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.scores, model.bias, model.temperature, model.threshold))  # BUCKETS rows, whatever the input
    own = docs.select("doc_id", *keep, F.when(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)), F.col("text").cast("binary")).alias("_bytes"))
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            langs, score, rejected = [], [], []
            for text in batch.column(len(names)):
                if not text.is_valid or not m.langs:
                    langs.append("und"), score.append(0.0), rejected.append(True)
                    continue
                p = _softmax(logits(np.frombuffer(text.as_buffer(), np.uint8), m) / m.temperature)
                k = int(p.argmax())
                langs.append(m.langs[k]), score.append(float(p[k])), rejected.append(bool(p[k] < m.threshold))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    schema = own.drop("_bytes").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return own.mapInArrow(run, schema)


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for all of docs, learnt from what is not held out."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))), per_lang)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """The rows of docs that are not rejected."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))), per_lang)
    columns = docs.columns
    plain = docs.toDF(*[f"_{k}" for k in range(len(columns))])  # names of docs may clash with those of predict
    plain = plain.withColumn("doc_id", F.col(f"_{columns.index('doc_id')}")).withColumn("text", F.col(f"_{columns.index('text')}"))
    kept = predict(plain, model, tuple(f"_{k}" for k in range(len(columns)))).filter("not rejected")
    return kept.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(columns)])
