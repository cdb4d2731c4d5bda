"""Suffix-array dedup of byte strings that repeat across documents, by deep-shallow sorting.

A byte goes if a string of `length` bytes over it also starts in a document with a smaller doc_id.

1. Equal texts (SHA-256) are one text: of their documents only the smallest doc_id takes part, all others
   are covered by it as a whole.
2. Anchors. Every window of `length` bytes has an anchor, the place of its smallest hashed gram. Equal windows
   have equal anchors, so a window can only repeat in another document if its anchor's gram does. Documents
   are dealt over chunks of bounded size; chunks send their distinct grams (4 bytes each), hash-dealt over
   groups, and get back which of them another chunk has too. Nothing is decided here: windows whose anchor
   is in one document alone have no partner to be sorted with.
3. Suffixes. The other windows, as blocks of neighbouring windows with one anchor, are dealt by their gram.
   In each group the suffixes that start at the windows are sorted deep-shallow: multikey quicksort, with
   8-byte words as characters, to a shallow depth; then blind tries over what is still equal, which branch on
   the first differing byte and skip the bytes before it. Suffixes with a common prefix of `length` are
   equal windows; all but those of the smallest document are marked. A chunk sorts what repeats within
   itself first and sends only what is left, so that a passage of any number of documents sends one block
   from each chunk.
4. Marks go back to their chunks, where the bytes are removed.

Defined results: a null text is empty; texts shorter than `length` stay whole; rows with one doc_id don't
remove from each other; a row with a null doc_id stays whole and removes nothing; repeated rows each get a
row; an empty table gives no rows; other columns, whatever their names, take no part.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

LENGTH = 50
CHUNK_BYTES, MOST_CHUNK_BYTES, CHUNKS = 2 << 20, 64 << 20, 4096
GRAMS_PER_GROUP = 1 << 20
BLOCK_BYTES = 4 << 20
PIECE = 1 << 18
SHALLOW_WORDS, LEAF = 2, 1 << 15
U64 = np.uint64
_rng = np.random.default_rng(20)
BYTE_HASH = _rng.integers(0, 1 << 64, 256, dtype=U64)
MUL = 0x9E3779B97F4A7C15
POSITION = (1 << 24) - 1


def _gram(length: int) -> int:
    return max(1, length * 2 // 5)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each place on, by doubling."""
    power, have, done = BYTE_HASH[data], 1, None
    n_done = 0
    left = gram
    mul = lambda k: U64(pow(MUL, k, 1 << 64))
    while left:
        if left & 1:
            if done is None:
                done, n_done = power, have
            else:
                n = len(power) - n_done
                done = done[:n] * mul(have) + power[n_done : n_done + n]
                n_done += have
        left >>= 1
        if left:
            n = len(power) - have
            power = power[:n] * mul(have) + power[have:]
            have *= 2
    done = done[: len(data) - gram + 1]
    done = done ^ (done >> U64(31))
    done *= U64(0xBF58476D1CE4E5B9)
    return done ^ (done >> U64(29))


def _rolling_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of windows of one text with one anchor: first window, number of windows, gram hash."""
    gram, outs = _gram(length), []
    for at in range(0, len(text) - length + 1, PIECE):
        h = gram_hashes(text[at : at + PIECE + length - 1], gram)
        key = (h & U64(~POSITION & (1 << 64) - 1)) | np.arange(len(h), dtype=U64)
        place = (_rolling_min(key, length - gram + 1) & U64(POSITION)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        outs.append((at + first, np.diff(np.append(first, len(place))), h[place[first]]))
    if not outs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return tuple(np.concatenate(x) for x in zip(*outs, strict=True))


# ---- deep-shallow sorting


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a big-endian number."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    w, have = padded.astype(U64), 1
    while have < 8:
        w = (w[: len(w) - have] << U64(8 * have)) | w[have:]
        have *= 2
    return w[: len(data)]


def multikey_quicksort(words: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """The order of suffixes by their first `depth` words: ternary splits around a pivot word, the middle one
    going on with the next word; small parts are sorted by their remaining words."""
    out, stack = [], [(np.arange(len(suffixes)), 0)]
    while stack:
        part, d = stack.pop()
        if d == depth or len(part) <= 1:
            out.append(part)
        elif len(part) <= LEAF:
            out.append(part[np.lexsort([words[suffixes[part] + 8 * k] for k in range(depth - 1, d - 1, -1)])])
        else:
            w = words[suffixes[part] + 8 * d]
            pivot = np.sort(w[:: max(1, len(w) // 1023)])
            pivot = pivot[len(pivot) // 2]
            stack += [(part[w > pivot], d), (part[w == pivot], d + 1), (part[w < pivot], d)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def blind_tries(data: np.ndarray, words: np.ndarray, suffixes: np.ndarray, groups: np.ndarray, length: int, depth: int) -> np.ndarray:
    """suffixes: in the order of their groups, those of a group with a common prefix of `depth` bytes. Builds the
    groups' blind tries together, level by level: a node's skip is the least common prefix of its suffixes
    with its first one, its children are told apart by the byte behind it alone. Gives each suffix its leaf:
    the position of the first suffix that is equal in the first `length` bytes, or its own."""
    leaf = np.arange(len(suffixes))
    active, group = np.arange(len(suffixes)), groups
    last = max(0, length - 8)
    while len(active):
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(first, len(group)))
        live = np.repeat(size > 1, size)
        active, group = active[live], group[live]
        if not len(active):
            break
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(first, len(group)))
        head = np.repeat(first, size)
        s, h = suffixes[active], suffixes[active[head]]
        common = np.full(len(s), length)
        open_ = np.flatnonzero(s != h)
        for off in [*range(depth, last, 8), last] if length >= 8 else [0]:
            x = words[s[open_] + off] ^ words[h[open_] + off]
            differ = x != 0
            at = open_[differ]
            # the first differing byte of a big-endian word
            zeros = 63 - np.floor(np.log2(np.maximum(x[differ] >> U64(8), U64(1)).astype(np.float64))).astype(np.int64)
            byte = np.where(x[differ] >> U64(8) == 0, 7, (zeros - 8) // 8)
            common[at] = np.minimum(off + byte, length)
            open_ = open_[~differ]
        skip = np.minimum.reduceat(common, first)
        done = np.repeat(skip >= length, size)
        leaf[active[done]] = active[head[done]]
        go = ~done
        s, group, skip_of = s[go], group[go], np.repeat(skip, size)[go]
        active = active[go]
        branch = group * 256 + data[s + skip_of]
        order = np.argsort(branch, kind="stable")
        active, branch = active[order], branch[order]
        group = np.cumsum(np.concatenate(([0], branch[1:] != branch[:-1]))) if len(branch) else branch
    return leaf


def equal_windows(data: np.ndarray, suffixes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each suffix (a place in data with `length` bytes) a class; equal windows have equal classes."""
    words = _words(data)
    depth = min(SHALLOW_WORDS, length // 8)
    order = multikey_quicksort(words, suffixes, depth)
    s = suffixes[order]
    same = np.ones(max(0, len(s) - 1), bool)
    for k in range(depth):
        w = words[s + 8 * k]
        same &= w[1:] == w[:-1]
    groups = np.cumsum(np.concatenate(([0], ~same))) if len(s) else np.zeros(0, np.int64)
    leaf = blind_tries(data, words, s, groups, length, 8 * depth)
    out = np.empty(len(s), np.int64)
    out[order] = leaf
    return out


def repeated_windows(data: np.ndarray, at: np.ndarray, windows: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For blocks (place in data, number of windows, doc_id): whether each window, in their order, is also in
    a block of a smaller doc_id."""
    total = int(windows.sum())
    suffixes = np.repeat(at - np.concatenate(([0], np.cumsum(windows)[:-1])), windows) + np.arange(total)
    docs = np.repeat(doc, windows)
    cls = equal_windows(data, suffixes, length)
    order = np.argsort(cls, kind="stable")
    if not total:
        return np.zeros(0, bool)
    c = cls[order]
    first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    least = np.minimum.reduceat(docs[order], first)
    out = np.empty(total, bool)
    out[order] = docs[order] > np.repeat(least, np.diff(np.append(first, total)))
    return out


def _runs(flags: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags within blocks: block, first window in the block, number of windows."""
    begin = np.zeros(len(flags), bool)
    begin[np.concatenate(([0], np.cumsum(windows)[:-1])).astype(np.int64)] = True
    block = np.repeat(np.arange(len(windows)), windows)
    starts = np.flatnonzero(flags & (begin | np.concatenate(([True], ~flags[:-1]))))
    stops = np.flatnonzero(flags & np.concatenate((begin[1:] | ~flags[1:], [True])))
    within = starts - (np.cumsum(windows) - windows)[block[starts]]
    return block[starts], within, stops - starts + 1


# ---- the plan

DOCS = "chunk long, doc_id long, text binary, sha binary"
SIDE = "to long, chunk long, kind int, n long, a binary, b binary, c binary, d binary"
BLOCKS, MARKS, MASK, FIRST = 0, 1, 2, 3


class Chunk:
    """The documents of a chunk that take part: one for each (doc_id, text), in their order."""

    def __init__(self, docs: pa.Table, firsts: pa.Table):
        known = set(zip(firsts.column("n").to_pylist(), firsts.column("a").to_pylist(), strict=True))
        ids, shas = docs.column("doc_id").to_pylist(), docs.column("sha").to_pylist()
        rows = {}
        for k, key in enumerate(zip(ids, shas, strict=True)):
            if key in known:
                rows.setdefault(key, k)
        self.keys = sorted(rows)
        self.ordinal = {key: k for k, key in enumerate(self.keys)}
        texts = docs.column("text").combine_chunks()
        self.texts = [np.frombuffer(texts[rows[key]].as_buffer(), np.uint8) for key in self.keys]
        self.ids = np.array([key[0] for key in self.keys], np.int64)

    def blocks(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """document, first window, number of windows, gram hash of each block."""
        found = [anchors(t, length) for t in self.texts]
        doc = np.repeat(np.arange(len(found)), [len(f[0]) for f in found]) if found else np.zeros(0, np.int64)
        return doc, *(np.concatenate([f[k] for f in found]) if found else np.zeros(0, U64 if k == 2 else np.int64) for k in range(3))


def _token(hashes: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Which group a gram hash is dealt to, and 4 bytes of it that tell it apart there."""
    return ((hashes >> U64(32)) % U64(groups)).astype(np.int64), (hashes & U64(0xFFFFFFFF)).astype(np.uint32)


def _tokens(hashes: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct grams of a chunk: group and token, in order, and which of them each block has."""
    group, token = _token(hashes, groups)
    pairs, which = np.unique(group.astype(U64) << U64(32) | token, return_inverse=True)
    return (pairs >> U64(32)).astype(np.int64), (pairs & U64(0xFFFFFFFF)).astype(np.uint32), which


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    names = ["to", "chunk", "kind", "n", "a", "b", "c", "d"]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _only(side: pa.Table, kind: int) -> pa.Table:
    return side.filter(pa.compute.equal(side.column("kind"), kind))


def _send_grams(length: int, groups: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows([])
        group, token, _ = _tokens(Chunk(docs, side).blocks(length)[3], groups)
        chunk, first = docs.column("chunk")[0].as_py(), np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))[: len(group)]
        return _rows([(int(group[a]), chunk, MASK, None, token[a:b].tobytes(), None, None, None) for a, b in zip(first, [*first[1:], len(group)], strict=True)])

    return run


def _shared_grams(rows: pa.Table) -> pa.Table:
    """For the grams that chunks sent to a group: which of each chunk's another chunk has too."""
    parts = [np.frombuffer(x, np.uint32) for x in rows.column("a").to_pylist()]
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    s = every[order]
    same = s[1:] == s[:-1]
    shared = np.zeros(len(s), bool)
    shared[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    out, at = [], 0
    for to, chunk, part in zip(rows.column("to").to_pylist(), rows.column("chunk").to_pylist(), parts, strict=True):
        mine = shared[at : at + len(part)]
        at += len(part)
        if mine.any():
            out.append((chunk, chunk, MASK, to, np.packbits(mine).tobytes(), None, None, None))
    return _rows(out)


def _gather(texts: list[np.ndarray], doc: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all blocks, one after the other."""
    whole = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
    base = np.cumsum([0, *map(len, texts)])[:-1]
    total = int(size.sum())
    return whole[np.repeat(base[doc] + at - (np.cumsum(size) - size), size) + np.arange(total)]


def _send_blocks(length: int, gram_groups: int, groups: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows([])
        chunk = docs.column("chunk")[0].as_py()
        own = Chunk(docs, _only(side, FIRST))
        doc, at, windows, hashes = own.blocks(length)
        group, token, which = _tokens(hashes, gram_groups)
        shared = np.zeros(len(token), bool)
        masks = _only(side, MASK)
        of = np.array(masks.column("n").to_pylist(), np.int64)
        for a, b, mask in zip(np.searchsorted(group, of), np.searchsorted(group, of, side="right"), masks.column("a").to_pylist(), strict=True):
            shared[a:b] = np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a).astype(bool)
        # grams of two documents of this chunk
        least, most = np.full(len(token), len(own.texts)), np.full(len(token), -1)
        np.minimum.at(least, which, doc)
        np.maximum.at(most, which, doc)
        local = (least < most)[which]
        keep = shared[which] | local
        doc, at, windows, hashes, local, among = doc[keep], at[keep], windows[keep], hashes[keep], local[keep], shared[which][keep]
        rows = []
        if local.any():
            size = windows[local] + length - 1
            data = _gather(own.texts, doc[local], at[local], size)
            again = repeated_windows(data, np.cumsum(size) - size, windows[local], own.ids[doc[local]], length)
            b, first, n = _runs(again, windows[local])
            rows.append((groups + chunk, chunk, MARKS, None, doc[local][b].astype(np.int32).tobytes(), (at[local][b] + first).tobytes(), n.astype(np.int32).tobytes(), None))
            b, first, n = _runs(~again, windows[local])
            rest = among[local][b]
            b, first, n = b[rest], first[rest], n[rest]
            only = ~local
            doc, at, windows, hashes = (np.concatenate((x[only], y)) for x, y in ((doc, doc[local][b]), (at, at[local][b] + first), (windows, n), (hashes, hashes[local][b])))
        to = (hashes % U64(groups)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        to, doc, at, windows = to[order], doc[order], at[order], windows[order]
        size = windows + length - 1
        data = _gather(own.texts, doc, at, size)
        ends = np.concatenate(([0], np.cumsum(size)))
        for a, b in zip(first_ := np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else [], [*first_[1:], len(to)] if len(to) else [], strict=True):
            which_doc = doc[a:b]
            rows.append((int(to[a]), chunk, BLOCKS, None, which_doc.astype(np.int32).tobytes() + own.ids[which_doc].tobytes(), at[a:b].tobytes(), windows[a:b].astype(np.int32).tobytes(), data[ends[a] : ends[b]].tobytes()))
        return _rows(rows)

    return run


def _sort_blocks(length: int):
    def run(rows: pa.Table) -> pa.Table:
        marks = _only(rows, MARKS)
        if marks.num_rows:
            return _rows([tuple(r.values()) for r in marks.to_pylist()])
        chunks, parts = rows.column("chunk").to_pylist(), []
        for a, b, c, d in zip(*(rows.column(k).to_pylist() for k in "abcd"), strict=True):
            n = len(c) // 4
            parts.append((np.frombuffer(a, np.int32, n), np.frombuffer(a, np.int64, n, 4 * n), np.frombuffer(b, np.int64), np.frombuffer(c, np.int32).astype(np.int64), np.frombuffer(d, np.uint8)))
        ordinal, ids, at, windows, data = (np.concatenate([p[k] for p in parts]) for k in range(5))
        of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        size = windows + length - 1
        again = repeated_windows(data, np.cumsum(size) - size, windows, ids, length)
        b, first, n = _runs(again, windows)
        cuts = np.searchsorted(of[b], np.arange(len(parts) + 1))
        out = []
        for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if y > x:
                i = b[x:y]
                out.append((chunks[k], chunks[k], MARKS, None, ordinal[i].tobytes(), (at[i] + first[x:y]).tobytes(), n[x:y].astype(np.int32).tobytes(), None))
        return _rows(out)

    return run


RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "sha", "kept"]


def _remove(length: int, with_text: bool):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _empty()
        own, gone = Chunk(docs, _only(side, FIRST)), {}
        marks = _only(side, MARKS)
        if marks.num_rows:
            ordinal, at, n = (np.concatenate([np.frombuffer(x, t) for x in marks.column(c).to_pylist()]) for c, t in (("a", np.int32), ("b", np.int64), ("c", np.int32)))
            order = np.argsort(ordinal, kind="stable")
            ordinal, at, n = ordinal[order], at[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], ordinal[1:] != ordinal[:-1])))
            gone = {int(ordinal[a]): (at[a:b], n[a:b]) for a, b in zip(first, [*first[1:], len(ordinal)], strict=True)}
        out = [[] for _ in RESULT]
        texts = docs.column("text").combine_chunks()
        for k, key in enumerate(zip(docs.column("doc_id").to_pylist(), docs.column("sha").to_pylist(), strict=True)):
            text = np.frombuffer(texts[k].as_buffer(), np.uint8)
            n, kept, removed, spans = len(text), text, 0, 0
            place = own.ordinal.get(key)
            if place in gone:
                at, windows = gone[place]
                depth = np.zeros(n + 1, np.int64)
                np.add.at(depth, at, 1)
                np.add.at(depth, at + windows + length - 1, -1)
                away = np.cumsum(depth[:-1]) > 0
                kept, removed = text[~away], int(away.sum())
                spans = int(away[0]) + int((away[1:] & ~away[:-1]).sum())
            elif place is None and key[0] is not None and n >= length:
                kept, removed, spans = text[:0], n, 1  # a copy of a smaller document's text
            kept = kept.tobytes()
            for col, v in zip(out, (key[0], n, removed, spans, sha256(kept).hexdigest(), key[1], kept.decode("utf-8", "ignore") if with_text else None), strict=True):
                col.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(out, _kinds(), strict=True)], RESULT)

    return run


def _kinds() -> list[pa.DataType]:
    return [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.string()]


def _empty() -> pa.Table:
    return pa.table([pa.array([], t) for t in _kinds()], RESULT)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if with_text, sha (of the whole text) and kept (what is left, as text)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha"))
    slim = written(plain.select("doc_id", "sha", F.octet_length("text").alias("n")), "texts")
    total = slim.agg(F.sum("n").alias("n")).first()["n"] or 0
    chunks = max(1, -(-total // min(MOST_CHUNK_BYTES, max(CHUNK_BYTES, total // CHUNKS))))
    gram_groups = max(1, total // (8 * GRAMS_PER_GROUP))
    groups = max(1, total // BLOCK_BYTES)
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk")
    dealt = plain.select(chunk, "doc_id", "text", "sha").groupBy("chunk")
    none = lambda name: F.lit(None).cast("binary").alias(name)
    firsts = slim.filter(f"n >= {length} and doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    firsts = firsts.select(chunk.alias("to"), chunk, F.lit(FIRST).alias("kind"), F.col("doc_id").alias("n"), F.col("sha").alias("a"), none("b"), none("c"), none("d"))
    grams = dealt.cogroup(firsts.groupBy("chunk")).applyInArrow(_send_grams(length, gram_groups), SIDE)
    masks = grams.groupBy("to").applyInArrow(_shared_grams, SIDE)
    blocks = dealt.cogroup(firsts.unionByName(masks).groupBy("chunk")).applyInArrow(_send_blocks(length, gram_groups, groups), SIDE)
    marks = blocks.groupBy("to").applyInArrow(_sort_blocks(length), SIDE)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, sha binary, kept string"
    out = dealt.cogroup(firsts.unionByName(marks).groupBy("chunk")).applyInArrow(_remove(length, with_text), schema)
    return out if with_text else out.drop("sha", "kept")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with what is left of their texts (bytes of a character that is cut apart go) and n_chars of that."""
    kept = remove_repeats(docs.filter("doc_id is not null"), length, with_text=True)
    kept = kept.select("doc_id", F.hex("sha").alias("_sha"), F.col("kept").alias("_kept")).dropDuplicates(["doc_id", "_sha"])
    sha = F.upper(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    slim = docs.filter("doc_id is not null").select(*[c for c in docs.columns if c != "text"], sha.alias("_sha"), F.col("text").isNull().alias("_null"))
    columns = {c: F.col(c) for c in docs.columns} | {"text": F.when(~F.col("_null"), F.col("_kept"))}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(columns["text"]).cast(docs.schema["n_chars"].dataType)
    out = slim.join(kept, ["doc_id", "_sha"]).select(*[v.alias(c) for c, v in columns.items()])
    return out.unionByName(docs.filter("doc_id is null"))


#: The same by brute force: every window of 50 bytes, in hexadecimal digits, with its smallest doc_id.
ORACLE = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), w AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS p FROM d WHERE n >= 50 AND doc_id IS NOT NULL)
), first AS (
  SELECT s, min(doc_id) AS f FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT doc_id, p FROM w JOIN first USING (s) WHERE f < doc_id
), runs AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS fresh FROM hit)
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, run
), cut AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM spans
), kept AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k FROM cut JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
