"""Operators against brute force, and held-out accuracy."""

import hashlib
import os
import random
import re
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import functions as F  # noqa: E402

from spanloom.llm import decontam, graph, langid, licences, mixing, simhash, suffix_dedup, toxicity, urlfilter, warc  # noqa: E402

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def brute_removed(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1 if i is not None else 0):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1 if i is not None else 0):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeats():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcé ") for _ in range(300)) for _ in range(6)]
    rows = [(i, "".join(rng.choice(base)[rng.randrange(200) :][: rng.randrange(1, 200)] for _ in range(rng.randrange(0, 6)))) for i in range(80)]
    return rows + [(None, base[0]), (5, base[1]), (5, base[2]), (90, None), (91, ""), (92, "a" * 500), (93, "a" * 300), (94, "a" * 500), (3, rows[7][1]), (7, rows[7][1])]


@pytest.mark.parametrize("chunk", [2 << 20, 2000])
def test_suffix_dedup(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4000)
    rows = repeats()
    got = sorted(map(tuple, suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute_removed(rows)


def test_deep_shallow_order(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LEAF", 16)
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    at = np.arange(0, 2900)
    cls = suffix_dedup.equal_windows(data, at, 50)
    by = {}
    for a, c in zip(at, cls, strict=True):
        by.setdefault(data[a : a + 50].tobytes(), set()).add(int(c))
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)
    words = suffix_dedup._words(data)
    order = suffix_dedup.multikey_quicksort(words, at, 2)
    keys = [data[a : a + 16].tobytes() for a in at[order]]
    assert keys == sorted(keys)


def brute_fp(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("group", [20_000, 3])
def test_simhash(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(8)]
    rows = [(k, " ".join(w if rng.random() > 0.02 else "É" for w in rng.choice(base))) for k in range(90)] + [(90, None), (91, ""), (92, "A b"), (93, "a  B")]
    fps = {i: brute_fp(t) for i, t in rows}
    least = dict.fromkeys(fps)
    for i in fps:
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            new = {j for j in fps if (fps[x] ^ fps[j]).bit_count() <= 4} - seen
            seen |= new
            todo += new
        least[i] = min(seen)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (fps[i], least[i]) for i in fps}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(300, 299)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 299: 299, 300: 299}


def edit_distance_inside(item, text):
    prev = [0] * (len(text) + 1)
    for a in item:
        cur = [prev[0] + 1]
        for k, b in enumerate(text):
            cur.append(min(prev[k] + (a != b), prev[k + 1] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(12, 30)))) for k in range(6)]
    docs = []
    for d in range(60):
        text = "".join(rng.choice("abcdefgh ") for _ in range(150))
        if d % 3:
            item = list(items[d % 6][1])
            for _ in range(rng.randrange(0, 12)):
                item[rng.randrange(len(item))] = rng.choice(["", "x", "yy"])
            text += " " + "".join(item).upper() + "  tail"
        docs.append((d, text))
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=300).collect()}
    want = {}
    for d, t in docs:
        for i, item in items:
            item, dist = decontam.normal(item), edit_distance_inside(decontam.normal(item), decontam.normal(t))
            if dist <= int(len(item) * decontam.RATE):
                want[d, i] = dist
    assert got == want and len(want) > 10


def test_embedded_records(spark):
    fake = "x" * 120 + "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    open_ = "WARC/1.1\r\nContent-Length: 50000\r\n\r\nWARC/1.1\r\nWARC/1.1\r\n"
    html = {1: fake, 2: fake, 3: open_, 4: "WARC/1.1\r\n", 5: open_ + fake, 6: fake + "tail", 7: "plain" * 40, 8: None}
    pages = spark.createDataFrame(list(html.items()), "page_id long, html string").withColumn("url", F.lit("http://a/\r\nb"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {k: (len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), 1 if k == 2 else None) for k, h in html.items()}


def test_nested_rules(spark):
    rules = [("a.com", "/", "block"), ("a.com", "/x", "allow"), ("a.com", "/x/y", "block"), ("com", "/x/y/z", "allow"), ("b.a.com", "", "allow")]
    rng = random.Random(1)
    pages = [(k, f"http://{rng.choice(['a.com', 'b.a.com', 'c.b.a.com', 'ba.com', 'com', 'xcom'])}{rng.choice(['', '/', '/x', '/xx', '/x/y', '/x/yq', '/x/y/z/w', '/z'])}") for k in range(200)]
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    for k, url in pages:
        host, _, path = url[7:].partition("/")
        path = "/" + path if "/" in url[7:] else ""
        fit = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[k] == (max(fit)[2:] if fit else (None, "allow"))


def test_mix_budgets(spark):
    rng = random.Random(6)
    docs = [(k, " ".join(["w"] * rng.randrange(0, 30)), rng.choice(["a", "b", "c", None]) if k > 5 else "tiny") for k in range(400)]
    rows = mixing.mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    total = sum(r["size"] for r in rows)
    per = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        x = per.setdefault(r.source, [0, r.target, r.source_size])
        x[0] += r.taken
    assert abs(sum(x[1] for x in per.values()) - 1.5 * total) < 1e-6
    for taken, target, size in per.values():
        assert taken == int(target) and target <= 2 * size


@needs_data
def test_learned_models(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    scored = toxicity.severity(docs, labels).join(labels.select("doc_id", F.col("toxic").alias("real")), "doc_id").collect()
    assert all(0 <= r.severity <= 3 for r in scored) and not any(r.toxic and not r.real for r in scored)


def test_ordinal_fit():
    rng = np.random.default_rng(1)
    y = np.array([0] * 330 + [1] * 30 + [2] * 20 + [3] * 20)
    x = np.zeros((400, 10))
    for i in range(400):
        for k in rng.integers(0, 10, [0, 3, 5, 9][y[i]]):
            x[i, k] += 1
    w, t = toxicity.fit_ordinal(np.log1p(x), y)
    s = np.log1p(x) @ w
    assert (w > 0).all() and (np.diff(t) > 0).all() and ((s > t[0]) == (y > 0)).all()


def test_licence_cases(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights"
    texts = ["Licensed under the Apache License, Version 2.0.", "cc by cc-by CC_BY", "all rights, reserved!", "General Public Licenses", "released under the MIT license", "x" * 10, "words before " + mit + " and behind", "mit license", "MIT LICENSE\u212a hereby granted free of charge", "license " * 200_000 + "released under the mit license"]
    got = [(r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    none = (0, None, None, "", "")
    named = lambda label: (0, None, None, "", label)
    assert got == [named("apache-2.0"), (3, 0, 4, "cc-by", "cc-by"), (1, 0, 0, "reserved", "reserved"), none, named("mit"), none, named("mit-text"), none, none, named("mit")]
