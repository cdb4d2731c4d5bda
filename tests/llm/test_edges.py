"""Each operator and stage on nulls, empty tables, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from spanloom.llm import ann, decontam, langid, licences, mixing, simhash, suffix_dedup, toxicity, urlfilter, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, label string, score double, chunk int, fp string"
LONG = "the quick brown fox jumps over the lazy dog " * 3000


def rows():
    texts = [None, "", " \n\t", "a", "ab cd ef gh", "ab cd ef gh", LONG, LONG + "x", "1234 !!", "Der schnelle braune Fuchs springt", "Le renard brun saute par dessus", "é" * 60, "All Rights Reserved. CC BY 4.0"]
    out = [(k, t, "en" if k % 3 else "de", "s1" if k % 2 else None, len(t or ""), 7, "x", 0.5, 1, "f") for k, t in enumerate(texts)]
    out += [out[4], out[4], (None, "null id text here", None, None, None, None, None, None, None, None), (4, "another text with the same id", "en", "s1", 1, 1, "x", 0.1, 1, "f")]
    return out


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark):
    return spark.createDataFrame(rows() if request.param == "rows" else [], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over"), (2, None), (None, "x"), (3, "  "), (4, "Never there at all, never")], "item_id long, text string")


def test_one_row_for_each_row(docs, labels):
    n = docs.count()
    ids = sorted(str(r.doc_id) for r in docs.collect())
    for out in (langid.identify(docs), licences.scan_licences(docs), toxicity.severity(docs, labels), suffix_dedup.remove_repeats(docs), simhash.near_duplicates(docs), mixing.mix_sources(docs)):
        got = out.collect()
        assert len(got) == n and sorted(str(r.doc_id) for r in got) == ids


def test_language_of_texts_without_letters(docs):
    for r in langid.identify(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert 0 <= r.score <= 1
        if not r.text or not any(c.isalpha() for c in r.text):
            assert r.lang_pred == "und" or r.doc_id == 4


def test_leaks(docs, bench):
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    assert got == ({(6, 1), (7, 1)} if docs.count() else set())


def test_stages_keep_columns_and_rows(spark, docs, bench, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
    mixed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path))
    assert [r.words for r in mixed.collect()] == [mixing_count(r.text) for r in mixed.collect()]


def mixing_count(text):
    return len(text.split())


def test_pages(spark):
    schema = "page_id long, url string, html string, host string, rule string, level int, digest int, file string"
    rest = ("h", "r", 1, 1, "f")
    rows = [(1, "http://A.Example.com/en/7x?q", "p" * 120, *rest), (2, "https://x.com/en/a#t", "p" * 120, *rest), (2, "https://x.com/en/a#t", "p" * 120, *rest), (3, None, None, *rest), (4, "no scheme/en/", "", *rest), (None, "ftp://net/de/81", "p" * 120, *rest), (5, "http://example.net/de/81", "<p>é</p>", *rest), (6, "http://", "q" * 99, *rest), (7, "http://com/en/", "q" * 99, *rest)]
    pages = spark.createDataFrame(rows, schema)
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages).collect()}
    assert got == {(1, "a.example.com", "/en/7x", "example.com/en/7", "allow"), (2, "x.com", "/en/a", "com/en/", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (None, "net", "/de/81", "net/de/", "allow"), (5, "example.net", "/de/81", "example.net/de/8", "block"), (6, "", "", None, "allow"), (7, "com", "/en/", "com/en/", "block")}
    assert urlfilter.judge_urls(pages).count() == len(rows)
    back = warc.round_trip(pages).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in back) == sorted([("1", "response", None), ("2", "revisit", 1), ("2", "revisit", 1), ("3", "response", None), ("4", "response", None), ("None", "revisit", 1), ("5", "response", None), ("6", "response", None), ("7", "response", None)])
    assert {r.payload_digest for r in back if r.page_id == 5} == {hashlib.sha256("<p>é</p>".encode()).hexdigest()}
    empty = spark.createDataFrame([], schema)
    assert urlfilter.judge_urls(empty).count() == 0 and warc.round_trip(empty).count() == 0


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, id long, q int, score double"
    rows = [(k, [float(k % 5), 1.0, -0.5], 1, 1, 0.0) for k in range(45)] + [(100, None, 1, 1, 0.0), (120, [0.0, 0.0, 0.0], 1, 1, 0.0), (140, [1.0, None, 2.0], 1, 1, 0.0), (160, [float("nan"), 1.0, 1.0], 1, 1, 0.0), (180, [float("inf"), 1.0, 1.0], 1, 1, 0.0), (None, [1.0, 1.0, 1.0], 1, 1, 0.0), (200, [], 1, 1, 0.0), (20, [0.0, 1.0, -0.5], 1, 1, 0.0), (220, [1.0], 1, 1, 0.0)]
    got = ann.nearest(spark.createDataFrame(rows, schema)).collect()
    for q in (0, 20, 40):
        want = sorted(((-(q % 5 * (k % 5) + 1.25), k) for k in range(45) if k != q))[:20]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert {r.query_id for r in got} == {0, 20, 40}
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    few = ann.nearest(spark.createDataFrame(rows[:3], schema)).collect()
    assert sorted((r["rank"], r.vec_id) for r in few) == [(1, 1), (2, 2)] or [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == [2, 1]


def test_paths_with_the_highest_code_points(spark):
    urls = ["http://a.com/en/\U0010ffffx", "http://a.com/en/￿", "http://example.com/en/7\U0010ffff\U0010ffff", "http://a.com/en\U0010ffff"]
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got == {0: ("com/en/", "block"), 1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: (None, "allow")}
