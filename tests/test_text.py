"""Text functions against plain Python."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from spanloom.functions import patterns as P
from spanloom.functions import text as T
from spanloom.operators import detect, spans


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_matches_are_those_of_finditer(spark):
    rng = random.Random(5)
    texts = ["", "é😀 token12345678 x", 'a = "0123456789abcdef"\nb', "x" * 40] + ["".join(rng.choice("ab1. \n\"é😀=/") for _ in range(300)) for _ in range(30)]
    pattern = r"[A-Za-z0-9+/=_\-.]{4,}"
    got = {(r.doc_id, r.start, r.end, r.line, r.value) for r in spans.find(frame(spark, texts), pattern).collect()}
    want = {(i, m.start(), m.end(), t.count("\n", 0, m.start()) + 1, m.group()) for i, t in enumerate(texts) for m in re.finditer(pattern, t)}
    assert got == want


def test_entropy_and_degenerate_hex(spark):
    values = ["", "a", "aaaa", "abcd", "0123456789abcdef", "é😀é😀", "a" * 64, "0011" * 10]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", T.entropy(F.col("v")).alias("h"), T.degenerate_hex(F.col("v")).alias("d")).collect()
    for r in rows:
        n = len(r.v)
        want = -sum(c / n * math.log2(c / n) for c in Counter(r.v).values()) if n else 0.0
        assert abs(r.h - want) < 1e-9
        assert r.d == (len(set(r.v)) < 6 or want < 3.0)


def test_mask_joins_overlaps_and_leaves_nothing(spark):
    rows = spark.createDataFrame([("key=AAAA;tok=BBBB;", [(4, 8), (13, 17)]), ("0123456789", [(2, 6), (4, 8)]), ("é😀x", [(0, 2)]), ("none", [])], "t string, s array<struct<start:int,end:int>>")
    got = [r[0] for r in rows.select(T.mask(F.col("t"), F.col("s"))).collect()]
    assert got == ["key=[SECRET];tok=[SECRET];", "01[SECRET]89", "[SECRET]x", "none"]


def test_keyworded_values_need_no_call(spark):
    texts = ["token = abcdef-gh(x)", "token = getValue(x)", "token == abcdefgh", 'password: "hunter2hunter2"', "api_key=>k"]
    got = [(r.doc_id, r.value) for r in spans.find(frame(spark, texts), P.KEYWORDED_VALUE, lead=P.KEYWORDED, tail=P.NO_CALL).collect()]
    assert sorted(got) == [(0, "abcdef"), (3, "hunter2hunter2")]


def test_lookalike_categories_and_precedence(spark):
    text = 'id = "123e4567-e89b-12d3-a456-426614174000"\nmd5 d41d8cd98f00b204e9800998ecf8427e\nssh-rsa AAAAB3NzaC1yc2E= x\nMYAPP_ENV_NAME MY_ENV 10.0.0.1 aa:bb:cc:dd:ee:ff\n' + "a" * 32
    got = {(r.category, r.line) for r in detect.lookalikes(frame(spark, [text])).collect()}
    assert got == {("uuid", 1), ("hex_md5", 2), ("ssh_pubkey", 3), ("env_var_name", 4), ("ipv4", 4), ("mac", 4)}


def test_first_wins_is_the_loop(spark):
    rng = random.Random(9)
    rows = []
    for d in range(20):
        for k in range(rng.randrange(0, 14)):
            s = rng.randrange(60)
            rows.append((d, s, s + rng.randrange(1, 12), rng.randrange(3), k))
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, priority int, k int")
    got = {tuple(r) for r in spans.first_wins(df, ("priority", "start", "end", "k")).select("doc_id", "start", "end", "priority", "k").collect()}
    want, taken = set(), {}
    for d, s, e, p, k in sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2], r[4])):
        if all(e <= a or b <= s for a, b in taken.setdefault(d, [])):
            taken[d].append((s, e))
            want.add((d, s, e, p, k))
    assert got == want


def test_locations_and_names(spark):
    rows = spark.createDataFrame([("ab\ncd\n", 2, 1, 2, 2), ("ab", 1, 1, 1, 3), ("ab", 5, 1, 5, 1)], "t string, a int, b int, c int, d int")
    got = [r[0] for r in rows.select(T.location_span(F.col("t"), F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == [(3, 5), None, None]
    urls = ["https://x.org/A/B.git/", "git@h:o/r", "https://a.github.io/z"]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(T.repo_name(F.col("u"))).collect()] == ["a/b", "git@h:o/r", "a.github.io/z"]


def test_value_classes_and_shapes(spark):
    values = {"": "empty", "changeme": "placeholder/example/redacted", "-----BEGIN RSA KEY": "private_key/cert_material", "10.1.2.3": "ip_address", "d41d8cd98f00b204e9800998ecf8427e": "hex_hash/checksum(len32)", "MY_NAME": "env_var_name(no_value)", "1234567": "numeric_id", "'https://u:p@h'": "url/connection_string", "abc": "short/other"}
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", T.value_class(F.col("v")).alias("c")).collect()
    assert {r.v: r.c for r in rows} == values
    shapes = {"ghp_abc": "vendor:s:lo", "0123456789abcdef": "hexlo:s:md", "1111": "hexlo:s:lo", "a b": "mixed:s:lo"}
    rows = spark.createDataFrame([(v,) for v in shapes], "v string").select("v", T.shape(F.col("v")).alias("c")).collect()
    assert {r.v: r.c for r in rows} == shapes


def test_unicode_classes_are_those_of_python(spark):
    texts = ["é" + "0123456789abcdef" * 2, "x 0123456789abcdef0123456789abcdef y", "password = hunter2hunter2", "token = abcdéf(x)", "ß10.0.0.1", "10.0.0.1é 10.0.0.2"]
    for name in ("hex_md5", "ipv4"):
        pattern = dict(P.LOOKALIKES)[name]
        got = {(r.doc_id, r.start, r.value) for r in spans.find(frame(spark, texts), pattern).collect()}
        assert got == {(i, m.start(), m.group()) for i, t in enumerate(texts) for m in re.finditer(pattern, t)}, name
    got = [(r.doc_id, r.value) for r in spans.find(frame(spark, texts), P.KEYWORDED_VALUE, lead=P.KEYWORDED, tail=P.NO_CALL).collect()]
    assert got == [(2, "hunter2hunter2")]


def test_search_time_grows_with_the_matches(spark):
    import time

    def seconds(n):
        df = spark.range(1).select(F.lit(0).alias("doc_id"), F.repeat(F.lit("abcd1234 é\n"), n).alias("text"))
        began = time.time()
        rows = df.select(F.transform(T.matches(F.col("text"), r"[a-z]{4}\d{4}"), lambda m: m["start"]).alias("s"), T.line_starts(F.col("text")).alias("l"), F.length(T.mask_matches(F.col("text"), r"[a-z]{4}\d{4}")).alias("m")).first()
        assert rows.s == [11 * k for k in range(n)] and rows.l == [11 * k for k in range(n + 1)] and rows.m == 11 * n
        return time.time() - began

    seconds(1000)
    few, many = seconds(25_000), seconds(200_000)
    assert many < 12 * few + 5


def test_mask_of_many_spans(spark):
    n = 100_000
    df = spark.range(1).select(F.repeat(F.lit("ab "), n).alias("t"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((3 * k).alias("start"), (3 * k + 2).alias("end"))).alias("s"))
    assert df.select(T.mask(F.col("t"), F.col("s"), "x").alias("m")).first().m == "x " * n
