"""Length-preserving replacement of credential candidates by synthetic values, with gates.

A document whose replacement is in doubt is excluded with a reason, never kept. Neither candidates' values nor raw
texts are written anywhere by these plans.
"""

from __future__ import annotations

import re
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import patterns as P
from ..functions import text as T
from ..session import written
from . import detect, integrity, spans

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_PREFIX = re.compile(P.VENDOR_PREFIX)


def _bytes(seed: str, n: int) -> bytes:
    """n bytes that depend on the seed alone, by hashing a counter."""
    return b"".join(sha256(f"{seed}|{k}".encode()).digest() for k in range(-(-n // 32)))[:n]


def _alphabet(value: str) -> str | None:
    """The one alphabet a whole value stays in: long hex of either case (eight digits and more are hex too), or digits."""
    for alphabet, least in ((DIGITS + "abcdef", 8), (DIGITS + "ABCDEF", 8), (DIGITS, 4)):
        if len(value) >= least and not set(value) - set(alphabet):
            return alphabet
    return None


def synthetic(value: str, seed: str, kind: str) -> str:
    """A value of the same length and character classes. Public prefixes of vendors' tokens stay; the frame lines,
    line lengths and padding of a PEM block stay."""
    stream, whole = _bytes(seed, len(value)), _alphabet(value)
    kept = set()
    if kind in ("vendor_prefix", "external"):
        first = _PREFIX.match(value)
        for m in _PREFIX.finditer(value) if kind == "external" else [first] if first else []:
            kept.update(range(*m.span()))
        whole = _alphabet("".join(c for k, c in enumerate(value) if k not in kept)) if kind == "vendor_prefix" else whole
    if kind == "pem_private":
        at = 0
        for line in value.split("\n"):
            if line.startswith("-----") or not line.strip():
                kept.update(range(at, at + len(line)))
            at += len(line) + 1
        whole = None
    out = []
    for k, (c, b) in enumerate(zip(value, stream, strict=True)):
        own = None if k in kept else whole or next((a for a in (UPPER, LOWER, DIGITS) if c in a), None)
        out.append(own[b % len(own)] if own else c)
    return "".join(out)


@F.pandas_udf(ArrayType(StringType()))
def synthetic_udf(values: pd.Series, seeds: pd.Series, kinds: pd.Series) -> pd.Series:
    return pd.Series([[synthetic(*x) for x in zip(*each, strict=True)] for each in zip(values, seeds, kinds, strict=True)], dtype="object")


def sanitize(docs: DataFrame, external: DataFrame | None = None, prov: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> (doc_id, text, exclude_reason), (doc_id, id, start, end, line, detector, family,
    synth_value). Excluded documents have a null text and no records.

    Texts are searched twice, before and after the replacement, and meet their spans in one join. What is found is written
    in between: spans without values, texts that passed the gates with their records, and ids of documents with new
    candidates."""
    own = detect.candidates(docs)
    out_of_bounds = None
    found = own.select("doc_id", "start", "end", "detector", "family", F.lit(0).alias("external"))
    if external is not None:
        placed = external.join(docs.select("doc_id", F.length("text").alias("n")), "doc_id")
        fine = F.expr("0 <= start and start < end and end <= n")
        out_of_bounds = placed.filter(~F.coalesce(fine, F.lit(False))).select("doc_id").distinct().withColumn("bounds", F.lit(True))
        found = detect.with_external(own, placed.filter(fine))
    found = written(found, "found-spans")

    per = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "detector", "family", "external"))).alias("c"))
    joined = docs.select(*dict.fromkeys(("doc_id", "text", prov))).join(per, "doc_id", "left").withColumn("c", F.coalesce("c", F.array().cast(per.schema["c"].dataType)))
    joined = joined.withColumn("c", F.transform("c", lambda x: x.withField("raw", T.cut(F.col("text"), x["start"], x["end"]))))
    source = F.col(prov).cast("string")
    seeds = F.transform("c", lambda x: F.concat_ws("|", source, x["start"].cast("string"), x["end"].cast("string")))
    kind = lambda x: F.when((x["detector"] == "pem_private") | x["raw"].rlike(P.PEM_PRIVATE), "pem_private").when(x["external"] == 1, "external").otherwise(x["detector"])
    joined = joined.withColumn("synth", synthetic_udf(F.transform("c", lambda x: x["raw"]), seeds, F.transform("c", kind)))
    joined = joined.withColumn("c", F.zip_with("c", "synth", lambda x, v: x.withField("synth_value", v)))
    if out_of_bounds is not None:
        joined = joined.join(out_of_bounds, "doc_id", "left")
    else:
        joined = joined.withColumn("bounds", F.lit(None).cast("boolean"))
    clean = F.aggregate("c", F.col("text"), lambda t, x: F.overlay(t, x["synth_value"], x["start"] + 1, x["end"] - x["start"]))
    joined = joined.withColumn("clean", clean)
    core = lambda x: F.element_at(F.sort_array(F.transform(F.concat(F.regexp_extract_all(x["raw"], F.lit(r"[A-Za-z0-9+/=_\-.]{8,}"), F.lit(0)), F.array(F.lit(""))), lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))), asc=False), 1)
    reason = F.when(F.col("bounds"), "external span out of bounds")
    reason = reason.when(F.exists("c", lambda x: (x["synth_value"] == x["raw"]) | (F.length(x["synth_value"]) != F.length(x["raw"]))), "candidate can't be replaced")
    reason = reason.when(F.exists("c", lambda x: T.cut(F.col("clean"), x["start"], x["end"]) != x["synth_value"]), "offsets differ")
    reason = reason.when(F.exists("c", lambda x: (core(x)["n"] >= 8) & F.contains(F.col("clean"), core(x)["v"])), "raw value left in the text")
    joined = joined.withColumn("exclude_reason", reason)
    record = lambda x: F.struct(integrity.candidate_id(source, x["start"], x["end"], x["family"]).alias("id"), x["start"].alias("start"), x["end"].alias("end"), T.line_of(F.col("text"), x["start"]).alias("line"), x["detector"].alias("detector"), x["family"].alias("family"), x["synth_value"].alias("synth_value"))
    passed = F.col("exclude_reason").isNull()
    gated = joined.select("doc_id", F.when(passed, F.col("clean")).alias("text"), "exclude_reason", F.when(passed, F.transform("c", record)).alias("records"))
    gated = written(gated, "gated-texts")
    again = detect.candidates(gated.filter("exclude_reason is null").select("doc_id", "text"))
    new = written(spans.covered(again, found.select("doc_id", "start", "end"), how="left_anti").select("doc_id").distinct(), "new-candidates")
    marked = gated.join(new.withColumn("new", F.lit(True)), "doc_id", "left").withColumn("exclude_reason", F.coalesce("exclude_reason", F.when(F.col("new"), "new candidate after replacement")))
    texts = marked.select("doc_id", F.when(F.col("exclude_reason").isNull(), F.col("text")).alias("text"), "exclude_reason")
    return texts, marked.filter("exclude_reason is null").select("doc_id", F.inline("records"))
