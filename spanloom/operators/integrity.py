"""Hashes, leakage and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_hash(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = 256) -> DataFrame:
    """n, sha256: a hash over all documents in two levels, so that no task holds more than a bucket's hashes. A bucket's
    hash is that of its documents' hashes in key order, the corpus's is that of the buckets' in their order."""
    rows = docs.select(F.col(key).alias("k"), F.pmod(F.col(key), F.lit(buckets)).alias("b"), F.sha2(F.col(text), 256).alias("h"))
    per = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return per.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("sha256"))


def verify_corpus(docs: DataFrame, expected: str, **options) -> None:
    """Raises if the corpus's hash is another."""
    found = corpus_hash(docs, **options).first()["sha256"]
    if found != expected:
        raise ValueError(f"corpus hash is {found}, not {expected}")


def leaked_values(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """Distinct values of a that b has too."""
    return a.select(value).distinct().join(b.select(value).distinct(), value, "left_semi")


def candidate_id(prov: Column, start: Column, end: Column, family: Column, scheme: str = "spanloom-v1") -> Column:
    """First 16 hex digits of a hash of place and kind, never of the value."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(scheme), prov, start.cast("string"), end.cast("string"), family), 256), 1, 16)


def corrected_gold(gold: DataFrame) -> DataFrame:
    """gold (start, end, value, type) with the scheme word of basic-auth values cut off, and gt_revision."""
    basic = (F.col("type") == "basic_auth_header") & F.startswith(F.col("value"), F.lit("Basic "))
    return gold.withColumns({"start": F.when(basic, F.col("start") + 6).otherwise(F.col("start")), "value": F.when(basic, F.substr(F.col("value"), F.lit(7))).otherwise(F.col("value")), "gt_revision": F.when(basic, 2).otherwise(1)})


def wrong_offsets(spans: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans whose value is not what their document has at their place; integrity needs this to be empty."""
    both = spans.join(docs.select(key, "text"), key)
    return both.filter(~F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).eqNullSafe(F.col("value"))).drop("text")
