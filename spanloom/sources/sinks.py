"""Sinks. Spark commits whole jobs, so readers never see half a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.integrity import corpus_hash


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_span_docs(spans: DataFrame, docs: DataFrame, path: str) -> None:
    """A line for each document, those without spans too."""
    per = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "line", "value", "score"))).alias("spans"))
    rows = docs.select("doc_id").distinct().join(per, "doc_id", "left")
    write_jsonl(rows.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("spans", F.array().cast(per.schema["spans"].dataType)).alias("spans")), path)


def write_corpus(docs: DataFrame, path: str) -> DataFrame:
    """Writes doc_id, text, sha256 and returns the manifest row (n, sha256)."""
    docs.select("doc_id", "text", F.sha2("text", 256).alias("sha256")).write.mode("overwrite").parquet(path)
    return corpus_hash(docs)


def write_csv_template(packets: DataFrame, path: str) -> None:
    """packet_id, label, note with empty labels, for people to fill in."""
    packets.select("packet_id", F.lit("").alias("label"), F.lit("").alias("note")).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def detections(rows: DataFrame) -> DataFrame:
    """file, lines (sorted, known ones alone), flagged: a file with a hit on an unknown line stays flagged."""
    per = rows.groupBy("file").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    return per.select("file", F.filter("lines", lambda x: x > 0).alias("lines"), F.lit(True).alias("flagged"))


def metrics_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("metrics"))
