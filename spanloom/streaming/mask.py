"""Masking documents as they arrive: stateless, so any number of executors can share a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def mask_stream(docs: DataFrame, pattern: str, mark: str = "[SECRET]") -> DataFrame:
    """docs (batch or stream) with masked and n_masked."""
    n = F.coalesce(F.regexp_count("text", F.lit(T.UNICODE + pattern)), F.lit(0))
    return docs.withColumn("n_masked", n).withColumn("masked", T.mask_matches(F.col("text"), pattern, mark))


def start_masking(spark: SparkSession, source: str, schema: str, pattern: str, out: str, checkpoint: str):
    """Masks Parquet files that arrive in source into out; ends when what is there is done."""
    docs = table_stream(spark, source, schema)
    done = mask_stream(docs, pattern).drop("text")
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of a Parquet table's files: a folder's, or one file as the only one of its folder that counts."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    reader = spark.readStream.schema(schema)
    if status.isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
