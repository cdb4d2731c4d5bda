"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where it is unset (tests), a local one, on a local master alone."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_at.isDefined():
            at = set_at.get()
        elif not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
            at = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/spanloom/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it again. The table goes when the driver ends,
    or, where it is passed as instead_of, as soon as the one after it is there."""
    spark, schema = df.sparkSession, df.schema
    # sides of a union that are partitioned alike may come in different numbers of partitions at run time, which
    # Spark 4.1 then fails to merge
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    path = fresh_path(spark, name)
    df.write.parquet(path)
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)
    if instead_of is not None:
        discard(instead_of)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more, which frees their disk before the driver ends."""
    for df in tables:
        files, place = _file_system(df.sparkSession, df._written_at)
        files.delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a column in all rows; sizes the dealing of rows, never selects any."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


BROADCAST_ROWS = 100_000


def few(df: DataFrame) -> DataFrame:
    """Broadcast where a count proves it small, else as it is. For slim rows of a written table."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


HOT_ROWS = 4096


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of rows with keyed, a written table with one row for each key and how many rows have it. Keys with many
    rows are joined apart from the others, by a broadcast (there is one at most for each HOT_ROWS rows, and their
    number is checked), so that no task gets all rows of one."""
    hot = F.col(count) >= HOT_ROWS
    return rows.join(few(keyed.filter(hot)), key).unionByName(rows.join(keyed.filter(~hot), key))

SALTS = 64


def sampled(rows: DataFrame, by: str, most: int, order: list) -> DataFrame:
    """The first `most` rows of each value of `by` in an order that starts with a hash, with nth. Each of SALTS parts of a
    value picks its own first, so that the last window holds SALTS * most rows of a value, whatever the input."""
    part = Window.partitionBy(by, "_salt").orderBy(*order)
    few_ = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).withColumn("nth", F.row_number().over(part)).filter(F.col("nth") <= most)
    return few_.drop("_salt").withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("nth") <= most)
