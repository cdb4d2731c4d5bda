"""Choosing repositories out of captured search results, and what a choice must satisfy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import sample


def eligible(repos: DataFrame, excluded: DataFrame) -> DataFrame:
    """repos (node_id, full_name, lang, stars, fork, archived, mirror_url, size, default_branch) that may be chosen, with their
    normalized name; excluded: repositories' urls. One row for each node_id and name."""
    fine = ~F.coalesce("fork", F.lit(False)) & ~F.coalesce("archived", F.lit(False)) & F.col("mirror_url").isNull() & (F.coalesce("size", F.lit(0)) > 0) & F.col("default_branch").isNotNull()
    named = repos.filter(fine).withColumn("norm", T.repo_name(F.col("full_name")))
    first = Window.partitionBy("norm").orderBy(F.desc("stars"), "node_id")
    once = named.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return once.join(excluded.select(T.repo_name(F.col("url")).alias("norm")).distinct(), "norm", "left_anti")


def select(repos: DataFrame, per_cell: int, buckets: dict[str, int], parts: int = 3, seed: str = "0") -> DataFrame:
    """per_cell eligible repos of each language and bucket (name: least number of stars, falling) in hash order, dealt to
    parts A, B, C... in turn by falling stars within their cell."""
    bucket = F.lit(None).cast("string")
    for name, least in sorted(buckets.items(), key=lambda kv: kv[1]):
        bucket = F.when(F.col("stars") >= least, F.lit(name)).otherwise(bucket)
    cells = repos.withColumn("bucket", bucket).filter("bucket is not null")
    order = Window.partitionBy("lang", "bucket").orderBy(sample.hash_order("repo", F.col("node_id").cast("string"), seed=seed), "node_id")
    chosen = cells.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_cell).drop("_n")
    return sample.round_robin(chosen, ["lang", "bucket"], [F.desc("stars"), "node_id"], parts)


def violations(chosen: DataFrame, excluded: DataFrame) -> DataFrame:
    """rule, n: names chosen twice, names in two parts, excluded names; all must be 0 before anything is harvested."""
    twice = chosen.groupBy("norm").agg(F.count(F.lit(1)).alias("k"), F.count_distinct("part").alias("p"))
    t = twice.agg(F.count_if(F.col("k") > 1).alias("twice"), F.count_if(F.col("p") > 1).alias("parts"))
    names = excluded.select(T.repo_name(F.col("url")).alias("norm")).distinct()
    leaked = chosen.join(names, "norm", "left_semi").agg(F.count(F.lit(1)).alias("excluded"))
    one = lambda c: F.struct(F.lit(c).alias("rule"), F.col(c).alias("n"))
    return t.join(leaked).select(F.inline(F.array(one("twice"), one("parts"), one("excluded"))))  # two rows of one
