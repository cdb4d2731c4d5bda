"""Mixing sources to target weights, with DataFrame operations alone.

Every document gets a hash-random key. A source's documents, in the order of their keys, form one long
row of words, which the mix reads from its start until the source's budget is used up, again from the
start when it reaches the end. Positions come from distributed prefix sums: buckets (a source and the
first digits of the key, so a source of any size spreads over many) are summed, the sums are accumulated
over the few buckets of a source, and only within a bucket are rows accumulated one by one.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a row with a
null doc_id has the key of its text; rows with one doc_id follow each other by size, then by text; repeated rows count as often as they occur; an empty table gives no rows;
other columns, whatever their names, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BUCKET = 2048


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """A source as a string that is never null, so that joins and windows share one partitioning."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def source_targets(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """_sk, source_size, target: one row for each source of sized (_sk, size).

    Water-filling. With sources in the order of cap * size / weight, those before some place are full and
    the rest share what is left by weight; `level` is what a unit of weight gets if all before are full.
    """
    per = sized.groupBy("_sk").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("_sk") == "n", "_sk")
    per = per.withColumn("_i", F.row_number().over(by_name) - 1)
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int")))
    per = per.withColumn("_cap", F.lit(cap) * F.col("source_size").cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", "_i")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.lit(share) * F.sum("source_size").over(every).cast("double")
    level = (whole - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    per = per.withColumn("_level", level)
    level = F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(every)
    per = per.withColumn("target", F.coalesce(F.least(F.col("_cap"), level * F.col("_w")), F.lit(0.0)))
    return per.select("_sk", "source_size", "target")


def mix_sources(docs: DataFrame, carry: tuple[str, ...] = (), weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, source, the carried columns, size, source_size, target, taken, and _from: where in the
    source's row of words the document starts. carry: columns of docs to keep in the result."""
    kept = [F.col(c) for c in dict.fromkeys(("doc_id", "source", *carry))]
    by_id = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    tie = F.xxhash64("text") if carry else F.lit(0).cast("long")  # without texts in the result their order is no matter
    sized = docs.select(*kept, word_count(F.col("text")).alias("size"), by_id.alias("_key"), tie.alias("_tie"))
    if not carry:
        sized = written(sized, "sizes")
    sized = sized.withColumn("_sk", _source_key(F.col("source")))
    rows, digits = sized.count() if not carry else docs.count(), 1
    while 16**digits * ROWS_PER_BUCKET < rows:
        digits += 1
    sized = sized.withColumn("_bucket", F.substring("_key", 1, digits))
    small = sized.select("_sk", "_bucket", "size")
    sums = small.groupBy("_sk", "_bucket").agg(F.sum("size").alias("_in"))
    sums = sums.withColumn("_start", F.coalesce(F.sum("_in").over(Window.partitionBy("_sk").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = sums.join(source_targets(sums.withColumnRenamed("_in", "size"), weights, share, cap), "_sk").select("_sk", "_bucket", "_start", "source_size", "target")
    placed = written(placed, "buckets")
    rows_before = Window.partitionBy("_sk", "_bucket").orderBy("_key", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    out = sized.join(placed, ["_sk", "_bucket"]).withColumn("_from", F.col("_start") + F.coalesce(F.sum("size").over(rows_before), F.lit(0)))
    budget = F.floor("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - rounds * F.col("source_size")
    taken = rounds * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_from")))
    return out.select(*kept, "size", "source_size", "target", taken.alias("taken"), "_from")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each document and round (epoch, from 0) that it is in, with the words it
    gives; the document at the cut keeps only its first words."""
    columns = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "epoch")]
    out = mix_sources(docs.select(*columns), carry=tuple(columns), **options)
    out = out.filter("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("taken") / F.col("size")) - 1).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    out = out.withColumn("words", words)
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"(?s)\s*{WORD}"), F.lit(0)), 1, F.col("words").cast("int")), "")
    return out.withColumn("text", F.when(F.col("words") < F.col("size"), first).otherwise(F.col("text"))).select(*columns, "epoch", "words", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS k, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {docs}
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size::DOUBLE AS cap FROM per
), levels AS (
  SELECT *, cap / w AS ratio,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, coalesce(least(cap, w * max(CASE WHEN ratio > level THEN level END) OVER ()), 0.0::DOUBLE) AS target FROM levels
), placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    CAST(floor(t.target) AS BIGINT) AS budget
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), rounds AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS r FROM placed
)
SELECT doc_id, size, source_size, target,
  CAST(r * size + greatest(0, least(size, budget - r * source_size - start)) AS BIGINT) AS taken
FROM rounds
"""
