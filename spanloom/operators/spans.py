"""Spans as relations: finding, resolving and joining them. All joins carry an equality on the document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def find(docs: DataFrame, pattern: str, keys: Sequence[str] = ("doc_id",), lead: str = "", tail: str = "") -> DataFrame:
    """keys, start, end, line, value, before: a row for each match."""
    return placed(docs, T.matches(F.col("text"), pattern, lead, tail), keys)


def placed(docs: DataFrame, hits: Column, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys and the fields of each hit. An outer inline, as for an inner one the optimizer would first search all texts
    once more to see whether they have hits."""
    return docs.select(*keys, F.inline_outer(hits)).filter("start is not null")


def overlaps(a: str, b: str) -> Column:
    return F.expr(f"{a}.start < {b}.end AND {b}.start < {a}.end")


def contains(inner: str, outer: str) -> Column:
    return F.expr(f"{outer}.start <= {inner}.start AND {inner}.end <= {outer}.end")


def _on(keys: Sequence[str], residual: Column) -> Column:
    cond = residual
    for k in keys:
        cond = (F.col(f"a.{k}") == F.col(f"b.{k}")) & cond
    return cond


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("doc_id",), how: str = "inner") -> DataFrame:
    """Interval join of two span tables within a document; how: inner, left_semi, left_anti. Aliases a and b."""
    return a.alias("a").join(b.alias("b"), _on(keys, overlaps("a", "b")), how)


def covered(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("doc_id",), how: str = "left_semi") -> DataFrame:
    """Spans of a that lie within a span of b."""
    return a.alias("a").join(b.alias("b"), _on(keys, contains("a", "b")), how)


def first_wins(spans: DataFrame, order: Sequence[str], keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The spans of each document that overlap none taken before, in the given order.

    A document's spans are first cut into clusters that touch no other cluster (a window over start), so the
    ordered fold sees only spans that can collide; a cluster of one needs none.
    """
    by_start = Window.partitionBy(*keys).orderBy("start", "end")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.when(F.coalesce(F.max("end").over(before), F.lit(-1)) <= F.col("start"), 1).otherwise(0)
    marked = spans.withColumn("_fresh", fresh).withColumn("_cluster", F.sum("_fresh").over(by_start)).drop("_fresh")
    rest = [c for c in spans.columns if c not in keys]
    one = F.struct(*[F.col(c) for c in order], F.struct(*rest).alias("_row"))
    groups = marked.groupBy(*keys, "_cluster").agg(F.array_sort(F.collect_list(one)).alias("_all"))
    row = groups.schema["_all"].dataType.elementType["_row"].dataType
    none = F.array().cast(f"array<{row.simpleString()}>")

    def take(acc: Column, x: Column) -> Column:
        r = x["_row"]
        return F.when(F.exists(acc, lambda t: (r["start"] < t["end"]) & (t["start"] < r["end"])), acc).otherwise(F.concat(acc, F.array(r)))

    kept = F.when(F.size("_all") == 1, F.transform("_all", lambda x: x["_row"])).otherwise(F.aggregate("_all", none, take))
    return groups.select(*keys, F.inline(kept))


def greedy_pairs(pairs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One-to-one matching: pairs (keys, overlap, p, g) by overlap, largest first, then p, then g; a pair is taken
    if neither side is. Pairs that share neither side with another need no fold."""
    alone = lambda c: F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) == 1
    marked = pairs.select(*keys, "p", "g", "overlap").withColumn("_alone", alone("p") & alone("g"))
    one = F.struct((-F.col("overlap")).alias("o"), "p", "g")
    groups = marked.filter("not _alone").groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_all"))
    none = F.array().cast(groups.schema["_all"].dataType)
    take = lambda acc, x: F.when(F.exists(acc, lambda t: (t["p"] == x["p"]) | (t["g"] == x["g"])), acc).otherwise(F.concat(acc, F.array(x)))
    folded = groups.select(*keys, F.explode(F.aggregate("_all", none, take)).alias("x")).select(*keys, "x.p", "x.g", (-F.col("x.o")).alias("overlap"))
    return folded.unionByName(marked.filter("_alone").drop("_alone"))


def snippets(docs: DataFrame, hits: DataFrame, around: int) -> DataFrame:
    """hits (doc_id, start, end, line) with snippet, the lines from `around` before a document's first hit to `around` behind
    its last, and the hits' places in it. A document's lines are cut once, not for each hit."""
    window = hits.groupBy("doc_id").agg(F.greatest(F.lit(0), F.min("line") - around).alias("_a"), (F.max("line") + around).alias("_b"))
    lines = docs.select("doc_id", F.split("text", "\n").alias("_l")).join(window, "doc_id")
    off = F.when(F.col("_a") > 0, F.length(F.array_join(F.slice("_l", F.lit(1), F.col("_a")), "\n")) + 1).otherwise(0)
    cut = lines.select("doc_id", "_a", off.alias("_off"), F.array_join(F.slice("_l", F.col("_a") + 1, F.col("_b") - F.col("_a")), "\n").alias("snippet"))
    return hits.join(cut, "doc_id").select("doc_id", (F.col("start") - F.col("_off")).alias("start"), (F.col("end") - F.col("_off")).alias("end"), (F.col("line") - F.col("_a")).alias("line"), "snippet")
