"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b).

    Alternating large-star and small-star steps: each node's larger neighbours, then all of a node's
    neighbours, are tied to the smallest of them. Neither step makes more edges than there were, and the
    number of rounds grows with the logarithm of the number of nodes. A node with very many neighbours is
    a group of an aggregation, which is combined before it is moved, and a key of joins of two columns, whose
    partitions adaptive execution splits where they are large; it is never a list in one task. Edges with a null end
    are none; without edges there are no rows.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, state = written(pairs, "edges"), None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "large-star", instead_of=pairs)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        pairs = written(small.filter("u <> v").distinct(), "small-star", instead_of=large)
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not converge")
    tied = pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = pairs.select(F.col("v").alias("node")).distinct().join(tied, "node", "left_anti").withColumn("component", F.col("node"))
    return tied.unionByName(roots)
