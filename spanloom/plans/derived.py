"""Gold and predicted spans derived from a table, for evaluating without a model: gold are the long tokens of the
texts, predictions the same with errors that follow from doc_id and start."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import spans as S


def tokens(docs: DataFrame) -> DataFrame:
    return S.find(docs, P.TOKEN).drop("before")


def predictions(tok: DataFrame) -> DataFrame:
    """Of 100: 10 dropped, 10 one character too long, 5 on the wrong line, 5 twice, 3 with a false one behind."""
    h = F.pmod(F.col("doc_id") * 7919 + F.col("start"), F.lit(100))
    t = tok.withColumn("h", h).withColumn("score", F.pmod(F.col("doc_id") * 7919 + F.col("start"), F.lit(1000)) / F.lit(1000.0))
    kinds = F.when(F.col("h") < 10, F.array()).when(F.col("h").between(25, 29), F.array(F.lit(0), F.lit(0))).when(F.col("h").between(30, 32), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    t = t.withColumn("kind", F.explode(kinds.cast("array<int>")))
    extra = F.col("kind") == 1
    start = F.when(extra, F.col("end") + 2).otherwise(F.col("start"))
    end = F.when(extra, F.col("end") + 10).when(F.col("h").between(10, 19), F.col("end") + 1).otherwise(F.col("end"))
    line = F.when(F.col("h").between(20, 24), F.col("line") + 1).otherwise(F.col("line"))
    return t.select("doc_id", start.alias("start"), end.alias("end"), line.alias("line"), "score")


def labelled(tok: DataFrame) -> DataFrame:
    k = F.pmod(F.col("doc_id") * 31 + F.col("start"), F.lit(10))
    return tok.withColumn("label", F.when(k < 6, P.POSITIVE).when(k < 9, P.NEGATIVE).otherwise(P.AMBIGUOUS))


def pieces(tok: DataFrame) -> DataFrame:
    """Three word pieces of each token, some of them in two windows."""
    cut = F.array(F.struct(F.col("start").alias("s"), (F.col("start") + 4).alias("e")), F.struct((F.col("start") + 4).alias("s"), (F.col("start") + 8).alias("e")), F.struct((F.col("start") + 8).alias("s"), F.col("end").alias("e")))
    t = tok.select("doc_id", "start", F.posexplode(cut).alias("k", "x")).select("doc_id", F.col("x.s").alias("start"), F.col("x.e").alias("end"), "k")
    label = F.get(F.array(F.lit("O"), F.lit("B"), F.lit("I")), F.pmod(F.col("doc_id") + F.col("start") + 7 * F.col("k"), F.lit(3)).cast("int"))
    t = t.withColumn("label", label).withColumn("p", F.pmod(F.col("doc_id") * 13 + F.col("start") + F.col("k"), F.lit(100)) / F.lit(100.0)).withColumn("pos", F.col("start"))
    windows = F.when(F.pmod(F.col("start"), F.lit(5)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    t = t.withColumn("window", F.explode(windows))
    return t.select("doc_id", "window", "pos", "start", "end", "label", F.when(F.col("window") == 1, F.col("p") / 2).otherwise(F.col("p")).alias("p"))
