"""Deterministic sampling, blind packets and label freezing. Order comes from SHA-256, never from a random stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def hash_order(*parts: Column | str, seed: str = "0") -> Column:
    """Sort key: SHA-256 hex of the seed and the parts, joined by |."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def allocate(pools: DataFrame, n: int) -> DataFrame:
    """stratum, pool -> stratum, pool, alloc. Each stratum starts with its floored share of n, one at least and its
    pool at most; what is then missing or too much goes in rounds by the fractional remainder, largest first
    (ties: stratum), never below 1 or above the pool. Closed form: a stratum's spare places (or surplus) in the
    order (round, rank), of which the first |n - sum| are taken."""
    whole = Window.partitionBy()
    t = pools.withColumn("total", F.sum("pool").over(whole)).withColumn("share", F.lit(n) * F.col("pool") / F.col("total"))
    t = t.withColumn("first", F.least(F.col("pool"), F.greatest(F.lit(1), F.floor("share")))).withColumn("rest", F.col("share") - F.floor("share"))
    t = t.withColumn("gap", F.lit(n) - F.sum("first").over(whole)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rest"), "stratum")))
    room = F.when(F.col("gap") > 0, F.col("pool") - F.col("first")).otherwise(F.col("first") - 1)
    units = t.withColumn("room", F.least(room, F.abs("gap"))).filter("room > 0").select("stratum", "rank", "gap", F.explode(F.sequence(F.lit(1).cast("long"), F.col("room").cast("long"))).alias("pass"))
    taken = units.withColumn("nth", F.row_number().over(Window.orderBy("pass", "rank"))).filter(F.col("nth") <= F.abs("gap")).groupBy("stratum").agg(F.count(F.lit(1)).alias("k"))
    out = t.join(taken, "stratum", "left")
    return out.select("stratum", "pool", (F.col("first") + F.signum("gap") * F.coalesce("k", F.lit(0))).cast("long").alias("alloc"))


def pick(items: DataFrame, alloc: DataFrame, key: str = "id", seed: str = "0") -> DataFrame:
    """items (key, stratum) with picked: the first alloc of each stratum in hash order."""
    order = Window.partitionBy("stratum").orderBy(hash_order("pick", F.col(key).cast("string"), seed=seed), key)
    ranked = items.withColumn("nth", F.row_number().over(order)).join(alloc.select("stratum", "alloc"), "stratum")
    return ranked.withColumn("picked", F.col("nth") <= F.col("alloc")).drop("nth", "alloc")


def round_robin(items: DataFrame, by: list[str], order: list, parts: int = 3) -> DataFrame:
    """items with part: A, B, C... in turn within each group."""
    letter = F.get(F.array(*[F.lit(chr(65 + k)) for k in range(parts)]), F.pmod(F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1, F.lit(parts)))
    return items.withColumn("part", letter)


def packets(items: DataFrame, dup_rate: float = 0.12, around: int = 8, seed: str = "0") -> tuple[DataFrame, DataFrame]:
    """items (id, lang, text, start, end, line) -> (packet_id, lang, context) and, apart from it, the sealed
    (packet_id, id, is_dup). The share dup_rate of the items appears twice. Contexts show the lines around and a
    caret line under the span."""
    n = F.round(F.count(F.lit(1)).over(Window.partitionBy()) * dup_rate)
    again = items.withColumn("k", F.row_number().over(Window.orderBy(hash_order("dup", F.col("id").cast("string"), seed=seed), "id"))).withColumn("n", n).filter(F.col("k") <= F.col("n")).drop("k", "n")
    both = items.withColumn("is_dup", F.lit(False)).unionByName(again.withColumn("is_dup", F.lit(True)))
    nth = F.row_number().over(Window.orderBy(hash_order("order", F.col("id").cast("string"), F.col("is_dup").cast("string"), seed=seed), "id"))
    both = both.withColumn("packet_id", F.concat(F.lit("spkt-"), F.lpad((nth - 1).cast("string"), 4, "0")))
    lines = F.split("text", "\n")
    starts = T.line_starts(F.col("text"))
    col = F.col("start") - F.get(starts, F.col("line") - 1)
    caret = F.concat(F.repeat(F.lit(" "), col), F.repeat(F.lit("^"), F.greatest(F.lit(1), F.col("end") - F.col("start"))))
    first = F.greatest(F.col("line") - around, F.lit(1))
    shown = F.concat(F.slice(lines, first, F.col("line") - first + 1), F.array(caret), F.slice(lines, F.col("line") + 1, F.lit(around)))
    return both.select("packet_id", "lang", F.array_join(shown, "\n").alias("context")), both.select("packet_id", "id", "is_dup")


def unsealed(given: DataFrame, sealed: DataFrame) -> DataFrame:
    """id, label: labels of packets (packet_id, label) brought to the items of the sealed map. Packet ids have four digits, so
    from 10,000 packets on several share one; each packet takes its id's label once, not once for every packet of that id."""
    return sealed.join(given.select("packet_id", "label").distinct(), "packet_id").select("id", "label")


def invalid_labels(labels: DataFrame) -> DataFrame:
    """Label rows outside the label domain; freezing needs this to be empty."""
    return labels.filter(~F.coalesce(F.col("label"), F.lit("")).isin(P.POSITIVE, P.NEGATIVE, P.AMBIGUOUS))


def resolve_labels(labels: DataFrame) -> DataFrame:
    """id, label, n_labels, agreed: a unanimous label stands, any other becomes ambiguous."""
    per = labels.groupBy("id").agg(F.count_distinct("label").alias("k"), F.count(F.lit(1)).alias("n_labels"), F.min("label").alias("one"))
    return per.select("id", F.when(F.col("k") == 1, F.col("one")).otherwise(P.AMBIGUOUS).alias("label"), "n_labels", (F.col("k") == 1).alias("agreed"))


def agreement(resolved: DataFrame) -> DataFrame:
    """pairs, agreed, rate over what was labelled more than once."""
    t = resolved.filter("n_labels > 1").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("agreed").alias("agreed"))
    return t.select("pairs", "agreed", F.round(F.when(F.col("pairs") > 0, F.col("agreed") / F.col("pairs")), 4).alias("rate"))


def frozen_hash(resolved: DataFrame) -> DataFrame:
    """labels_sha256 of the canonical JSON object {id: label}, ids in order. Entries are joined in one row: for label
    sets, which people make."""
    entries = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "label"))), lambda x: F.concat(F.lit('"'), x["id"].cast("string"), F.lit('": "'), x["label"], F.lit('"'))), ", ")
    return resolved.agg(F.sha2(F.concat(F.lit("{"), entries, F.lit("}")), 256).alias("labels_sha256"), F.count(F.lit(1)).alias("n"))


def suggest(items: DataFrame) -> DataFrame:
    """items (detector, key: the line before the value, value) with label and reason."""
    key, value, detector = F.col("key"), F.col("value"), F.col("detector")
    out = F.when(detector == "pem_private", F.struct(F.lit(P.POSITIVE).alias("label"), F.lit("private key").alias("reason")))
    rule = lambda label, reason: F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"))
    out = out.when(detector == "vendor_prefix", rule(P.POSITIVE, "vendor prefix")).when(T.has(value, P.PLACEHOLDER) | T.has(key, P.PLACEHOLDER), rule(P.NEGATIVE, "placeholder"))
    out = out.when(T.has(key, P.NEGATIVE_KEY) & ~T.has(key, P.STRONG_KEY), rule(P.NEGATIVE, "key of a non-secret")).when(T.has(key, P.STRONG_KEY), rule(P.POSITIVE, "key of a secret"))
    out = out.when(detector == "gitleaks", rule(P.POSITIVE, "flagged by a scanner")).when((T.entropy(value) >= 4.3) & (F.length(value) >= 24), rule(P.AMBIGUOUS, "bare high-entropy literal")).otherwise(rule(P.AMBIGUOUS, "unclear"))
    return items.withColumn("_s", out).select(*items.columns, "_s.label", "_s.reason")


def capped(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of each group. Of a large group every task passes on that many only."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")
