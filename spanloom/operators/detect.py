"""Detectors as data: known non-secrets (lookalikes), credential candidates, and the gate between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from . import spans as S


def lookalikes(docs: DataFrame, keys: Sequence[str] = ("doc_id",), table=P.LOOKALIKES) -> DataFrame:
    """keys, start, end, line, category, value_len: of overlapping ones the earlier category's stays. Degenerate
    hex strings are no lookalikes and hold no place. One pass over the texts for all categories."""

    names = F.array(*[F.lit(name) for name, _ in table])
    one = lambda h, k: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["line"].alias("line"), h["value"].alias("value"), k.alias("priority"), F.get(names, k).alias("category"))
    found = F.flatten(F.transform(T.matches_each(F.col("text"), [(p, "", "") for _, p in table]), lambda hits, k: F.transform(hits, lambda h: one(h, k))))
    rows = S.placed(docs, found, keys)
    real = rows.filter(~F.col("category").isin(*P.HEX_CATEGORIES) | ~T.degenerate_hex(F.col("value")))
    out = S.first_wins(real.select(*keys, "start", "end", "line", "category", "priority"), ("priority", "start"), keys)
    return out.select(*keys, "start", "end", "line", "category", (F.col("end") - F.col("start")).alias("value_len"))


def in_quota(spans: DataFrame, quotas: dict[str, int] = P.QUOTAS, order: Sequence[str] = ("doc_id", "start")) -> DataFrame:
    """spans with in_quota: whether the span is among the first of its category. Others are neither truth nor
    false alarms."""
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col("category"))
    return spans.withColumn("in_quota", F.row_number().over(Window.partitionBy("category").orderBy(*order)) <= limit)


def raw_candidates(docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, start, end, line, value, detector, family, priority: before coverage and overlaps are resolved."""
    text = F.col("text")

    def tagged(priority: int, detector: str, family: str, hits: Column) -> Column:
        return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["line"].alias("line"), h["value"].alias("value"), F.lit(detector).alias("detector"), F.lit(family).alias("family"), F.lit(priority).alias("priority")))

    def plain(v: Column, least: int) -> Column:
        dots = F.length(v) - F.length(F.replace(v, F.lit("."), F.lit("")))
        return (F.length(v) >= least) & ~F.contains(v, F.lit("/")) & (dots < 2)

    def resolved(each: Column) -> Column:
        keyed = F.filter(F.get(each, F.lit(2)), lambda h: plain(h["value"], 8))
        quoted = F.filter(F.get(each, F.lit(3)), lambda h: h["before"].isin('"', "'", "`") & plain(h["value"], 24))
        return F.concat(
            tagged(0, "pem_private", "private_key", F.get(each, F.lit(0))), tagged(1, "vendor_prefix", "vendor_token", F.get(each, F.lit(1))),
            tagged(2, "entropy", "keyworded_generic", keyed), tagged(3, "entropy", "generic_high_entropy", quoted),
        )

    every = T.let(T.matches_each(text, [(P.PEM_PRIVATE, "", ""), (P.VENDOR, "", ""), (P.KEYWORDED_VALUE, P.KEYWORDED, P.NO_CALL), (P.TOKEN, "", "")]), resolved)
    rows = S.placed(docs, every, keys)
    least = F.when(F.col("priority") == 2, 3.0).when(F.col("priority") == 3, 4.5).otherwise(0.0)
    return rows.filter(T.entropy(F.col("value")) >= least).select(*keys, "start", "end", "line", "value", "detector", "family", "priority")


def candidates(docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, start, end, line, value, detector, family: credential-like spans that are not within a lookalike."""
    free = S.covered(raw_candidates(docs, keys), lookalikes(docs, keys), keys, "left_anti")
    return S.first_wins(free, ("priority", "start"), keys).drop("priority")


def with_external(internal: DataFrame, external: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Union of own spans and those of other scanners (start, end, detector, family); own ones come first, and
    of the others those that overlap go."""
    columns = [*keys, "start", "end", "detector", "family"]
    both = internal.select(*columns, F.lit(0).alias("external")).unionByName(external.select(*columns, F.lit(1).alias("external")))
    # sides partitioned alike may come in different numbers of partitions at run time, which Spark 4.1 then fails to merge
    internal.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return S.first_wins(both, ("external", "start", "end", "detector"), keys)


def unexplained(findings: DataFrame, spans: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Findings (keys, tool, line, value) that no lookalike explains: none on their line, and, where the tool
    gives a value, the value looks like none."""
    on_line = findings.join(spans.select(*keys, "line").distinct(), [*keys, "line"], "left_anti")
    alike = F.lit(False)
    for _, p in P.LOOKALIKES:
        alike = alike | F.coalesce(T.has(F.col("value"), p), F.lit(False))
    return on_line.filter(~alike)


def gate(docs: DataFrame, findings: DataFrame, spans: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """docs all of whose findings are explained."""
    return docs.join(unexplained(findings, spans, keys).select(*keys).distinct(), list(keys), "left_anti")
