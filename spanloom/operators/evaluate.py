"""Scoring predicted spans against gold spans. Counts are exact; ratios are rounded last."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans as S


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), digits)


def prf(tp: Column, fp: Column, fn: Column, digits: int = 4) -> list[Column]:
    """precision, recall and F1; 0 where there is nothing to divide by."""
    return [ratio(tp, tp + fp, digits).alias("precision"), ratio(tp, tp + fn, digits).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn, digits).alias("f1")]


def above(pred: DataFrame, tau: float) -> DataFrame:
    """Predictions at or above a threshold; a missing score counts as 1."""
    return pred.filter(F.coalesce("score", F.lit(1.0)) >= tau)


def counts(gold: DataFrame, pred: DataFrame, on: Sequence[str] = ("doc_id", "start", "end"), by: Sequence[str] = ()) -> DataFrame:
    """by, tp, fp, fn: spans matched one to one on equal keys, null lines equal, with multiplicity. One shuffle by
    the keys, no join: each key has as many matches as the smaller of its two counts."""
    cols = [*dict.fromkeys([*by, *on])]
    both = gold.select(*cols, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select(*cols, F.lit(0).alias("g"), F.lit(1).alias("p")))
    per = both.groupBy(*cols).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    tp = F.least("g", "p")
    return per.groupBy(*by).agg(F.coalesce(F.sum(tp), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.col("p") - tp), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.col("g") - tp), F.lit(0)).alias("fn"))


def scored(gold: DataFrame, pred: DataFrame, on: Sequence[str] = ("doc_id", "start", "end"), by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    t = counts(gold, pred, on, by)
    return t.select(*by, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn"), digits))


STRICT = ("doc_id", "start", "end", "line")


def numbered(spans: DataFrame, name: str) -> DataFrame:
    """spans with a number within their document, in order of start, end, line."""
    return spans.withColumn(name, F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "line")))


def overlap_pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """doc_id, p, g, overlap: numbered predictions and gold spans with the characters they share."""
    both = S.overlapping(numbered(pred, "p"), numbered(gold, "g"))
    return both.select("a.doc_id", "p", "g", (F.least("a.end", "b.end") - F.greatest("a.start", "b.start")).alias("overlap"))


def greedy_overlap(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """tp, fp, fn of one-to-one greedy matching by largest overlap."""
    tp = S.greedy_pairs(overlap_pairs(gold, pred)).agg(F.count(F.lit(1)).alias("tp"))
    t = tp.join(pred.agg(F.count(F.lit(1)).alias("np"))).join(gold.agg(F.count(F.lit(1)).alias("ng")))  # three rows of one
    return t.select("tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"), *prf(F.col("tp"), F.col("np") - F.col("tp"), F.col("ng") - F.col("tp")))


def overlap_recall(gold: DataFrame, pred: DataFrame) -> DataFrame:
    hit = S.overlapping(gold, pred, how="left_semi").agg(F.count(F.lit(1)).alias("hit"))
    return hit.join(gold.agg(F.count(F.lit(1)).alias("total"))).select("hit", "total", ratio(F.col("hit"), F.col("total")).alias("recall"))


def file_confusion(docs: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """tp, fp, fn, tn of documents with any gold span and any prediction."""
    flags = docs.select("doc_id", F.lit(False).alias("g"), F.lit(False).alias("p")).unionByName(gold.select("doc_id", F.lit(True).alias("g"), F.lit(False).alias("p"))).unionByName(pred.select("doc_id", F.lit(False).alias("g"), F.lit(True).alias("p")))
    per = flags.groupBy("doc_id").agg(F.bool_or("g").alias("g"), F.bool_or("p").alias("p"))
    t = per.agg(F.count_if(F.expr("g and p")).alias("tp"), F.count_if(F.expr("not g and p")).alias("fp"), F.count_if(F.expr("g and not p")).alias("fn"), F.count_if(F.expr("not g and not p")).alias("tn"))
    return t.select("tp", "fp", "fn", "tn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def fragmentation(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """n_overlaps, n_gold: how many predictions each gold span is broken into."""
    g = numbered(gold, "g")
    hits = S.overlapping(g, pred).groupBy("a.doc_id", "g").count()
    per = g.select("doc_id", "g").join(hits, ["doc_id", "g"], "left").select(F.coalesce("count", F.lit(0)).alias("n_overlaps"))
    return per.groupBy("n_overlaps").agg(F.count(F.lit(1)).alias("n_gold"))


def false_alarms(lookalikes: DataFrame, pred: DataFrame) -> DataFrame:
    """category (null: all), n, flagged, rate: lookalikes that any prediction overlaps."""
    marked = lookalikes.alias("a").join(pred.select("doc_id", "start", "end").alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & S.overlaps("a", "b"), "left").groupBy("a.doc_id", "a.start", "a.end", "a.category").agg(F.count("b.start").alias("k"))
    t = marked.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") > 0).alias("flagged"))
    return t.select("category", "n", "flagged", F.round(F.col("flagged") / F.greatest(F.lit(1), F.col("n")), 4).alias("rate"))


def _judged(labelled: DataFrame, pred: DataFrame) -> DataFrame:
    """pred (doc_id, start, end, line, nth) with matched (a positive of its own has the same place), ambiguous, negative and
    near: whether it overlaps candidates of these labels, or any. One join by place, one interval join."""
    keys = list(STRICT)
    gold = labelled.filter(F.col("label") == "POLICY_POSITIVE").groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).alias("g")
    p = pred.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("score")).alias("nth")).alias("p")
    p = p.join(gold, [F.col(f"p.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys], "left").select("p.*", (F.col("nth") <= F.coalesce("k", F.lit(0))).alias("matched"))
    near = S.overlapping(p, labelled, how="left").groupBy(*[f"a.{c}" for c in p.columns])
    is_ = lambda label: F.coalesce(F.bool_or(F.col("b.label") == label), F.lit(False))
    return near.agg(is_("AMBIGUOUS_EXCLUDED").alias("ambiguous"), is_("POLICY_NEGATIVE").alias("negative"), (F.count("b.label") > 0).alias("near"))


def adjudicated(labelled: DataFrame, pred: DataFrame) -> DataFrame:
    """Score against candidates with labels (doc_id, start, end, line, label): positives are gold; a prediction that
    matches none and overlaps an ambiguous one is left out; every other false alarm gets a class."""
    clear = ~F.col("matched") & ~F.col("ambiguous")
    t = _judged(labelled, pred).agg(F.count_if("matched").alias("tp"), F.count_if(clear).alias("fp"), F.count_if(clear & F.col("negative")).alias("fp_negative"), F.count_if(clear & ~F.col("near")).alias("fp_off"))
    one = t.join(labelled.agg(F.count_if(F.col("label") == "POLICY_POSITIVE").alias("n")))  # two rows of one
    one = one.select("tp", "fp", (F.col("n") - F.col("tp")).alias("fn"), "fp_negative", "fp_off")
    return one.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def adjudicated_files(labelled: DataFrame, pred: DataFrame) -> DataFrame:
    """tp, fp, fn of documents with a positive and documents with a prediction that overlaps no ambiguous candidate."""
    gold = labelled.filter(F.col("label") == "POLICY_POSITIVE").select("doc_id", F.lit(True).alias("g"), F.lit(False).alias("p"))
    both = gold.unionByName(_judged(labelled, pred).filter(~F.col("ambiguous")).select("doc_id", F.lit(False).alias("g"), F.lit(True).alias("p")))
    t = both.groupBy("doc_id").agg(F.bool_or("g").alias("g"), F.bool_or("p").alias("p")).agg(F.count_if(F.expr("g and p")).alias("tp"), F.count_if(F.expr("p and not g")).alias("fp"), F.count_if(F.expr("g and not p")).alias("fn"))
    return t.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def nth_of(keys: Sequence[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))


def sweep(gold: DataFrame, pred: DataFrame, lookalikes: DataFrame, taus: Sequence[float]) -> DataFrame:
    """tau, recall (strict), fp_rate (lookalikes flagged), for all thresholds in one pass: what a threshold keeps
    follows from the best score of each span, so spans are joined once and only the grid is crossed."""
    grid = F.broadcast(gold.sparkSession.createDataFrame([(float(t),) for t in taus], "tau double"))  # as long as the list
    best = pred.groupBy(*STRICT).agg(F.max(F.coalesce("score", F.lit(1.0))).alias("best"))
    g = gold.select(*STRICT).distinct().join(best, list(STRICT), "left").select(F.lit(1).alias("gold"), F.col("best"))
    flagged = lookalikes.select("doc_id", "start", "end").alias("a").join(pred.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & S.overlaps("a", "b"), "left").groupBy("a.doc_id", "a.start", "a.end").agg(F.max(F.when(F.col("b.start").isNotNull(), F.coalesce("b.score", F.lit(1.0)))).alias("best"))
    rows = g.unionByName(flagged.select(F.lit(0).alias("gold"), "best")).groupBy("gold", "best").count()
    hit = F.coalesce(F.col("best") >= F.col("tau"), F.lit(False))
    t = rows.join(grid).groupBy("tau").agg(F.sum(F.when((F.col("gold") == 1) & hit, F.col("count")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("gold") == 1, F.col("count")).otherwise(0)).alias("n_gold"), F.sum(F.when((F.col("gold") == 0) & hit, F.col("count")).otherwise(0)).alias("flagged"), F.sum(F.when(F.col("gold") == 0, F.col("count")).otherwise(0)).alias("n_lookalikes"))
    return t.select("tau", "tp", "n_gold", "flagged", "n_lookalikes", ratio(F.col("tp"), F.col("n_gold")).alias("recall"), ratio(F.col("flagged"), F.col("n_lookalikes")).alias("fp_rate"))


def best_recall(curve: DataFrame, max_fp: float) -> DataFrame:
    """The threshold of highest recall with fp_rate at most max_fp; of equals the lowest."""
    return curve.filter(F.col("fp_rate") <= max_fp).agg(F.max_by(F.struct("tau", "recall", "fp_rate"), F.struct("recall", -F.col("tau"))).alias("x")).select("x.*")


def least_alarms(curve: DataFrame, min_recall: float) -> DataFrame:
    """The threshold of lowest fp_rate with recall at least min_recall; of equals the lowest."""
    return curve.filter(F.col("recall") >= min_recall).agg(F.min_by(F.struct("tau", "recall", "fp_rate"), F.struct("fp_rate", "tau")).alias("x")).select("x.*")


def discordant(items: DataFrame) -> DataFrame:
    """both, only_a, only_b, neither over items (a, b booleans)."""
    return items.agg(F.count_if(F.expr("a and b")).alias("both"), F.count_if(F.expr("a and not b")).alias("only_a"), F.count_if(F.expr("not a and b")).alias("only_b"), F.count_if(F.expr("not a and not b")).alias("neither"))


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided McNemar p-value of the two discordant counts."""
    n, k = b + c, min(b, c)
    return 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)


def tool_rows(gold: DataFrame, detections: DataFrame) -> DataFrame:
    """gold (file, has, line or null) and detections (tool, file, line) as one long table, whose gold rows have no tool."""
    return gold.select("file", F.lit(None).cast("string").alias("tool"), "line", "has").unionByName(detections.select("file", "tool", "line", F.lit(None).cast("boolean").alias("has")))


def tool_scores(rows: DataFrame, tools: DataFrame, digits: int = 3) -> DataFrame:
    """tool, status and, at file and line level, counts, precision, recall and F1 of all tools. rows: file, tool (null: gold),
    line (-1: unknown, still flags the file; null: none), has; tools: tool, status. A tool that did not run has
    nulls, never zeros. One shuffle by file; of a file only its distinct lines are held together."""
    is_gold, found = F.col("tool").isNull(), F.struct("tool", "line")
    per = rows.groupBy("file").agg(F.bool_or(is_gold).alias("known"), F.coalesce(F.bool_or("has"), F.lit(False)).alias("has"), F.collect_set(F.when(is_gold, F.col("line"))).alias("lines"), F.collect_set(F.when(~is_gold, found)).alias("found"))
    hit = lambda level, tool, real: F.struct(F.lit(level).alias("level"), tool.alias("tool"), real.alias("real"))
    at_file = F.transform(F.array_distinct(F.transform("found", lambda x: x["tool"])), lambda t: hit("file", t, F.col("has")))
    at_line = F.transform(F.filter("found", lambda x: x["line"] > 0), lambda x: hit("line", x["tool"], F.array_contains("lines", x["line"])))
    whole = F.concat(F.array(hit("file", F.lit(None).cast("string"), F.col("has"))), F.transform("lines", lambda x: hit("line", F.lit(None).cast("string"), F.lit(True))))
    each = per.filter("known").select(F.explode(F.concat(at_file, at_line, whole)).alias("x")).select("x.*")
    at = lambda level, real: F.count_if((F.col("level") == level) & (F.col("real") == real))
    t = each.groupBy("tool").agg(at("file", True).alias("file_tp"), at("file", False).alias("file_fp"), at("line", True).alias("line_tp"), at("line", False).alias("line_fp"))
    n = t.filter("tool is null").agg(F.coalesce(F.max("file_tp"), F.lit(0)).alias("n_file"), F.coalesce(F.max("line_tp"), F.lit(0)).alias("n_line"))
    t = tools.join(t.filter("tool is not null"), "tool", "left").join(n)  # a row for each tool, and one row
    ran = F.col("status") == "ok"
    v = lambda c: F.when(ran, F.coalesce(c, F.lit(0)))
    out = [F.col("tool"), F.when(ran, F.lit("ok")).otherwise(F.lit("NOT RUN")).alias("status")]
    for level in ("file", "line"):
        tp, fp, fn = v(F.col(f"{level}_tp")), v(F.col(f"{level}_fp")), F.when(ran, F.col(f"n_{level}") - F.coalesce(f"{level}_tp", F.lit(0)))
        out += [tp.alias(f"{level}_tp"), fp.alias(f"{level}_fp"), fn.alias(f"{level}_fn")]
        out += [F.when(ran, x).alias(f"{level}_{name}") for x, name in zip((ratio(tp, tp + fp, digits), ratio(tp, tp + fn, digits), ratio(2 * tp, 2 * tp + fp + fn, digits)), ("p", "r", "f1"), strict=True)]
    return t.select(*out)


def tool_strict(gold: DataFrame, spans: DataFrame, tools: list[str], digits: int = 3) -> DataFrame:
    """tool, tp, fp, fn and ratios of exact places with lines, for tools that give spans (tool, doc_id, start, end, line)."""
    each = gold.select(*STRICT, F.explode(F.array(*map(F.lit, tools))).alias("tool"))
    return scored(each, spans, STRICT, ("tool",), digits)


def evaluate(docs: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row of all counts: documents, spans, inflation, exact, strict and document level, line accuracy, fragmentation.
    Both sides are dealt by document once; all levels are sums over that dealing."""
    kind = lambda df, g, p: df.select("doc_id", "start", "end", "line", F.lit(g).alias("g"), F.lit(p).alias("p"))
    none = F.lit(None).cast("int")
    rows = kind(gold, 1, 0).unionByName(kind(pred, 0, 1)).unionByName(docs.select("doc_id", none.alias("start"), none.alias("end"), none.alias("line"), F.lit(0).alias("g"), F.lit(0).alias("p")))
    rows = rows.repartition("doc_id")
    strict = rows.groupBy(*STRICT).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    exact = strict.groupBy("doc_id", "start", "end").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum(F.least("g", "p")).alias("strict"))
    per = exact.groupBy("doc_id").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum("strict").alias("strict"), F.sum(F.least("g", "p")).alias("exact"))
    sums = per.agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("g", "n_gold"), ("p", "n_pred"), ("exact", "exact_tp"), ("strict", "strict_tp"))],
        F.count_if(F.expr("g > 0 and p > 0")).alias("file_tp"), F.count_if(F.expr("g = 0 and p > 0")).alias("file_fp"), F.count_if(F.expr("g > 0 and p = 0")).alias("file_fn"), F.count_if(F.expr("g = 0 and p = 0")).alias("file_tn"),
    )
    broken = fragmentation_summary(gold, pred).select("n_multi", "pct_fragmented", "n_any")
    of_gold = F.nullif(F.col("n_gold"), F.lit(0))
    return sums.join(broken).select("*", F.round(F.col("n_pred") / of_gold, 4).alias("inflation"), ratio(F.col("strict_tp"), F.col("exact_tp")).alias("line_accuracy"))  # two rows of one


def fragmentation_summary(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """n_gold, n_multi and pct_fragmented (more than one prediction), n_any (at least one)."""
    h = fragmentation(gold, pred)
    t = h.agg(F.coalesce(F.sum("n_gold"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(F.when(F.col("n_overlaps") >= k, F.col("n_gold"))), F.lit(0)).alias(name) for k, name in ((2, "n_multi"), (1, "n_any"))])
    return t.select(F.col("n").alias("n_gold"), "n_multi", F.round(100 * F.col("n_multi") / F.nullif(F.col("n"), F.lit(0)), 2).alias("pct_fragmented"), "n_any")


def alarms_and_recall(planted: DataFrame, detections: DataFrame) -> DataFrame:
    """tool, n_files, flagged, line_hits: of files with one planted line (file, line; a null line: none planted) those a
    tool flags at all, and those whose planted line it flags. detections: tool, file, line."""
    per = detections.join(planted.withColumnRenamed("line", "planted"), "file").groupBy("tool", "file").agg(F.bool_or(F.coalesce(F.col("line") == F.col("planted"), F.lit(False))).alias("hit"), (F.count("planted") > 0).alias("is_planted"))
    t = per.groupBy("tool").agg(F.count_if(~F.col("is_planted")).alias("clean_flagged"), F.count_if("is_planted").alias("planted_flagged"), F.count_if("hit").alias("line_hits"))
    n = planted.agg(F.count_if(F.col("line").isNull()).alias("n_clean"), F.count_if(F.col("line").isNotNull()).alias("n_planted"))
    return t.join(n).select("tool", "clean_flagged", "n_clean", "planted_flagged", "line_hits", "n_planted", ratio(F.col("clean_flagged"), F.col("n_clean"), 3).alias("file_fp"), ratio(F.col("line_hits"), F.col("n_planted"), 3).alias("line_recall"), ratio(F.col("planted_flagged"), F.col("n_planted"), 3).alias("file_recall"))


def file_alarm_sweep(files: DataFrame, pred: DataFrame, taus: Sequence[float], tag: str) -> DataFrame:
    """tag, tau, flagged, n_files, file_fp: clean files with any prediction at or above each threshold."""
    best = files.select("doc_id").join(pred.groupBy("doc_id").agg(F.max(F.coalesce("score", F.lit(1.0))).alias("best")), "doc_id", "left").groupBy("best").count()
    grid = files.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau"))
    t = best.join(F.broadcast(grid)).groupBy("tau").agg(F.sum(F.when(F.col("best") >= F.col("tau"), F.col("count")).otherwise(0)).alias("flagged"), F.sum("count").alias("n_files"))
    return t.select(F.lit(tag).alias("tag"), "tau", "flagged", "n_files", ratio(F.col("flagged"), F.col("n_files")).alias("file_fp"))


def error_rates(rows: DataFrame, tau: float) -> DataFrame:
    """n_negative, n_fp, fp_rate, n_positive, n_fn, fn_rate of rows (label, maxscore)."""
    neg, pos, hit = F.col("label") == 0, F.col("label") == 1, F.coalesce("maxscore", F.lit(0.0)) >= tau
    t = rows.agg(F.count_if(neg).alias("n_negative"), F.count_if(neg & hit).alias("n_fp"), F.count_if(pos).alias("n_positive"), F.count_if(pos & ~hit).alias("n_fn"))
    rate = lambda a, b: F.round(F.col(a) / F.greatest(F.lit(1), F.col(b)), 4)
    return t.select("*", rate("n_fp", "n_negative").alias("fp_rate"), rate("n_fn", "n_positive").alias("fn_rate"))


def most_common(rows: DataFrame, bucket: str, order: Sequence[str], n: int = 15) -> DataFrame:
    """bucket, n, pct of the n most frequent buckets; of equals that which is first in the order."""
    per = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("_first"))
    whole = per.agg(F.sum("n").alias("_all"))
    return per.join(whole).orderBy(F.desc("n"), "_first").limit(n).select(bucket, "n", F.round(100 * F.col("n") / F.col("_all"), 1).alias("pct"))
