"""URL filters as a sort-merge range join, with DataFrame operations alone.

A canonical key is the reversed host followed by the path: rule example.com/en/7 has the key
`com.example/en/7`, and what it covers on that host is the interval from this key to the same key with a byte
behind it that no UTF-8 text has (keys are compared as bytes). A rule covers subdomains too, so a url has one key for each of its host's
levels (com, com.example, com.example.blog). Rule keys and url keys of a level are sorted together and swept
once. A rule's start pushes it on the stack of active rules and its end pops it, which uncovers the rule it
is nested in; so start events carry the rule and end events the one around it, and the last event before a
url key is the top of the stack. Of the levels of a url, the longest rule wins.

A host level with many urls is dealt over several sorted runs, into each of which its rules are copied.

Defined results: a url that is null or has no `://` has an empty host and path; where no rule fits, rule is
null and the verdict is the default; repeated rows each get a result; of rules with the same host and path
`block` wins; rules with a null host or path fit nothing; empty tables give no rows; other columns, whatever
their names, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower

#: (host, path, action)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
KEYS_PER_RUN = 512  # or four times the level's rules, so that copies of rules stay fewer than keys
SMALL_RULES = 20_000
TOP = "FF"


def url_parts(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed_host(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _events(rules: DataFrame) -> DataFrame:
    """level, key, kind 0, top (the rule on top of the stack from this key on; its fields null for none)."""
    at = rules.select(F.array_join(_reversed_host(F.col("host")), ".").alias("level"), "host", "path", "action")
    nested = at.select("level", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")).filter("n < length(path)")
    nested = nested.select("level", "path", F.expr("substring(path, 1, n)").alias("outer_path"))
    outer = at.select("level", F.col("path").alias("outer_path"), F.struct(F.length("path").alias("n"), "host", "path", "action").alias("outer"))
    around = nested.join(outer, ["level", "outer_path"]).groupBy("level", "path").agg(F.max("outer").alias("outer"))
    at = at.join(around, ["level", "path"], "left")
    key = F.concat("level", "path").cast("binary")
    here = F.struct(F.col("host"), F.col("path"), F.col("action"))
    there = F.struct(F.col("outer.host").alias("host"), F.col("outer.path").alias("path"), F.col("outer.action").alias("action"))
    start = at.select("level", key.alias("key"), here.alias("top"))
    return start.unionByName(at.select("level", F.concat(key, F.unhex(F.lit(TOP))).alias("key"), there.alias("top"))).withColumn("kind", F.lit(0))


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict. rules: host, path, action."""
    spark = pages.sparkSession
    if rules is None:
        rule = lambda host, path, action: F.struct(F.lit(host).alias("host"), F.lit(path).alias("path"), F.lit(action).alias("action"))
        rules = spark.range(1).select(F.inline(F.array(*[rule(*r) for r in RULES])))
    rules = rules.filter("host is not null and path is not null").groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.max("action").alias("action"))
    few = rules.limit(SMALL_RULES + 1).count() <= SMALL_RULES
    events = _events(rules)

    urls = pages.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("_n"))
    host, path = url_parts(F.col("url"))
    urls = urls.select("page_id", "url", "_n", host.alias("host"), path.alias("path"))
    labels = _reversed_host(F.col("host"))
    levels = urls.select("page_id", "url", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, 1, k), "."))).alias("level"))
    ruled = events.groupBy("level").agg(F.greatest(F.lit(KEYS_PER_RUN), F.lit(2) * F.count(F.lit(1))).alias("keys"))
    levels = levels.join(F.broadcast(ruled) if few else ruled, "level")
    counts = levels.groupBy("level").agg(F.ceil(F.count(F.lit(1)) / F.max("keys")).cast("int").alias("runs"))
    counts = F.broadcast(counts) if few else counts  # no more rows than rules
    keyed = levels.join(counts, "level").select("level", F.pmod(F.xxhash64("page_id", "url"), "runs").cast("int").alias("run"), F.concat("level", "path").cast("binary").alias("key"), F.lit(1).alias("kind"), "page_id", "url")
    copied = events.join(counts, "level").select("level", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), "key", "kind", "top")

    swept = Window.partitionBy("level", "run").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = copied.unionByName(keyed, allowMissingColumns=True).withColumn("top", F.last("top", ignorenulls=True).over(swept))
    hits = merged.filter("kind = 1 and top.action is not null").select("page_id", "url", F.struct((F.length("top.host") + F.length("top.path")).alias("n"), F.length("top.host").alias("h"), "top.host", "top.path", "top.action").alias("best"))
    whole = urls.select("page_id", "url", "_n", "host", "path").unionByName(hits, allowMissingColumns=True)
    found = whole.groupBy("page_id", "url").agg(F.max("_n").alias("_n"), F.max("host").alias("host"), F.max("path").alias("path"), F.max("best").alias("best"))
    found = found.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return found.select("page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {pages}
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM split
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
