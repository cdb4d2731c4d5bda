"""WARC archives: writing with identical-payload revisits, and reading with boundary-chain verification.

Writing. Payloads of at least `min_bytes` bytes that are equal (SHA-256) get one response record, that of
the smallest page_id, and revisit records for the rest. Spark's text writer makes the files: a record ends
with an empty line after its block, which is the writer's line separator.

Reading. Archives of any size are split at will by Spark's text reader, with the version line as separator;
each piece behind a version line (WARC/1.0 or WARC/1.1) is a candidate record. Its offset in the file is a prefix
sum of piece lengths, its successor's offset follows from its header and Content-Length. A version line inside a payload
makes false candidates, so only candidates that can be reached from the start of the file count: candidates
that follow each other without a gap form runs, and pointer jumping over runs (log2 of their number rounds;
most files are one run) finds what is reachable. Records that span several pieces are put together again: the files
they are in are read once more, into a table, and their pieces are found by (file, offset), so that nothing depends
on how either reading is split.

Defined results: a null html is an empty payload; repeated rows each have a record (all rows of the smallest
page_id are responses); a null page_id is kept as null and is a response only where its group has no other
page_id; line breaks in a url are percent-encoded, a null url has no target line; an empty table gives no
records; a record cut short by the end of its file, and whatever follows a broken chain, is left out; other
columns, whatever their names, take no part.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_ROWS, few, fresh_path, written

VERSION = "WARC/1.1\r\n"
MARK = "WARC/1."  # what all version lines begin with; a piece begins with the rest of the line
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame, min_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """page_id, record_type, refers_to, record: the text of each page's WARC record, without the end."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("n"))
    large = rows.filter(F.col("n") >= min_bytes).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null")
    groups = written(groups, "payload-groups")
    # payloads with very many pages are joined apart, so that none of their pages is moved
    hot = few(groups.filter(F.col("n") >= HOT_ROWS).select("digest", F.col("refers_to").alias("_hot")))
    rows = rows.join(hot, "digest", "left")
    rest = F.when(F.col("_hot").isNull(), F.col("digest"))
    spread = F.coalesce(rest, F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))  # a row of a hot payload needs no partner
    rows = rows.withColumn("_key", spread).join(few(groups.filter(F.col("n") < HOT_ROWS).select(F.col("digest").alias("_key"), "refers_to")), "_key", "left")
    rows = rows.withColumn("refers_to", F.coalesce("_hot", "refers_to"))
    refers = F.when((F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to"))
    rows = rows.withColumn("refers_to", refers).withColumn("record_type", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    record = F.concat(
        F.lit(VERSION), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("X-Payload-Length", F.col("n").cast("string")))).otherwise(F.lit("Content-Type: text/html; charset=utf-8\r\n")),
        line("Content-Length", F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("n")).cast("string")), F.lit("\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )
    return rows.select("page_id", "record_type", "refers_to", record.alias("record"))


def write_warc(pages: DataFrame, path: str, **options) -> None:
    records(pages, **options).select("record").write.option("lineSep", END).text(path)


def _header(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1), F.lit(""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MARK).option("recursiveFileLookup", True).text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))


def _placed(pieces: DataFrame) -> DataFrame:
    """pieces (file, block, nth, bytes) with at, the offset of the version line in front; -len(MARK) for a file's first piece."""
    before = Window.partitionBy("file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("at", F.coalesce(F.sum(F.col("bytes") + len(MARK)).over(before), F.lit(0)) - len(MARK))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, head (the header), block_bytes, block_digest (SHA-256 of the block, hex) of each record."""
    m = len(MARK)
    pieces = _pieces(spark, path).withColumn("head", F.substring_index("value", END, 1))
    length = F.try_to_number(F.regexp_extract("head", r"(?im)^Content-Length:[ \t]*(\d{1,15})[ \t]*\r?$", 1), F.lit("9" * 15)).cast("long")
    is_record = F.col("value").rlike(r"^[01]\r\n") & (F.locate(END, F.col("value")) > 0)
    pieces = pieces.withColumn("length", F.when(is_record, length)).withColumn("skip", F.octet_length("head") + len(END)).withColumn("bytes", F.octet_length("value").cast("long"))
    whole = F.col("bytes") == F.col("skip") + F.col("length") + len(END)
    digest = F.when(whole, F.sha2(F.substr(F.col("value").cast("binary"), F.col("skip") + 1, F.col("length").cast("int")), 256))
    slim = written(pieces.select("file", "block", "nth", "bytes", "skip", "length", F.when(F.col("length").isNotNull(), F.col("head")).alias("head"), digest.alias("digest")), "warc-pieces")

    in_file = Window.partitionBy("file").orderBy("block", "nth")
    slim = _placed(slim).withColumn("next", F.col("at") + m + F.col("skip") + F.col("length") + len(END))
    linked = F.coalesce(F.lag("next").over(in_file) == F.col("at"), F.lit(False))
    slim = slim.withColumn("run", F.sum(F.when(linked, 0).otherwise(1)).over(in_file)).withColumn("size", F.sum(F.col("bytes") + m).over(Window.partitionBy("file")) - m)
    slim = written(slim, "warc-candidates")

    candidates = slim.filter("at >= 0 and length is not null")
    runs = candidates.groupBy("file", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max_by("next", "at").alias("next"))
    reached = runs.filter("first = 0").select("file", "run", F.lit(0).cast("long").alias("entry"))
    most = runs.groupBy("file").count().agg(F.max("count").alias("n")).first()["n"] or 0
    if most > 1:
        entries = candidates.select("file", F.col("at").alias("next"), F.col("run").alias("to"))
        jumps = written(runs.join(entries, ["file", "next"]).select("file", "run", "to", F.col("next").alias("entry")), "warc-jumps")
        for _ in range(ceil(log2(most)) + 1):
            further = reached.select("file", "run").join(jumps, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
            reached = written(reached.unionByName(further).groupBy("file", "run").agg(F.min("entry").alias("entry")), "warc-reached")
            then = jumps.select("file", F.col("run").alias("to"), F.col("to").alias("to2"), F.col("entry").alias("entry2"))
            jumps = written(jumps.join(then, ["file", "to"]).select("file", "run", F.col("to2").alias("to"), F.col("entry2").alias("entry")), "warc-jumps")
    real = candidates.join(reached, ["file", "run"]).filter("at >= entry and next <= size")
    single = real.filter("digest is not null").select("file", F.col("at").alias("offset"), "head", F.col("length").alias("block_bytes"), F.col("digest").alias("block_digest"))
    split = written(real.filter("digest is null").select("file", "at", "skip", "length", "head"), "warc-split")
    if split.isEmpty():
        return single

    # the pieces of records that hold version lines: from a record's piece to the one before its successor
    owner = F.last(F.when(F.col("real"), F.struct("at", "skip", "length", "head", "digest")), ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, 0))
    marked = slim.join(real.select("file", "at", F.lit(True).alias("real")), ["file", "at"], "left").withColumn("owner", owner)
    parts = marked.filter("owner is not null and owner.digest is null").select("file", "at", F.col("owner.at").alias("offset"), F.col("owner.skip").alias("skip"), F.col("owner.length").alias("length"), F.col("owner.head").alias("head"))
    parts = written(parts, "warc-parts")
    again = _pieces(spark, path).join(few(split.select("file").distinct()), "file", "left_semi")
    again = written(again.withColumn("bytes", F.octet_length("value").cast("long")), "warc-again")
    found = _placed(again.drop("value")).join(few(parts), ["file", "at"]).join(again.select("file", "block", "nth", "value"), ["file", "block", "nth"])
    together = found.groupBy("file", "offset").agg(F.first("skip").alias("skip"), F.first("length").alias("length"), F.first("head").alias("head"), F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
    block = F.substr(F.array_join(F.transform("parts", lambda p: p["value"]), MARK).cast("binary"), F.col("skip") + 1, F.col("length").cast("int"))
    return single.unionByName(together.select("file", "offset", "head", F.col("length").alias("block_bytes"), F.sha2(block, 256).alias("block_digest")))


def page_records(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records that write_warc wrote."""
    head = F.col("head")
    page = lambda name: F.try_to_number(F.regexp_extract(_header(head, name), r"<urn:page:(-?\d+)>", 1), F.lit("S" + "9" * 19)).cast("long")
    revisit = _header(head, "WARC-Type") == "revisit"
    return found.select(
        page("WARC-Record-ID").alias("page_id"), F.when(revisit, _header(head, "X-Payload-Length").cast("long")).otherwise(F.col("block_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_extract(_header(head, "WARC-Payload-Digest"), r"sha256:([0-9a-f]{64})", 1)).otherwise(F.col("block_digest")).alias("payload_digest"),
        _header(head, "WARC-Type").alias("record_type"), F.when(revisit, page("WARC-Refers-To")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages' archives and returns what reading them gives."""
    path = path or fresh_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return page_records(read_warc(pages.sparkSession, path))


ORACLE = """
WITH rows AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM rows
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN first END AS refers_to
FROM firsts"""
