"""Sources with fixed schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import file_kind

SPAN = "struct<start:int,end:int,line:int,value:string,score:double,type:string>"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines give none."""
    return spark.read.schema(schema).json(path)


def span_docs(spark: SparkSession, path: str) -> DataFrame:
    """id, spans; of rows with one id the last in file order stays."""
    rows = spark.read.schema(f"id string, spans array<{SPAN}>, invalid_bio_transitions int").json(path)
    rows = rows.filter("id is not null").select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("place"))
    return rows.groupBy("id").agg(F.max_by(F.struct(F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"), "invalid_bio_transitions"), "place").alias("x")).select("id", "x.*")


def flat_spans(rows: DataFrame) -> DataFrame:
    """doc_id, start, end, line, value, score, type of (id, spans) rows."""
    return rows.select(F.col("id").alias("doc_id"), F.inline("spans"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, text string").json(path)


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"id string, file string, repo string, commit string, lang string, file_has_secrets boolean, spans array<{SPAN}>, lookalike_spans array<struct<start:int,end:int,line:int,category:string>>").json(path)


def normalized_gold(rows: DataFrame) -> DataFrame:
    """file, has, lines (sorted, distinct, without nulls), spans."""
    spans = F.coalesce("spans", F.array().cast(rows.schema["spans"].dataType))
    lines = F.array_sort(F.array_distinct(F.filter(F.transform(spans, lambda s: s["line"]), lambda x: x.isNotNull())))
    return rows.select("file", (F.coalesce("file_has_secrets", F.lit(False)) | (F.size(spans) > 0)).alias("has"), lines.alias("lines"), spans.alias("spans"))


def source_tree(spark: SparkSession, root: str, max_bytes: int = P.MAX_FILE_BYTES) -> DataFrame:
    """path, kind, text of source files: known extension, not empty, not large, in no skipped folder. Folders and
    sizes are filtered on file metadata; invalid UTF-8 gives replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    skipped = "|".join(f"{x}".replace(".", r"\.") for x in P.SKIPPED_FOLDERS)
    kept = files.filter((F.col("length") > 0) & (F.col("length") <= max_bytes) & ~F.col("path").rlike(rf"/({skipped})/"))
    kept = kept.withColumn("kind", file_kind(F.col("path"))).filter("kind is not null")
    return kept.select("path", "kind", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """packet_id, label, note; the label column is the one whose name starts with label; short rows are filled up."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    name = next(c for c in rows.columns if c.strip().lower().startswith("label"))
    note = F.col("note") if "note" in rows.columns else F.lit(None).cast("string")
    return rows.select("packet_id", F.col(name).alias("label"), note.alias("note"))


def vault(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A file of two kinds of rows as two tables: provenance and packet_map."""
    rows = spark.read.schema("id string, repo string, commit string, path string, detector string, family string, packet_map struct<packet_id:string,candidate_id:string,is_dup:boolean>").json(path)
    return rows.filter("packet_map is null").drop("packet_map"), rows.filter("packet_map is not null").select("packet_map.*")


def resumed(docs: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """docs that a run before has not written yet."""
    return docs.join(done.select(key).distinct(), key, "left_anti")


def in_first_seen_order(rows: DataFrame, key: str, position: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(position).alias(position)).orderBy(position)


def sliced(docs: DataFrame, order: str, start: int, limit: int) -> DataFrame:
    nth = F.row_number().over(Window.orderBy(order)) - 1
    return docs.withColumn("_n", nth).filter((F.col("_n") >= start) & (F.col("_n") < start + limit)).drop("_n")


# ---- captured reports of other scanners: one row, column `report`, or a text file of it


def _base(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def gitleaks_report(reports: DataFrame) -> DataFrame:
    """file, start_line, start_col, end_line, end_col, rule, value (null in redacted reports)."""
    item = "struct<File:string,StartLine:int,StartColumn:int,EndLine:int,EndColumn:int,RuleID:string,Secret:string>"
    rows = reports.select(F.inline(F.from_json("report", f"array<{item}>")))
    secret = F.when(F.col("Secret").isin("REDACTED", ""), None).otherwise(F.col("Secret"))
    return rows.select(_base(F.col("File")).alias("file"), F.col("StartLine").alias("start_line"), F.col("StartColumn").alias("start_col"), F.col("EndLine").alias("end_line"), F.col("EndColumn").alias("end_col"), F.col("RuleID").alias("rule"), secret.alias("value"))


def detect_secrets_report(reports: DataFrame) -> DataFrame:
    """file, line, rule."""
    rows = reports.select(F.from_json("report", "results map<string,array<struct<type:string,line_number:int>>>").alias("r")).select(F.explode("r.results").alias("file", "found"))
    return rows.select(_base(F.col("file")).alias("file"), F.inline("found")).select("file", F.col("line_number").alias("line"), F.col("type").alias("rule"))


def trufflehog_report(lines: DataFrame) -> DataFrame:
    """file, line (from 1; -1 if unknown), rule, out of JSON lines (column report)."""
    get = lambda path: F.get_json_object("report", path)
    rows = lines.select(get("$.SourceMetadata.Data.Filesystem.file").alias("file"), F.coalesce(get("$.SourceMetadata.Data.Filesystem.line").cast("int") + 1, F.lit(-1)).alias("line"), get("$.DetectorName").alias("rule"))
    return rows.filter("file is not null").withColumn("file", _base(F.col("file")))


def semgrep_report(reports: DataFrame) -> DataFrame:
    """file, line, rule."""
    rows = reports.select(F.from_json("report", "results array<struct<path:string,start:struct<line:int>,check_id:string>>").alias("r")).select(F.inline("r.results"))
    return rows.select(_base(F.col("path")).alias("file"), F.col("start.line").alias("line"), F.col("check_id").alias("rule"))


def report_errors(reports: DataFrame) -> DataFrame:
    return reports.select(F.coalesce(F.json_array_length(F.get_json_object("report", "$.errors")), F.lit(0)).alias("errors"))


#: Registered scanners: name -> function of a documents frame that gives (doc_id, start, end, detector, family).
SCANNERS: dict = {}


def register_scanner(name: str, fn) -> None:
    SCANNERS[name] = fn


def run_scanners(docs: DataFrame) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """The union of all registered scanners' spans, and (name, status). A scanner that can't plan is `error`, not empty."""
    out, status = None, []
    for name, fn in SCANNERS.items():
        try:
            spans = fn(docs).select("doc_id", "start", "end", "detector", "family", F.lit(name).alias("tool"))
        except Exception as e:  # noqa: BLE001  any scanner may fail in its own way
            status.append((name, f"error: {type(e).__name__}"))
            continue
        out = spans if out is None else out.unionByName(spans)
        status.append((name, "ok"))
    return out, status


def refuse_unredacted(help_text: str) -> None:
    """Raises unless a scanner's help says that it can redact values."""
    if "--redact" not in help_text:
        raise RuntimeError("the scanner can't redact values; it is left out")
