"""The registered queries, each over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import decode, detect, evaluate, inject, integrity, sample, sanitize, spans
from ..session import scratch_path
from ..sources import sinks
from ..streaming import mask as streaming
from . import derived as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TAUS = [k / 20 for k in range(21)]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: A setting of the session, off unless it is set: for tables with fewer row groups than there are cores.
DEAL = "spark.spanloom.dealTexts"


def read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table, searched where it lies, whatever its size. Where the session asks for it (DEAL), documents are dealt over
    all cores by doc_id first; the rows are the same."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name != "documents":
        return df
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")  # see detect.with_external
    return df.repartition(spark.sparkContext.defaultParallelism, "doc_id") if spark.conf.get(DEAL, "false") == "true" else df


# ---- SQL fragments


def sql_matches(name: str, pattern: str, table: str = "documents", key: str = "doc_id") -> str:
    whole = f"(?s)(.*?)({pattern})".replace("'", "''")
    return f"""{name}_r AS (SELECT {key} AS doc_id, text, regexp_extract_all(text, '{whole}', 1) AS g, regexp_extract_all(text, '{whole}', 2) AS m FROM {table}),
{name}_i AS (SELECT doc_id, text, g, m, unnest(range(1, len(m) + 1)) AS i FROM {name}_r),
{name}_p AS (SELECT doc_id, text, m[i] AS value, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS s FROM {name}_i),
{name} AS (SELECT doc_id, s AS "start", CAST(s + length(value) AS INTEGER) AS "end", CAST(length(substr(text, 1, s)) - length(replace(substr(text, 1, s), chr(10), '')) + 1 AS INTEGER) AS line, value FROM {name}_p)"""


TOK = sql_matches("tok", P.TOKEN)
TH = TOK + """, th AS (SELECT *, (doc_id * 7919 + "start") % 100 AS h, ((doc_id * 7919 + "start") % 1000) / 1000.0::DOUBLE AS score FROM tok)"""
PRED = TH + """, pred AS (
SELECT doc_id, "start", CASE WHEN h BETWEEN 10 AND 19 THEN "end" + 1 ELSE "end" END AS "end", CASE WHEN h BETWEEN 20 AND 24 THEN line + 1 ELSE line END AS line, score FROM th WHERE h >= 10
UNION ALL SELECT doc_id, "start", "end", line, score FROM th WHERE h BETWEEN 25 AND 29
UNION ALL SELECT doc_id, "end" + 2, "end" + 10, line, score FROM th WHERE h BETWEEN 30 AND 32)"""
ENTROPY = "CASE WHEN length(value) = 0 THEN 0.0::DOUBLE ELSE list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: -((length(value) - length(replace(value, c, ''))) / length(value)::DOUBLE) * log2((length(value) - length(replace(value, c, ''))) / length(value)::DOUBLE))) END"
SHAPE = f"""CASE WHEN regexp_matches(value, '{P.VENDOR_PREFIX}') THEN 'vendor' WHEN regexp_full_match(value, '[0-9a-f]+') THEN 'hexlo' WHEN regexp_full_match(value, '[0-9A-F]+') THEN 'hexup'
WHEN regexp_full_match(value, '[0-9]+') THEN 'digits' WHEN regexp_full_match(value, '[A-Za-z0-9+/=_.-]+') THEN 'b64ish' ELSE 'mixed' END || ':' || CASE WHEN length(value) < 20 THEN 's' WHEN length(value) < 40 THEN 'm' ELSE 'l' END || ':' ||
CASE WHEN {ENTROPY} < 3.0 THEN 'lo' WHEN {ENTROPY} < 4.2 THEN 'md' ELSE 'hi' END"""
_kinds = [sql_matches(f"k{i}", p) for i, (_, p) in enumerate(P.LOOKALIKES)]
_union = " UNION ALL ".join(f"SELECT *, {i} AS pri, '{c}' AS category FROM k{i}" for i, (c, _) in enumerate(P.LOOKALIKES))
_hexes = ", ".join(f"'{c}'" for c in P.HEX_CATEGORIES)
LOOK = ", ".join(_kinds) + f""", every AS ({_union}), good AS (SELECT * FROM every WHERE category NOT IN ({_hexes}) OR (len(list_distinct(string_split(value, ''))) >= 6 AND {ENTROPY} >= 3.0)),
look AS (SELECT doc_id, "start", "end", line, category, "end" - "start" AS value_len FROM good a WHERE NOT EXISTS (SELECT 1 FROM good b WHERE b.doc_id = a.doc_id AND b.pri < a.pri AND b."start" < a."end" AND a."start" < b."end"))"""


def sql_ratio(a: str, b: str, digits: int = 4) -> str:
    return f"round(CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0::DOUBLE END, {digits})"


def sql_prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    return f"{sql_ratio(tp, f'{tp} + {fp}')} AS precision, {sql_ratio(tp, f'{tp} + {fn}')} AS recall, {sql_ratio(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1"


def sql_counts(gold: str, pred: str, cols: str, by: str = "") -> str:
    """A CTE body: by, tp, fp, fn with multiplicity."""
    group = f" GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}CAST(coalesce(sum(least(g, p)), 0) AS BIGINT) AS tp, CAST(coalesce(sum(p - least(g, p)), 0) AS BIGINT) AS fp, CAST(coalesce(sum(g - least(g, p)), 0) AS BIGINT) AS fn
FROM (SELECT {cols}, sum(g) AS g, sum(p) AS p FROM (SELECT {cols}, 1 AS g, 0 AS p FROM {gold} UNION ALL SELECT {cols}, 0, 1 FROM {pred}) GROUP BY {cols}){group}"""


def planted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with planted synthetic secrets, as a table of its own: many plans start from it."""
    planted = inject.inject(read(spark, sf_dir)).select("doc_id", "text")
    path = scratch_path(spark, "planted")
    planted.write.parquet(path)
    return spark.read.schema(planted.schema).parquet(path)


# ---- finding spans


@query(f"""WITH {sql_matches('a', P.LOOKALIKES[7][1])}, {sql_matches('b', P.LOOKALIKES[3][1])}, {TOK}, every AS (SELECT doc_id, 'ipv4' AS category, value FROM a UNION ALL SELECT doc_id, 'sha1', value FROM b UNION ALL SELECT doc_id, 'token', value FROM tok)
SELECT source, category, count(*) AS n, CAST(sum(length(value)) AS BIGINT) AS n_chars, max(length(value)) AS longest FROM every JOIN documents USING (doc_id) GROUP BY source, category""")
def span_counts(spark, sf_dir):
    """Spans of three kinds by source: the flagship query, one pass over the texts."""
    docs = read(spark, sf_dir)
    kinds = (("ipv4", P.LOOKALIKES[7][1]), ("sha1", P.LOOKALIKES[3][1]), ("token", P.TOKEN))
    tagged = lambda name, p: F.transform(T.matches(F.col("text"), p), lambda h: F.struct(h["start"].alias("start"), F.lit(name).alias("category"), F.length(h["value"]).alias("len")))
    found = F.concat(*[tagged(*k) for k in kinds])
    rows = spans.placed(docs, found, ("source",))
    return rows.groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("n_chars"), F.max("len").cast("long").alias("longest"))


@query(f"WITH {TOK} SELECT * FROM tok")
def token_spans(spark, sf_dir):
    return D.tokens(read(spark, sf_dir))


@query(f"WITH {sql_matches('tok', P.LOOKALIKES[7][1])} SELECT * FROM tok")
def ipv4_spans(spark, sf_dir):
    return spans.find(read(spark, sf_dir), P.LOOKALIKES[7][1]).drop("before")


@query(f"WITH {sql_matches('tok', P.LOOKALIKES[3][1])} SELECT * FROM tok")
def sha1_spans(spark, sf_dir):
    return spans.find(read(spark, sf_dir), P.LOOKALIKES[3][1]).drop("before")


@query(f"WITH {LOOK} SELECT * FROM look")
def lookalike_spans(spark, sf_dir):
    return detect.lookalikes(read(spark, sf_dir))


@query(f"WITH {LOOK} SELECT category, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM look GROUP BY category")
def lookalike_by_category(spark, sf_dir):
    return detect.lookalikes(read(spark, sf_dir)).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


_quota = " ".join(f"WHEN '{c}' THEN {n}" for c, n in P.QUOTAS.items())


@query(f"""WITH {LOOK}, ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id, "start") AS nth FROM look)
SELECT doc_id, "start", category, nth <= CASE category {_quota} END AS in_quota FROM ranked""")
def lookalike_quota(spark, sf_dir):
    return detect.in_quota(detect.lookalikes(read(spark, sf_dir))).select("doc_id", "start", "category", "in_quota")


@query(f"WITH {TOK} SELECT line, count(*) AS n FROM tok GROUP BY line")
def line_numbers(spark, sf_dir):
    return D.tokens(read(spark, sf_dir)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TOK} SELECT value, round({ENTROPY}, 6) AS entropy, count(*) AS n FROM tok GROUP BY value")
def entropy_tokens(spark, sf_dir):
    per = D.tokens(read(spark, sf_dir)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return per.select("value", F.round(T.entropy(F.col("value")), 6).alias("entropy"), "n")


@query(f"WITH {TOK} SELECT {SHAPE} AS shape, count(*) AS n FROM tok GROUP BY 1")
def shape_buckets(spark, sf_dir):
    return D.tokens(read(spark, sf_dir)).groupBy(T.shape(F.col("value")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def sql_value_class(v: str = "value") -> str:
    s = f"""trim(trim(trim({v}), '''"`'))"""
    holders = " OR ".join("contains(lower({}), '{}')".format(s, p) for p in P.PLACEHOLDER_PARTS)
    rest = " ".join(f"WHEN regexp_matches({s}, '{p}') THEN '{n}'" for n, p in P.VALUE_CLASSES)
    return f"""CASE WHEN {s} = '' THEN 'empty' WHEN {holders} THEN 'placeholder/example/redacted' WHEN starts_with({s}, '-----BEGIN') OR (contains({s}, 'BEGIN') AND (contains({s}, 'KEY') OR contains({s}, 'CERTIFICATE'))) THEN 'private_key/cert_material' {rest}
WHEN regexp_matches({s}, '{P.HEX_BLOB}') AND length({s}) IN {P.HASH_LENGTHS} THEN 'hex_hash/checksum(len' || length({s}) || ')' WHEN regexp_matches({s}, '{P.ENV_NAME}') THEN 'env_var_name(no_value)' WHEN regexp_matches({s}, '{P.NUMERIC_ID}') THEN 'numeric_id'
WHEN regexp_matches({s}, '{P.BASE64_BLOB}') AND length({s}) >= 24 THEN 'base64/hex_blob' WHEN length({s}) >= 16 THEN 'high_entropy_other' ELSE 'short/other' END"""


@query(f"WITH {TOK} SELECT {sql_value_class()} AS class, count(*) AS n FROM tok GROUP BY 1")
def value_classes(spark, sf_dir):
    return D.tokens(read(spark, sf_dir)).groupBy(T.value_class(F.col("value")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TOK}, bad AS (SELECT doc_id FROM tok GROUP BY doc_id), n AS (SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM bad) GROUP BY source) SELECT * FROM n""")
def clean_hosts(spark, sf_dir):
    """Documents without any finding, by source."""
    docs = read(spark, sf_dir)
    return docs.select("doc_id", "source").join(D.tokens(docs).select("doc_id").distinct(), "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# ---- evaluating


@query(f"""WITH {PRED}, c AS ({sql_counts('tok', 'pred', 'doc_id, "start", "end"')}) SELECT *, {sql_prf()} FROM c""")
def exact_match_prf(spark, sf_dir):
    gold = D.tokens(read(spark, sf_dir))
    return evaluate.scored(gold, D.predictions(gold))


@query(f"""WITH {PRED}, c AS ({sql_counts('tok', 'pred', 'doc_id, "start", "end", line')}) SELECT *, {sql_prf()} FROM c""")
def strict_match_prf(spark, sf_dir):
    gold = D.tokens(read(spark, sf_dir))
    return evaluate.scored(gold, D.predictions(gold), evaluate.STRICT)


_lang_cte = ", g AS (SELECT tok.*, lang FROM tok JOIN documents USING (doc_id)), q AS (SELECT pred.*, lang FROM pred JOIN documents USING (doc_id))"


@query(f"""WITH {PRED}{_lang_cte}, c AS ({sql_counts('g', 'q', 'doc_id, "start", "end", line, lang', 'lang')}), r AS (SELECT lang, tp, fp, fn FROM c UNION ALL SELECT NULL, CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM c)
SELECT *, {sql_prf()} FROM r""")
def prf_by_lang(spark, sf_dir):
    """By language, and overall (lang null)."""
    docs = read(spark, sf_dir)
    gold = D.tokens(docs)
    lang = docs.select("doc_id", "lang")
    by = evaluate.counts(gold.join(lang, "doc_id"), D.predictions(gold).join(lang, "doc_id"), evaluate.STRICT, ("lang",))
    t = by.rollup("lang").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return t.select("lang", "tp", "fp", "fn", *evaluate.prf(F.col("tp"), F.col("fp"), F.col("fn")))


_over = 'a.doc_id = b.doc_id AND a."start" < b."end" AND b."start" < a."end"'


@query(f"""WITH {PRED}, c AS (SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM pred b WHERE {_over})) AS hit, count(*) AS total FROM tok a) SELECT hit, total, {sql_ratio('hit', 'total')} AS recall FROM c""")
def overlap_recall(spark, sf_dir):
    gold = D.tokens(read(spark, sf_dir))
    return evaluate.overlap_recall(gold, D.predictions(gold))


@query()
def greedy_overlap(spark, sf_dir):
    """One-to-one matching by largest overlap: an ordered fold, which SQL can't express; tests hold it against a loop."""
    gold = D.tokens(read(spark, sf_dir))
    return evaluate.greedy_overlap(gold, D.predictions(gold))


@query(f"""WITH {PRED}, f AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM tok) AS g, doc_id IN (SELECT doc_id FROM pred) AS p FROM documents),
c AS (SELECT count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE p AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn, count(*) FILTER (WHERE NOT g AND NOT p) AS tn FROM f) SELECT *, {sql_prf()} FROM c""")
def file_level_confusion(spark, sf_dir):
    docs = read(spark, sf_dir)
    gold = D.tokens(docs)
    return evaluate.file_confusion(docs, gold, D.predictions(gold))


@query(f"WITH {PRED} SELECT (SELECT count(*) FROM pred) AS n_pred, (SELECT count(*) FROM tok) AS n_gold, round((SELECT count(*) FROM pred)::DOUBLE / nullif((SELECT count(*) FROM tok), 0), 4) AS inflation")
def inflation_ratio(spark, sf_dir):
    gold = D.tokens(read(spark, sf_dir))
    both = gold.select(F.lit(0).alias("p")).unionByName(D.predictions(gold).select(F.lit(1).alias("p")))
    t = both.agg(F.count_if(F.col("p") == 1).alias("n_pred"), F.count_if(F.col("p") == 0).alias("n_gold"))
    return t.select("n_pred", "n_gold", F.round(F.col("n_pred") / F.nullif(F.col("n_gold"), F.lit(0)), 4).alias("inflation"))


@query(f"""WITH {PRED}, n AS (SELECT (SELECT count(*) FROM pred b WHERE {_over}) AS n_overlaps FROM tok a) SELECT n_overlaps, count(*) AS n_gold FROM n GROUP BY n_overlaps""")
def fragmentation_hist(spark, sf_dir):
    gold = D.tokens(read(spark, sf_dir))
    return evaluate.fragmentation(gold, D.predictions(gold))


@query(f"""WITH {PRED}, e AS ({sql_counts('tok', 'pred', 'doc_id, "start", "end"')}), s AS ({sql_counts('tok', 'pred', 'doc_id, "start", "end", line')}) SELECT e.tp AS exact, s.tp AS line_correct, {sql_ratio('s.tp', 'e.tp')} AS line_accuracy FROM e, s""")
def line_accuracy(spark, sf_dir):
    gold = D.tokens(read(spark, sf_dir))
    pred = D.predictions(gold)
    e, s = evaluate.counts(gold, pred).select(F.col("tp").alias("exact")), evaluate.counts(gold, pred, evaluate.STRICT).select(F.col("tp").alias("line_correct"))
    return e.join(s).select("exact", "line_correct", evaluate.ratio(F.col("line_correct"), F.col("exact")).alias("line_accuracy"))


@query(f"""WITH {PRED}, {LOOK}, m AS (SELECT category, EXISTS (SELECT 1 FROM pred b WHERE {_over}) AS hit FROM look a), c AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE hit) AS flagged FROM m GROUP BY ROLLUP (category))
SELECT *, round(flagged::DOUBLE / greatest(1, n), 4) AS rate FROM c""")
def category_fp_rate(spark, sf_dir):
    docs = read(spark, sf_dir)
    return evaluate.false_alarms(detect.lookalikes(docs), D.predictions(D.tokens(docs)))


@query(f"""WITH {PRED}, {LOOK} SELECT doc_id, count(*) AS n FROM pred a WHERE NOT EXISTS (SELECT 1 FROM look b WHERE {_over}) GROUP BY doc_id""")
def off_target_fp(spark, sf_dir):
    docs = read(spark, sf_dir)
    off = spans.overlapping(D.predictions(D.tokens(docs)), detect.lookalikes(docs), how="left_anti")
    return off.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


_label = "CASE WHEN (doc_id * 31 + \"start\") % 10 < 6 THEN 'POLICY_POSITIVE' WHEN (doc_id * 31 + \"start\") % 10 < 9 THEN 'POLICY_NEGATIVE' ELSE 'AMBIGUOUS_EXCLUDED' END"
_near = lambda label: f"EXISTS (SELECT 1 FROM lab b WHERE b.label = '{label}' AND {_over})"


@query(f"""WITH {PRED}, lab AS (SELECT *, {_label} AS label FROM tok), gold AS (SELECT * FROM lab WHERE label = 'POLICY_POSITIVE'), c AS ({sql_counts('gold', 'pred', 'doc_id, "start", "end", line')}),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, "start", "end", line ORDER BY score) AS nth FROM pred), gn AS (SELECT doc_id, "start", "end", line, count(*) AS k FROM gold GROUP BY ALL),
wrong AS (SELECT n.* FROM n LEFT JOIN gn ON n.doc_id = gn.doc_id AND n."start" = gn."start" AND n."end" = gn."end" AND n.line = gn.line WHERE nth > coalesce(k, 0)),
clear AS (SELECT * FROM wrong a WHERE NOT {_near('AMBIGUOUS_EXCLUDED')}),
t AS (SELECT c.tp, (SELECT count(*) FROM clear) AS fp, c.fn, (SELECT count(*) FROM clear a WHERE {_near('POLICY_NEGATIVE')}) AS fp_negative, (SELECT count(*) FROM clear a WHERE NOT EXISTS (SELECT 1 FROM lab b WHERE {_over})) AS fp_off FROM c)
SELECT *, {sql_prf()} FROM t""")
def adjudicated_score(spark, sf_dir):
    tok = D.tokens(read(spark, sf_dir))
    return evaluate.adjudicated(D.labelled(tok), D.predictions(tok))


_sweep = f"""grid AS (SELECT unnest(range(21)) / 20.0::DOUBLE AS tau), g AS (SELECT DISTINCT doc_id, "start", "end", line FROM tok),
gb AS (SELECT (SELECT max(score) FROM pred b WHERE b.doc_id = a.doc_id AND b."start" = a."start" AND b."end" = a."end" AND b.line = a.line) AS best FROM g a),
lb AS (SELECT (SELECT max(score) FROM pred b WHERE {_over}) AS best FROM look a),
c AS (SELECT tau, (SELECT count(*) FROM gb WHERE best >= tau) AS tp, (SELECT count(*) FROM gb) AS n_gold, (SELECT count(*) FROM lb WHERE best >= tau) AS flagged, (SELECT count(*) FROM lb) AS n_lookalikes FROM grid),
curve AS (SELECT *, {sql_ratio('tp', 'n_gold')} AS recall, {sql_ratio('flagged', 'n_lookalikes')} AS fp_rate FROM c)"""


def _curve(spark, sf_dir):
    docs = read(spark, sf_dir)
    tok = D.tokens(docs)
    return evaluate.sweep(tok, D.predictions(tok), detect.lookalikes(docs), TAUS)


@query(f"WITH {PRED}, {LOOK}, {_sweep} SELECT * FROM curve")
def tau_sweep(spark, sf_dir):
    return _curve(spark, sf_dir)


@query(f"WITH {PRED}, {LOOK}, {_sweep} SELECT tau, recall, fp_rate FROM curve WHERE fp_rate <= 0.5 ORDER BY recall DESC, tau LIMIT 1")
def recall_at_fp(spark, sf_dir):
    return evaluate.best_recall(_curve(spark, sf_dir), 0.5)


@query(f"WITH {PRED}, {LOOK}, {_sweep} SELECT tau, recall, fp_rate FROM curve WHERE recall >= 0.5 ORDER BY fp_rate, tau LIMIT 1")
def fp_at_recall(spark, sf_dir):
    return evaluate.least_alarms(_curve(spark, sf_dir), 0.5)


@query(f"""WITH {PRED}, i AS (SELECT EXISTS (SELECT 1 FROM pred b WHERE b.doc_id = a.doc_id AND b."start" = a."start" AND b."end" = a."end" AND b.line = a.line) AS x, (doc_id * 17 + "start") % 3 <> 0 AS y FROM tok a)
SELECT count(*) FILTER (WHERE x AND y) AS "both", count(*) FILTER (WHERE x AND NOT y) AS only_a, count(*) FILTER (WHERE y AND NOT x) AS only_b, count(*) FILTER (WHERE NOT x AND NOT y) AS neither FROM i""")
def mcnemar_counts(spark, sf_dir):
    """Discordant counts of two taggers on the same spans; evaluate.mcnemar_p gives their p-value."""
    tok = D.tokens(read(spark, sf_dir))
    hit = D.predictions(tok).select(*evaluate.STRICT).distinct().withColumn("a", F.lit(True))
    items = tok.join(hit, list(evaluate.STRICT), "left").select(F.coalesce("a", F.lit(False)).alias("a"), (F.pmod(F.col("doc_id") * 17 + F.col("start"), F.lit(3)) != 0).alias("b"))
    return evaluate.discordant(items)


_tools = """tools AS (SELECT * FROM (VALUES ('absent', 'not_installed'), ('exact', 'ok'), ('noisy', 'ok')) v(tool, status)), gold AS (SELECT doc_id AS file, doc_id IN (SELECT doc_id FROM tok) AS has FROM documents),
det AS (SELECT 'exact' AS tool, doc_id AS file, line FROM tok UNION ALL SELECT 'noisy', doc_id, CASE WHEN h < 50 THEN -1 ELSE line + 1 END FROM th WHERE h >= 20 UNION ALL SELECT 'noisy', doc_id, 1 FROM documents WHERE doc_id % 10 = 0),
flags AS (SELECT DISTINCT tool, file, has FROM det JOIN gold USING (file)), lines AS (SELECT DISTINCT doc_id AS file, line FROM tok), dl AS (SELECT DISTINCT tool, file, line FROM det WHERE line > 0),
hits AS (SELECT dl.tool, lines.file IS NOT NULL AS hit FROM dl LEFT JOIN lines ON dl.file = lines.file AND dl.line = lines.line)"""


def _tool_scores(spark, sf_dir):
    """Gold and the findings of two tools come out of one pass over the texts, as one long table."""
    h = F.pmod(F.col("doc_id") * 7919 + F.col("x.start"), F.lit(100))
    row = lambda tool, line, has: F.struct(F.lit(tool).cast("string").alias("tool"), line.cast("int").alias("line"), has.cast("boolean").alias("has"))
    none, line = F.lit(None), F.col("x.line")
    seen = read(spark, sf_dir).select("doc_id", F.posexplode_outer(T.matches(F.col("text"), P.TOKEN)).alias("pos", "x"))
    gold = F.array(row(None, line, F.col("x").isNotNull()))
    exact = F.when(F.col("x").isNotNull(), F.array(row("exact", line, none)))
    noisy = F.when(h >= 20, F.array(row("noisy", F.when(h < 50, F.lit(-1)).otherwise(line + 1), none)))
    tenth = F.when((F.col("doc_id") % 10 == 0) & (F.coalesce("pos", F.lit(0)) == 0), F.array(row("noisy", F.lit(1), none)))
    empty = F.array().cast("array<struct<tool:string,line:int,has:boolean>>")
    rows = seen.select(F.col("doc_id").alias("file"), F.inline(F.concat(gold, *[F.coalesce(c, empty) for c in (exact, noisy, tenth)])))
    one = lambda tool, status: F.struct(F.lit(tool).alias("tool"), F.lit(status).alias("status"))
    tools = spark.range(1).select(F.inline(F.array(one("absent", "not_installed"), one("exact", "ok"), one("noisy", "ok"))))
    return evaluate.tool_scores(rows, tools)


@query(f"""WITH {TH}, {_tools}, n AS (SELECT count(*) FILTER (WHERE has) AS n_pos FROM gold), c AS (SELECT tool, count(*) FILTER (WHERE has) AS tp, count(*) FILTER (WHERE NOT has) AS fp FROM flags GROUP BY tool)
SELECT tool, CASE WHEN status = 'ok' THEN 'ok' ELSE 'NOT RUN' END AS status, CASE WHEN status = 'ok' THEN coalesce(tp, 0) END AS file_tp, CASE WHEN status = 'ok' THEN coalesce(fp, 0) END AS file_fp, CASE WHEN status = 'ok' THEN n_pos - coalesce(tp, 0) END AS file_fn, CASE WHEN status = 'ok' THEN {sql_ratio('coalesce(tp, 0)', 'coalesce(tp, 0) + coalesce(fp, 0)', 3)} END AS file_p, CASE WHEN status = 'ok' THEN {sql_ratio('coalesce(tp, 0)', 'n_pos', 3)} END AS file_r, CASE WHEN status = 'ok' THEN {sql_ratio('2 * coalesce(tp, 0)', 'coalesce(tp, 0) + coalesce(fp, 0) + n_pos', 3)} END AS file_f1 FROM tools LEFT JOIN c USING (tool), n""")
def tool_file_prf(spark, sf_dir):
    return _tool_scores(spark, sf_dir).select("tool", "status", "file_tp", "file_fp", "file_fn", "file_p", "file_r", "file_f1")


@query(f"""WITH {TH}, {_tools}, n AS (SELECT count(*) AS n_lines FROM lines), c AS (SELECT tool, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE NOT hit) AS fp FROM hits GROUP BY tool)
SELECT tool, CASE WHEN status = 'ok' THEN coalesce(tp, 0) END AS line_tp, CASE WHEN status = 'ok' THEN coalesce(fp, 0) END AS line_fp, CASE WHEN status = 'ok' THEN n_lines - coalesce(tp, 0) END AS line_fn, CASE WHEN status = 'ok' THEN {sql_ratio('coalesce(tp, 0)', 'coalesce(tp, 0) + coalesce(fp, 0)', 3)} END AS line_p, CASE WHEN status = 'ok' THEN {sql_ratio('coalesce(tp, 0)', 'n_lines', 3)} END AS line_r, CASE WHEN status = 'ok' THEN {sql_ratio('2 * coalesce(tp, 0)', 'coalesce(tp, 0) + coalesce(fp, 0) + n_lines', 3)} END AS line_f1 FROM tools LEFT JOIN c USING (tool), n""")
def tool_line_prf(spark, sf_dir):
    return _tool_scores(spark, sf_dir).select("tool", "line_tp", "line_fp", "line_fn", "line_p", "line_r", "line_f1")


@query(f"""WITH {TH}, {_tools}, d AS (SELECT file, list_sort(list_distinct(list(line))) AS l FROM det WHERE tool = 'noisy' GROUP BY file) SELECT file, CAST(len(list_filter(l, lambda x: x > 0)) AS INTEGER) AS n_lines, TRUE AS flagged FROM d""")
def detection_rows(spark, sf_dir):
    """What a detection file holds for each flagged document: unknown lines go, the flag stays."""
    docs = read(spark, sf_dir)
    tok = D.tokens(docs)
    h = F.pmod(F.col("doc_id") * 7919 + F.col("start"), F.lit(100))
    rows = tok.filter(h >= 20).select(F.col("doc_id").alias("file"), F.when(h < 50, -1).otherwise(F.col("line") + 1).alias("line")).unionByName(docs.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("file"), F.lit(1).alias("line")))
    return sinks.detections(rows).select("file", F.size("lines").alias("n_lines"), "flagged")


# ---- candidates, masking, injecting, sanitizing

_alike = " OR ".join("regexp_matches(value, '{}')".format(p.replace("'", "''")) for _, p in P.LOOKALIKES)


@query(f"""WITH {TH}, {LOOK}, f AS (SELECT doc_id, line, value FROM th WHERE h < 5 UNION ALL SELECT doc_id, line, NULL FROM look),
bad AS (SELECT DISTINCT doc_id FROM f WHERE NOT EXISTS (SELECT 1 FROM look l WHERE l.doc_id = f.doc_id AND l.line = f.line) AND NOT coalesce({_alike}, FALSE))
SELECT source, count(*) AS n, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM bad)) AS n_kept FROM documents GROUP BY source""")
def sanitation_gate(spark, sf_dir):
    docs = read(spark, sf_dir)
    look = detect.lookalikes(docs)
    h = F.pmod(F.col("doc_id") * 7919 + F.col("start"), F.lit(100))
    found = D.tokens(docs).filter(h < 5).select("doc_id", "line", "value")  # lookalikes explain themselves
    slim = docs.select("doc_id", "source")
    kept = detect.gate(slim, found, look).withColumn("kept", F.lit(True)).select("doc_id", "kept")
    return slim.join(kept, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("n_kept"))


@query()
def keyworded_values(spark, sf_dir):
    """Values assigned to secret-like keys: its pattern looks ahead, which SQL's can't; tests have its cases."""
    docs = read(spark, sf_dir)
    return spans.find(docs, P.KEYWORDED_VALUE, lead=P.KEYWORDED, tail=P.NO_CALL).drop("before")


@query()
def candidate_spans(spark, sf_dir):
    """Candidates in texts with planted secrets, by detector and family."""
    docs = planted_texts(spark, sf_dir)
    return detect.candidates(docs).groupBy("detector", "family").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"""WITH {TH}, a AS (SELECT doc_id, "start", "end" FROM th WHERE h < 60), b AS (SELECT doc_id, "start" + 2 AS "start", "end" + 2 AS "end" FROM th WHERE h BETWEEN 40 AND 80), pair AS (SELECT *, 0 AS external FROM a UNION ALL SELECT *, 1 FROM b a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE {_over}))
SELECT doc_id, "start", "end", external FROM pair x WHERE external = 0 OR NOT EXISTS (SELECT 1 FROM pair y WHERE y.external = 1 AND y.doc_id = x.doc_id AND y."start" < x."start" AND y."end" > x."start")""")
def candidate_union(spark, sf_dir):
    """Own spans before another scanner's; of the latter those that overlap go."""
    tok = D.tokens(read(spark, sf_dir)).withColumn("h", F.pmod(F.col("doc_id") * 7919 + F.col("start"), F.lit(100))).withColumns({"detector": F.lit("entropy"), "family": F.lit("token")})
    other = tok.filter("h between 40 and 80").withColumns({"start": F.col("start") + 2, "end": F.col("end") + 2, "detector": F.lit("other")})
    return detect.with_external(tok.filter("h < 60"), other).select("doc_id", "start", "end", "external")


@query(f"SELECT doc_id, sha256(regexp_replace(text, '{P.TOKEN}', '[SECRET]', 'g')) AS masked_sha256, CAST(len(regexp_extract_all(text, '{P.TOKEN}')) AS INTEGER) AS n_masked FROM documents")
def mask_text(spark, sf_dir):
    rows = streaming.mask_stream(read(spark, sf_dir).select("doc_id", "text"), P.TOKEN)
    return rows.select("doc_id", F.sha2("masked", 256).alias("masked_sha256"), "n_masked")


@query()
def sanitize_invariants(spark, sf_dir):
    """Texts with planted secrets, sanitized: none that is kept changes its length or holds a sanitized value."""
    planted = planted_texts(spark, sf_dir)
    texts, records = sanitize.sanitize(planted)
    per = records.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    t = texts.join(planted.withColumnRenamed("text", "raw"), "doc_id").join(per, "doc_id", "left")
    t = t.withColumn("left_over", F.exists("spans", lambda x: F.contains(F.col("text"), T.cut(F.col("raw"), x["start"], x["end"]))))
    return t.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.length("text") != F.length("raw")).alias("n_length_changed"), F.count_if("left_over").alias("n_value_left"))


@query()
def sanitize_records(spark, sf_dir):
    """Records and exclusions by family or reason; synthetic values come from a hash in Python."""
    texts, records = sanitize.sanitize(planted_texts(spark, sf_dir))
    a = records.groupBy(F.col("family").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(texts.filter("exclude_reason is not null").groupBy(F.col("exclude_reason").alias("what")).agg(F.count(F.lit(1)).alias("n")))


@query(f"SELECT doc_id, sha256(regexp_replace(text, '{P.TOKEN}', '[SECRET]', 'g')) AS masked_sha256 FROM documents")
def stream_mask(spark, sf_dir):
    """The same masking as a stream over the table's files."""
    out, checkpoint = scratch_path(spark, "masked"), scratch_path(spark, "masked-state")
    schema = read(spark, sf_dir).select("doc_id", "text").schema
    streaming.start_masking(spark, f"{sf_dir}/documents.parquet", schema, P.TOKEN, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("doc_id", F.sha2("masked", 256).alias("masked_sha256"))


@query(f"""WITH {sql_matches('ip', P.LOOKALIKES[7][1])}, l AS (SELECT ip.*, string_split(text, chr(10)) AS lines FROM ip JOIN documents USING (doc_id)) SELECT doc_id, "start", sha256(array_to_string(lines[greatest(line - 2, 1):line + 2], chr(10))) AS context_sha256 FROM l""")
def context_snippets(spark, sf_dir):
    docs = read(spark, sf_dir)
    found = spans.find(docs, P.LOOKALIKES[7][1]).select("doc_id", "start", "line").join(docs.select("doc_id", "text"), "doc_id")
    return found.select("doc_id", "start", F.sha2(T.context(F.col("text"), F.col("line"), 2), 256).alias("context_sha256"))


# ---- sampling and labelling

_items = f"""{TOK}, items AS (SELECT CAST(tok.doc_id AS VARCHAR) || ':' || tok."start" AS id, lang || '|' || {SHAPE} AS stratum FROM tok JOIN documents USING (doc_id))"""
_alloc = """pools AS (SELECT stratum, count(*) AS pool FROM items GROUP BY stratum), s0 AS (SELECT *, sum(pool) OVER () AS total FROM pools), s1 AS (SELECT *, 200 * pool / total::DOUBLE AS share FROM s0),
s2 AS (SELECT *, least(pool, greatest(1, CAST(floor(share) AS BIGINT))) AS first, share - floor(share) AS rest FROM s1), s3 AS (SELECT *, 200 - sum(first) OVER () AS gap, row_number() OVER (ORDER BY rest DESC, stratum) AS rank FROM s2),
u AS (SELECT stratum, rank, gap, unnest(range(1, CAST(least(CASE WHEN gap > 0 THEN pool - first ELSE first - 1 END, abs(gap)) AS BIGINT) + 1)) AS pass FROM s3), t AS (SELECT *, row_number() OVER (ORDER BY pass, rank) AS nth FROM u),
k AS (SELECT stratum, count(*) AS k FROM t WHERE nth <= abs(gap) GROUP BY stratum), alloc AS (SELECT s3.stratum, pool, CAST(first + sign(gap) * coalesce(k, 0) AS BIGINT) AS alloc FROM s3 LEFT JOIN k USING (stratum))"""
_picked = """ranked AS (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('0|pick|' || id), id) AS nth FROM items), picked AS (SELECT id, stratum, nth <= alloc AS picked FROM ranked JOIN alloc USING (stratum))"""


def _strata(spark, sf_dir):
    docs = read(spark, sf_dir)
    tok = D.tokens(docs).join(docs.select("doc_id", "lang"), "doc_id")
    return tok.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("start").cast("string")).alias("id"), F.concat_ws("|", "lang", T.shape(F.col("value"))).alias("stratum"))


def _allocated(items):
    return sample.allocate(items.groupBy("stratum").agg(F.count(F.lit(1)).alias("pool")), 200)


@query(f"WITH {_items}, {_alloc} SELECT * FROM alloc")
def stratified_alloc(spark, sf_dir):
    return _allocated(_strata(spark, sf_dir))


@query(f"WITH {_items}, {_alloc}, {_picked} SELECT id, stratum FROM picked WHERE picked")
def stratified_pick(spark, sf_dir):
    items = _strata(spark, sf_dir)
    return sample.pick(items, _allocated(items)).filter("picked").select("id", "stratum")


@query(f"WITH {_items}, {_alloc}, {_picked} SELECT id FROM picked WHERE NOT picked")
def reserve_ids(spark, sf_dir):
    items = _strata(spark, sf_dir)
    return sample.pick(items, _allocated(items)).filter("not picked").select("id")


@query("SELECT doc_id, chr(CAST(65 + (row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) - 1) % 3 AS INTEGER)) AS part FROM documents")
def round_robin_partition(spark, sf_dir):
    docs = read(spark, sf_dir).select("doc_id", "lang", "source", "n_chars")
    return sample.round_robin(docs, ["lang", "source"], [F.desc("n_chars"), "doc_id"]).select("doc_id", "part")


_packets = f"""{sql_matches('ip', P.LOOKALIKES[7][1])}, it AS (SELECT CAST(ip.doc_id AS VARCHAR) || ':' || ip."start" AS id, ip.*, lang, string_split(text, chr(10)) AS lines FROM ip JOIN documents USING (doc_id)),
dup AS (SELECT * EXCLUDE (k, n) FROM (SELECT *, row_number() OVER (ORDER BY sha256('0|dup|' || id), id) AS k, round(count(*) OVER () * 0.12) AS n FROM it) WHERE k <= n),
bo AS (SELECT *, FALSE AS is_dup FROM it UNION ALL SELECT *, TRUE FROM dup),
pk AS (SELECT *, 'spkt-' || lpad(CAST(row_number() OVER (ORDER BY sha256('0|order|' || id || '|' || CASE WHEN is_dup THEN 'true' ELSE 'false' END), id) - 1 AS VARCHAR), 4, '0') AS packet_id, "start" - CAST(coalesce(list_sum(list_transform(lines[1:line - 1], lambda x: length(x) + 1)), 0) AS INTEGER) AS col FROM bo)"""


def _packet_items(spark, sf_dir):
    docs = read(spark, sf_dir)
    found = spans.find(docs, P.LOOKALIKES[7][1]).select("doc_id", "start", "end", "line").join(docs.select("doc_id", "lang", "text"), "doc_id")
    return found.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("start").cast("string")).alias("id"), "lang", "text", "start", "end", "line")


@query(f"""WITH {_packets} SELECT packet_id, lang, sha256(array_to_string(list_concat(list_concat(lines[greatest(line - 8, 1):line], [repeat(' ', col) || repeat('^', greatest(1, "end" - "start"))]), lines[line + 1:line + 8]), chr(10))) AS context_sha256 FROM pk""")
def blind_packets(spark, sf_dir):
    shown, _ = sample.packets(_packet_items(spark, sf_dir))
    return shown.select("packet_id", "lang", F.sha2("context", 256).alias("context_sha256"))


@query(f"WITH {_packets} SELECT packet_id, id, is_dup FROM pk")
def packet_map(spark, sf_dir):
    return sample.packets(_packet_items(spark, sf_dir))[1]


_rows = "rows AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN quality = 1 THEN 'POLICY_POSITIVE' ELSE 'POLICY_NEGATIVE' END AS label FROM labels UNION ALL SELECT CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 7 = 0 THEN 'AMBIGUOUS_EXCLUDED' WHEN quality = 1 THEN 'POLICY_POSITIVE' ELSE 'POLICY_NEGATIVE' END FROM labels WHERE doc_id % 3 = 0)"
_resolved = _rows + ", res AS (SELECT id, CASE WHEN count(DISTINCT label) = 1 THEN min(label) ELSE 'AMBIGUOUS_EXCLUDED' END AS label, count(*) AS n_labels, count(DISTINCT label) = 1 AS agreed FROM rows GROUP BY id)"


def _label_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "labels")
    label = F.when(F.col("quality") == 1, P.POSITIVE).otherwise(P.NEGATIVE)
    one = rows.select(F.col("doc_id").cast("string").alias("id"), label.alias("label"))
    return one.unionByName(rows.filter("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 7 == 0, P.AMBIGUOUS).otherwise(label).alias("label")))


@query(f"WITH {_resolved} SELECT * FROM res")
def label_resolution(spark, sf_dir):
    return sample.resolve_labels(_label_rows(spark, sf_dir))


@query(f"""WITH {_resolved} SELECT sha256('{{' || string_agg('"' || id || '": "' || label || '"', ', ' ORDER BY id) || '}}') AS labels_sha256, count(*) AS n FROM res""")
def label_freeze(spark, sf_dir):
    return sample.frozen_hash(sample.resolve_labels(_label_rows(spark, sf_dir)))


@query(f"WITH {_resolved} SELECT count(*) AS pairs, count(*) FILTER (WHERE agreed) AS agreed, round(CASE WHEN count(*) > 0 THEN (count(*) FILTER (WHERE agreed))::DOUBLE / count(*) END, 4) AS rate FROM res WHERE n_labels > 1")
def intra_rater(spark, sf_dir):
    return sample.agreement(sample.resolve_labels(_label_rows(spark, sf_dir)))


_rx = lambda c, p: f"regexp_matches({c}, '{p}')"
_sug = f"""{TOK}, it AS (SELECT tok.*, string_split(text, chr(10))[line] AS l, CASE WHEN (doc_id + "start") % 11 = 0 THEN 'gitleaks' WHEN (doc_id + "start") % 13 = 0 THEN 'vendor_prefix' ELSE 'entropy' END AS detector FROM tok JOIN documents USING (doc_id)), ky AS (SELECT *, substr(l, 1, instr(l, value) - 1) AS key FROM it),
sg AS (SELECT CASE WHEN detector = 'vendor_prefix' THEN 'POLICY_POSITIVE/vendor prefix' WHEN {_rx('value', P.PLACEHOLDER)} OR {_rx('key', P.PLACEHOLDER)} THEN 'POLICY_NEGATIVE/placeholder' WHEN {_rx('key', P.NEGATIVE_KEY)} AND NOT {_rx('key', P.STRONG_KEY)} THEN 'POLICY_NEGATIVE/key of a non-secret' WHEN {_rx('key', P.STRONG_KEY)} THEN 'POLICY_POSITIVE/key of a secret'
WHEN detector = 'gitleaks' THEN 'POLICY_POSITIVE/flagged by a scanner' WHEN {ENTROPY} >= 4.3 AND length(value) >= 24 THEN 'AMBIGUOUS_EXCLUDED/bare high-entropy literal' ELSE 'AMBIGUOUS_EXCLUDED/unclear' END AS s FROM ky)"""


@query(f"WITH {_sug} SELECT split_part(s, '/', 1) AS label, split_part(s, '/', 2) AS reason, count(*) AS n FROM sg GROUP BY 1, 2")
def suggest_labels(spark, sf_dir):
    docs = read(spark, sf_dir)
    tok = D.tokens(docs).join(docs.select("doc_id", "text"), "doc_id")
    line = F.get(F.split("text", "\n"), F.col("line") - 1)
    k = F.col("doc_id") + F.col("start")
    items = tok.select(F.when(k % 11 == 0, "gitleaks").when(k % 13 == 0, "vendor_prefix").otherwise("entropy").alias("detector"), F.substr(line, F.lit(1), F.greatest(F.instr(line, F.col("value")) - 1, F.lit(0))).alias("key"), "value")
    return sample.suggest(items).groupBy("label", "reason").agg(F.count(F.lit(1)).alias("n"))


# ---- decoding


@query("""WITH t AS (SELECT doc_id, CAST(n_chars AS INTEGER) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(0, greatest(n, 1), 382)) AS first FROM t), k AS (SELECT *, CAST(first // 382 AS INTEGER) AS "window" FROM w WHERE first = 0 OR first - 382 + 510 < n)
SELECT doc_id, "window", CAST(first AS INTEGER) AS first, CAST(least(first + 510, n) AS INTEGER) AS last FROM k""")
def token_windows(spark, sf_dir):
    """Windows of 510 over n_chars tokens, 382 apart."""
    docs = read(spark, sf_dir).select("doc_id", F.col("n_chars").alias("n_tokens"))
    return decode.token_windows(docs).select("doc_id", "window", "first", "last")


_pieces = TOK + """, p0 AS (SELECT doc_id, "start", "end", unnest([0, 1, 2]) AS k FROM tok), p1 AS (SELECT doc_id, "start" + 4 * k AS s, CASE WHEN k = 2 THEN "end" ELSE "start" + 4 * k + 4 END AS e, k FROM p0),
p2 AS (SELECT doc_id, s, e, ['O', 'B', 'I'][CAST((doc_id + s + 7 * k) % 3 AS INTEGER) + 1] AS label, ((doc_id * 13 + s + k) % 100) / 100.0::DOUBLE AS p FROM p1),
pieces AS (SELECT doc_id, 0 AS win, s, e, label, p FROM p2 UNION ALL SELECT doc_id, 1, s, e, label, p / 2 FROM p2 WHERE s % 5 = 0),
fw AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s, e ORDER BY win, s) AS n FROM pieces WHERE e > s) WHERE n = 1)"""
_ents = ", b AS (SELECT *, coalesce(lag(label) OVER (PARTITION BY doc_id ORDER BY s, e), 'O') AS prev FROM fw), r AS (SELECT *, sum(CASE WHEN label = 'B' OR (label = 'I' AND prev = 'O') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS run FROM b), ents AS (SELECT doc_id, min(s) AS \"start\", max(e) AS \"end\", avg(p) AS score, count(*) AS n_pieces FROM r WHERE label <> 'O' GROUP BY doc_id, run)"


@query(f'WITH {_pieces} SELECT doc_id, s AS "start", e AS "end", win AS "window", label, p FROM fw')
def first_window_wins(spark, sf_dir):
    return decode.first_window_wins(D.pieces(D.tokens(read(spark, sf_dir)))).drop("pos")


@query(f'WITH {_pieces}{_ents} SELECT doc_id, "start", "end", round(score, 6) AS score, n_pieces FROM ents')
def bio_entities(spark, sf_dir):
    found = decode.entities(decode.first_window_wins(D.pieces(D.tokens(read(spark, sf_dir)))))
    return found.withColumn("score", F.round("score", 6))


@query(f"WITH {_pieces}{_ents} SELECT doc_id, count(*) FILTER (WHERE label = 'I' AND prev = 'O') AS invalid FROM b GROUP BY doc_id")
def invalid_bio(spark, sf_dir):
    return decode.invalid_transitions(decode.first_window_wins(D.pieces(D.tokens(read(spark, sf_dir)))))


@query(f'WITH {_pieces}{_ents} SELECT doc_id, "start", "end", round(score, 6) AS score FROM ents WHERE score >= 0.5')
def threshold_spans(spark, sf_dir):
    found = decode.entities(decode.first_window_wins(D.pieces(D.tokens(read(spark, sf_dir)))))
    return decode.threshold(found, 0.5).select("doc_id", "start", "end", "score")


@query()
def rule_scorer_spans(spark, sf_dir):
    """Spans of the built-in rule scorer through the scorer interface (not a model)."""
    return decode.infer_spans(read(spark, sf_dir), "rules", 0.6).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# ---- integrity, leakage, errors


@query("""WITH h AS (SELECT doc_id, doc_id % 256 AS b, sha256(text) AS h FROM documents), g AS (SELECT b, count(*) AS n, sha256(string_agg(h, '' ORDER BY doc_id)) AS h FROM h GROUP BY b)
SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, '' ORDER BY b)) AS sha256 FROM g""")
def corpus_hash(spark, sf_dir):
    return integrity.corpus_hash(read(spark, sf_dir))


@query(f"WITH {TOK}, {sql_matches('bt', P.TOKEN, 'benchmark', 'item_id')} SELECT DISTINCT value FROM tok WHERE value IN (SELECT value FROM bt)")
def value_leakage(spark, sf_dir):
    bench = read(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    return integrity.leaked_values(D.tokens(read(spark, sf_dir)), D.tokens(bench))


@query(f"""WITH {TOK} SELECT doc_id, "start", substr(sha256('spanloom-v1|' || doc_id || '|' || "start" || '|' || "end" || '|token'), 1, 16) AS id FROM tok""")
def candidate_ids(spark, sf_dir):
    tok = D.tokens(read(spark, sf_dir))
    return tok.select("doc_id", "start", integrity.candidate_id(F.col("doc_id").cast("string"), F.col("start"), F.col("end"), F.lit("token")).alias("id"))


_cls = sql_value_class()


@query(f"""WITH {TH}, e AS (SELECT 'FP' AS kind, value, doc_id, "start" FROM th WHERE h < 20 UNION ALL SELECT 'FN', value, doc_id, "start" FROM th WHERE h >= 80), c AS (SELECT kind, {_cls} AS class, value, doc_id, "start" FROM e),
g AS (SELECT kind, class, count(*) AS n FROM c GROUP BY ALL), x AS (SELECT kind, class, list(value ORDER BY doc_id, "start")[1:4] AS v FROM c GROUP BY ALL)
SELECT kind, class, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY kind), 2) AS pct, array_to_string(v, ' ') AS examples FROM g JOIN x USING (kind, class)""")
def error_taxonomy(spark, sf_dir):
    """Errors by kind and class of value, with shares and the first four examples of each."""
    tok = D.tokens(read(spark, sf_dir)).withColumn("h", F.pmod(F.col("doc_id") * 7919 + F.col("start"), F.lit(100)))
    err = tok.filter("h < 20 or h >= 80").select(F.when(F.col("h") < 20, "FP").otherwise("FN").alias("kind"), T.value_class(F.col("value")).alias("class"), "value", "doc_id", "start")
    w = Window.partitionBy("kind", "class").orderBy("doc_id", "start")
    first = err.withColumn("nth", F.row_number().over(w)).filter("nth <= 4").groupBy("kind", "class").agg(F.array_sort(F.collect_list(F.struct("nth", "value"))).alias("x"))
    n = err.groupBy("kind", "class").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("kind")), 2))
    return n.join(first, ["kind", "class"]).select("kind", "class", "n", "pct", F.array_join(F.transform("x", lambda v: v["value"]), " ").alias("examples"))


@query(f"""WITH {PRED}, r AS (SELECT doc_id, score, "start", row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, "start", "end", line) AS n FROM pred) SELECT doc_id, max(score) AS max_score, count(*) AS n_pred, array_to_string(list("start" ORDER BY n)[1:3], ',') AS top_starts FROM r GROUP BY doc_id""")
def top_predictions(spark, sf_dir):
    """A document's best score and its three best predictions."""
    pred = D.predictions(D.tokens(read(spark, sf_dir)))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "start", "end", "line")
    n = pred.groupBy("doc_id").agg(F.max("score").alias("max_score"), F.count(F.lit(1)).alias("n_pred"))
    top = pred.withColumn("n", F.row_number().over(w)).filter("n <= 3").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "start"))).alias("t"))
    return n.join(top, "doc_id").select("doc_id", "max_score", "n_pred", F.array_join(F.transform("t", lambda x: x["start"].cast("string")), ",").alias("top_starts"))


@query("""WITH c AS (SELECT page_id, regexp_replace(rtrim(trim(url), '/'), '\\.git$', '') AS u FROM pages) SELECT page_id, lower(CASE WHEN regexp_extract(u, '([^/]+/[^/]+)$', 1) <> '' THEN regexp_extract(u, '([^/]+/[^/]+)$', 1) ELSE u END) AS name FROM c""")
def repo_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.repo_name(F.col("url")).alias("name"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
