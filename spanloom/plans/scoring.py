"""Registered queries, further ones: planted secrets, whole evaluations, errors, labels, selection, readers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import evaluate, inject, integrity, sample, select, spans
from ..sources import readers, sinks
from . import derived as D
from .queries import PRED, TAUS, TH, TOK, _cls, _label, _over, _packet_items, _packets, query, read, scratch_path, sql_counts, sql_matches, sql_prf, sql_ratio

# ---- planted secrets

KINDS = tuple(P.INJECTED_LINES)


def _sql_byte(seed: str, salt: str, k: str) -> str:
    h = f"(sha256('{salt}|0|' || {seed}) || sha256('{salt}|1|' || {seed}))"
    digit = lambda i: f"(instr('0123456789abcdef', substr({h}, {i}, 1)) - 1)"
    return f"(16 * {digit(f'2 * {k} + 1')} + {digit(f'2 * {k} + 2')})"


def _sql_chars(seed: str, n: str, alphabet: str, salt: str) -> str:
    return f"array_to_string(list_transform(range({n}), lambda k: substr('{alphabet}', {_sql_byte(seed, salt, 'k')} % {len(alphabet)} + 1, 1)), '')"


_seed = "('0|' || doc_id)"
_size = lambda least, most: f"{least} + {_sql_byte(_seed, 'n', '0')} % {most - least + 1}"
_user = f"'svc_' || {_sql_chars(_seed, '4', P.DIGITS, 'user')} || ':' || {_sql_chars(_seed, '16', P.ALNUM, 'pass')}"
_pick = lambda values, k: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{k} + 1]"
PLANTED = f"""pl0 AS (SELECT doc_id, string_split(text, chr(10)) AS lines, CAST(doc_id % 4 AS INTEGER) AS n, {_pick(KINDS, f'CAST(doc_id % {len(KINDS)} AS INTEGER)')} AS kind, {_pick(P.INJECTED_LINES.values(), f'CAST(doc_id % {len(KINDS)} AS INTEGER)')} AS form,
CASE doc_id % 4 WHEN 0 THEN {_sql_chars(_seed, _size(14, 24), P.ALNUM + P.SYMBOLS, 'pw')} WHEN 1 THEN {_sql_chars(_seed, _size(32, 40), P.ALNUM, 'key')} WHEN 2 THEN {_sql_chars(_seed, '40', P.ALNUM + P.BASE64_SYMBOLS, 'he')} ELSE 'Basic ' || to_base64(encode({_user})) END AS whole FROM documents),
pl1 AS (SELECT *, {_pick(P.FAMILIES, 'n')} AS type, CASE WHEN kind IN {P.UPPER_KEYS} THEN upper({_pick(P.FAMILY_KEYS, 'n')}) ELSE {_pick(P.FAMILY_KEYS, 'n')} END AS name,
CAST(coalesce(list_max(list_filter(list_transform(range(least(len(lines), 60)), lambda i: CASE WHEN regexp_matches(lines[i + 1], '[:=]\\s*\\S') AND NOT regexp_matches(trim(lines[i + 1]), '^(#|//|\\*)') THEN i END), lambda i: i IS NOT NULL)), 0) + 1 AS INTEGER) AS anchor FROM pl0),
pl2 AS (SELECT *, CASE WHEN n = 3 THEN substr(whole, 7) ELSE whole END AS value, replace(replace(form, '{{K}}', name), '{{V}}', whole) AS line_text, array_to_string(lines[1:anchor], chr(10)) || chr(10) AS head FROM pl1),
planted AS (SELECT doc_id, head || array_to_string(list_concat([line_text], lines[anchor + 1:]), chr(10)) AS text, CAST(length(head) + instr(line_text, value) - 1 AS INTEGER) AS "start", CAST(length(head) + instr(line_text, value) - 1 + length(value) AS INTEGER) AS "end", anchor + 1 AS line, value, type FROM pl2)"""


def planted(spark, sf_dir):
    return inject.inject(read(spark, sf_dir), kind=F.get(F.array(*map(F.lit, KINDS)), F.pmod("doc_id", F.lit(len(KINDS))).cast("int")))


@query(f"""WITH {PLANTED} SELECT doc_id, "start", "end", line, type, value, sha256(text) AS text_sha256, substr(text, "start" + 1, "end" - "start") = value AS right_place FROM planted""")
def inject_offsets(spark, sf_dir):
    """Every document with a planted secret in the form of some kind of source file: the label and the new text."""
    return planted(spark, sf_dir).select("doc_id", "start", "end", "line", "type", "value", F.sha2("text", 256).alias("text_sha256"), (T.cut(F.col("text"), F.col("start"), F.col("end")) == F.col("value")).alias("right_place"))


@query(f"""WITH {PLANTED} SELECT type, CASE WHEN type = 'basic_auth_header' THEN 2 ELSE 1 END AS gt_revision, count(*) AS n, CAST(sum("start") AS BIGINT) AS sum_start, count(*) FILTER (WHERE substr(text, "start" + 1, "end" - "start") <> value) AS n_wrong FROM planted GROUP BY type""")
def gold_correction(spark, sf_dir):
    """Gold spans that still hold the scheme word, corrected and verified byte by byte."""
    basic = F.col("type") == "basic_auth_header"
    wide = planted(spark, sf_dir).withColumns({"start": F.when(basic, F.col("start") - 6).otherwise(F.col("start")), "value": F.when(basic, F.concat(F.lit("Basic "), "value")).otherwise(F.col("value"))})
    fixed = integrity.corrected_gold(wide)
    return fixed.groupBy("type", "gt_revision").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("sum_start"), F.count_if(T.cut(F.col("text"), F.col("start"), F.col("end")) != F.col("value")).alias("n_wrong"))


@query(f"""WITH {PLANTED}, {sql_matches('tok', P.TOKEN, 'planted')}, m AS (SELECT type, EXISTS (SELECT 1 FROM tok b WHERE {_over}) AS o, EXISTS (SELECT 1 FROM tok b WHERE b.doc_id = a.doc_id AND b."start" = a."start" AND b."end" = a."end") AS e FROM planted a),
c AS (SELECT type, count(*) AS n, count(*) FILTER (WHERE o) AS overlap_hits, count(*) FILTER (WHERE e) AS exact_hits FROM m GROUP BY ROLLUP (type)) SELECT *, {sql_ratio('overlap_hits', 'n')} AS overlap_recall, {sql_ratio('exact_hits', 'n')} AS exact_recall FROM c""")
def family_recall(spark, sf_dir):
    """Planted secrets of each family, and of all (type null), that long tokens of the texts overlap or equal."""
    gold = planted(spark, sf_dir)
    found = spans.find(gold.select("doc_id", "text"), P.TOKEN).select("doc_id", "start", "end")
    both = spans.overlapping(gold.select("doc_id", "start", "end", "type"), found, how="left").groupBy("a.doc_id", "type").agg((F.count("b.start") > 0).alias("o"), F.coalesce(F.bool_or((F.col("a.start") == F.col("b.start")) & (F.col("a.end") == F.col("b.end"))), F.lit(False)).alias("e"))
    t = both.rollup("type").agg(F.count(F.lit(1)).alias("n"), F.count_if("o").alias("overlap_hits"), F.count_if("e").alias("exact_hits"))
    return t.select("*", evaluate.ratio(F.col("overlap_hits"), F.col("n")).alias("overlap_recall"), evaluate.ratio(F.col("exact_hits"), F.col("n")).alias("exact_recall"))


@query(f"""WITH m AS (SELECT regexp_replace(text, '{P.TOKEN}', '[SECRET]', 'g') AS masked FROM documents) SELECT count(*) AS n_docs, CAST(sum(length(masked)) AS BIGINT) AS n_chars, count(*) FILTER (WHERE contains(masked, '[SECRET]')) AS n_marked, count(*) FILTER (WHERE regexp_matches(masked, '{P.TOKEN}')) AS n_residue FROM m""")
def mask_residue(spark, sf_dir):
    """Masked texts: how many are marked, how long they are, how many still match."""
    hits = T.matches(F.col("text"), P.TOKEN)
    rows = read(spark, sf_dir).select("text", hits.alias("hits")).select(T.mask(F.col("text"), F.col("hits")).alias("masked"))
    return rows.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("masked")).alias("n_chars"), F.count_if(F.contains("masked", F.lit("[SECRET]"))).alias("n_marked"), F.count_if(F.col("masked").rlike(P.TOKEN)).alias("n_residue"))


# ---- whole evaluations


@query(f"""WITH {PRED}, n AS (SELECT (SELECT count(*) FROM pred b WHERE {_over}) AS k FROM tok a), f AS (SELECT doc_id IN (SELECT doc_id FROM tok) AS g, doc_id IN (SELECT doc_id FROM pred) AS p FROM documents),
e AS ({sql_counts('tok', 'pred', 'doc_id, "start", "end"')}), s AS ({sql_counts('tok', 'pred', 'doc_id, "start", "end", line')}),
x AS (SELECT count(*) AS n_docs, count(*) FILTER (WHERE g AND p) AS file_tp, count(*) FILTER (WHERE p AND NOT g) AS file_fp, count(*) FILTER (WHERE g AND NOT p) AS file_fn, count(*) FILTER (WHERE NOT g AND NOT p) AS file_tn FROM f),
y AS (SELECT count(*) AS n_gold, count(*) FILTER (WHERE k > 1) AS n_multi, count(*) FILTER (WHERE k > 0) AS n_any FROM n)
SELECT n_docs, n_gold, (SELECT count(*) FROM pred) AS n_pred, e.tp AS exact_tp, s.tp AS strict_tp, file_tp, file_fp, file_fn, file_tn, n_multi, round(100.0::DOUBLE * n_multi / nullif(n_gold, 0), 2) AS pct_fragmented, n_any,
round((SELECT count(*) FROM pred)::DOUBLE / nullif(n_gold, 0), 4) AS inflation, {sql_ratio('s.tp', 'e.tp')} AS line_accuracy FROM x, y, e, s""")
def evaluate_all(spark, sf_dir):
    docs = read(spark, sf_dir)
    gold = D.tokens(docs)
    return evaluate.evaluate(docs, gold, D.predictions(gold))


@query(f"""WITH {PRED}, n AS (SELECT (SELECT count(*) FROM pred b WHERE {_over}) AS k FROM tok a) SELECT count(*) AS n_gold, count(*) FILTER (WHERE k > 1) AS n_multi, round(100.0::DOUBLE * (count(*) FILTER (WHERE k > 1)) / nullif(count(*), 0), 2) AS pct_fragmented, count(*) FILTER (WHERE k > 0) AS n_any FROM n""")
def fragmentation_summary(spark, sf_dir):
    gold = D.tokens(read(spark, sf_dir))
    return evaluate.fragmentation_summary(gold, D.predictions(gold))


@query(f"""WITH {PRED}, lab AS (SELECT *, {_label} AS label FROM tok), g AS (SELECT DISTINCT doc_id FROM lab WHERE label = 'POLICY_POSITIVE'), p AS (SELECT DISTINCT doc_id FROM pred a WHERE NOT EXISTS (SELECT 1 FROM lab b WHERE b.label = 'AMBIGUOUS_EXCLUDED' AND {_over})),
c AS (SELECT count(*) FILTER (WHERE g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp, count(*) FILTER (WHERE g.doc_id IS NULL) AS fp, count(*) FILTER (WHERE p.doc_id IS NULL) AS fn FROM g FULL JOIN p ON g.doc_id = p.doc_id) SELECT *, {sql_prf()} FROM c""")
def adjudicated_files(spark, sf_dir):
    tok = D.tokens(read(spark, sf_dir))
    return evaluate.adjudicated_files(D.labelled(tok), D.predictions(tok))


@query(f"""WITH {TH}, p AS (SELECT 'exact' AS tool, doc_id, "start", "end", line FROM tok UNION ALL SELECT 'shifted', doc_id, "start" + CASE WHEN h < 30 THEN 1 ELSE 0 END, "end", line FROM th WHERE h >= 10), g AS (SELECT *, unnest(['exact', 'shifted', 'silent']) AS tool FROM tok),
c AS ({sql_counts('g', 'p', 'tool, doc_id, "start", "end", line', 'tool')}) SELECT *, {sql_ratio('tp', 'tp + fp', 3)} AS precision, {sql_ratio('tp', 'tp + fn', 3)} AS recall, {sql_ratio('2 * tp', '2 * tp + fp + fn', 3)} AS f1 FROM c""")
def tool_strict_prf(spark, sf_dir):
    tok = D.tokens(read(spark, sf_dir))
    h = F.pmod(F.col("doc_id") * 7919 + F.col("start"), F.lit(100))
    place = ["doc_id", "start", "end", "line"]
    shifted = tok.filter(h >= 10).select(F.lit("shifted").alias("tool"), "doc_id", (F.col("start") + F.when(h < 30, 1).otherwise(0)).alias("start"), "end", "line")
    return evaluate.tool_strict(tok, tok.select(F.lit("exact").alias("tool"), *place).unionByName(shifted), ["exact", "shifted", "silent"])


@query(f"""WITH {TH}, pl AS (SELECT doc_id AS file, (SELECT min(line) FROM tok WHERE tok.doc_id = documents.doc_id) AS planted FROM documents), det AS (SELECT 'exact' AS tool, doc_id AS file, line FROM tok UNION ALL SELECT 'noisy', doc_id, line + 1 FROM th WHERE h < 50 UNION ALL SELECT 'noisy', doc_id, 1 FROM documents WHERE doc_id % 10 = 0),
per AS (SELECT tool, file, bool_or(coalesce(line = planted, FALSE)) AS hit, count(planted) > 0 AS is_planted FROM det JOIN pl USING (file) GROUP BY tool, file), t AS (SELECT tool, count(*) FILTER (WHERE NOT is_planted) AS clean_flagged, count(*) FILTER (WHERE is_planted) AS planted_flagged, count(*) FILTER (WHERE hit) AS line_hits FROM per GROUP BY tool),
n AS (SELECT count(*) FILTER (WHERE planted IS NULL) AS n_clean, count(planted) AS n_planted FROM pl) SELECT tool, clean_flagged, n_clean, planted_flagged, line_hits, n_planted, {sql_ratio('clean_flagged', 'n_clean', 3)} AS file_fp, {sql_ratio('line_hits', 'n_planted', 3)} AS line_recall, {sql_ratio('planted_flagged', 'n_planted', 3)} AS file_recall FROM t, n""")
def scanner_baselines(spark, sf_dir):
    docs = read(spark, sf_dir)
    tok = D.tokens(docs)
    lines = docs.select(F.col("doc_id").alias("file")).join(tok.groupBy(F.col("doc_id").alias("file")).agg(F.min("line").alias("line")), "file", "left")
    h = F.pmod(F.col("doc_id") * 7919 + F.col("start"), F.lit(100))
    row = lambda df, tool, line: df.select(F.lit(tool).alias("tool"), F.col("doc_id").alias("file"), line.alias("line"))
    det = row(tok, "exact", F.col("line")).unionByName(row(tok.filter(h < 50), "noisy", F.col("line") + 1)).unionByName(row(docs.filter("doc_id % 10 = 0"), "noisy", F.lit(1)))
    return evaluate.alarms_and_recall(lines, det)


@query(f"""WITH {PRED}, b AS (SELECT (SELECT max(score) FROM pred WHERE pred.doc_id = documents.doc_id) AS best FROM documents WHERE doc_id % 3 = 0), grid AS (SELECT unnest(range(21)) / 20.0::DOUBLE AS tau) SELECT 'errors' AS tag, tau, count(*) FILTER (WHERE best >= tau) AS flagged, count(*) AS n_files, {sql_ratio('count(*) FILTER (WHERE best >= tau)', 'count(*)')} AS file_fp FROM grid, b GROUP BY tau""")
def file_alarm_sweep(spark, sf_dir):
    docs = read(spark, sf_dir)
    return evaluate.file_alarm_sweep(docs.filter("doc_id % 3 = 0"), D.predictions(D.tokens(docs)), TAUS, "errors")


# ---- errors

_scored = "rows AS (SELECT doc_id, doc_id % 2 AS label, source, lang, text, (SELECT max(score) FROM pred WHERE pred.doc_id = documents.doc_id) AS maxscore FROM documents)"


@query(f"""WITH {PRED}, {_scored}, t AS (SELECT count(*) FILTER (WHERE label = 0) AS n_negative, count(*) FILTER (WHERE label = 0 AND coalesce(maxscore, 0) >= 0.6) AS n_fp, count(*) FILTER (WHERE label = 1) AS n_positive, count(*) FILTER (WHERE label = 1 AND coalesce(maxscore, 0) < 0.6) AS n_fn FROM rows)
SELECT *, round(n_fp::DOUBLE / greatest(1, n_negative), 4) AS fp_rate, round(n_fn::DOUBLE / greatest(1, n_positive), 4) AS fn_rate FROM t""")
def error_rates(spark, sf_dir):
    docs = read(spark, sf_dir)
    best = D.predictions(D.tokens(docs)).groupBy("doc_id").agg(F.max("score").alias("maxscore"))
    return evaluate.error_rates(docs.select("doc_id", F.pmod("doc_id", F.lit(2)).alias("label")).join(best, "doc_id", "left"), 0.6)


@query(f"""WITH {PRED}, {_scored}, v AS (SELECT p.doc_id, list(substr(d.text, p."start" + 1, p."end" - p."start") ORDER BY score DESC, p."start", p."end", p.line)[1:3] AS l FROM pred p JOIN documents d USING (doc_id) GROUP BY p.doc_id)
SELECT doc_id, maxscore, array_to_string(l, ' ') AS pred_values, CASE WHEN doc_id % 90 < doc_id % 70 + 5 AND doc_id % 70 + 5 <= length(text) THEN substr(text, CAST(doc_id % 90 AS INTEGER) + 1, CAST(doc_id % 70 + 5 - doc_id % 90 AS INTEGER)) END AS gold_value FROM rows LEFT JOIN v USING (doc_id) WHERE source = (SELECT min(source) FROM documents) OR (lang = 'en' AND label = 1)""")
def error_dump(spark, sf_dir):
    """Of the chosen documents: the best score, the three best values and the gold value, null where its bounds are wrong."""
    docs = read(spark, sf_dir)
    first = read(spark, sf_dir, "documents").agg(F.min("source").alias("first"))
    chosen = docs.join(F.broadcast(first)).filter((F.col("source") == F.col("first")) | ((F.col("lang") == "en") & (F.pmod("doc_id", F.lit(2)) == 1)))  # one row
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), "start", "end", "line")
    top = D.predictions(D.tokens(docs)).withColumn("n", F.row_number().over(best)).filter("n <= 3").groupBy("doc_id").agg(F.max("score").alias("maxscore"), F.array_sort(F.collect_list(F.struct("n", "start", "end"))).alias("t"))
    s, e = F.pmod("doc_id", F.lit(90)).cast("int"), (F.pmod("doc_id", F.lit(70)) + 5).cast("int")
    gold = F.when((s < e) & (e <= F.length("text")), T.cut(F.col("text"), s, e))
    return chosen.join(top, "doc_id", "left").select("doc_id", "maxscore", F.array_join(F.transform("t", lambda x: T.cut(F.col("text"), x["start"], x["end"])), " ").alias("pred_values"), gold.alias("gold_value"))


@query(f"""WITH {TOK}, c AS (SELECT {_cls} AS class, doc_id, "start" FROM tok), g AS (SELECT class, count(*) AS n, min((doc_id, "start")) AS f FROM c GROUP BY class) SELECT class, n, round(100.0::DOUBLE * n / (SELECT sum(n) FROM g), 1) AS pct FROM g ORDER BY n DESC, f LIMIT 5""")
def most_common_classes(spark, sf_dir):
    tok = D.tokens(read(spark, sf_dir))
    return evaluate.most_common(tok.select(T.value_class(F.col("value")).alias("class"), "doc_id", "start"), "class", ("doc_id", "start"), 5)


# ---- candidates, packets, windows


@query(f"""WITH {TOK} SELECT coalesce(p.source, '?') AS source, count(*) AS n FROM tok LEFT JOIN (SELECT doc_id, source FROM documents WHERE doc_id % 4 <> 0) p USING (doc_id) GROUP BY 1""")
def candidates_by_provenance(spark, sf_dir):
    """Candidates with where they come from; ? where that is not known."""
    docs = read(spark, sf_dir)
    known = docs.filter("doc_id % 4 <> 0").select("doc_id", "source")
    return D.tokens(docs).join(known, "doc_id", "left").groupBy(F.coalesce("source", F.lit("?")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


_nth = "CAST(substr(packet_id, 6) AS INTEGER)"


@query(f"""WITH {_packets}, l AS (SELECT id, CASE {_nth} % 3 WHEN 1 THEN 'POLICY_POSITIVE' ELSE 'POLICY_NEGATIVE' END AS label FROM pk WHERE {_nth} % 3 <> 0) SELECT id, CASE WHEN count(DISTINCT label) = 1 THEN min(label) ELSE 'AMBIGUOUS_EXCLUDED' END AS label, count(*) AS n_labels, count(DISTINCT label) = 1 AS agreed FROM l GROUP BY id""")
def packet_labels(spark, sf_dir):
    """Labels given to packets, brought to their items by the sealed map and resolved."""
    _, sealed = sample.packets(_packet_items(spark, sf_dir))
    n = F.substr("packet_id", F.lit(6)).cast("int")
    given = sealed.filter(n % 3 != 0).select("packet_id", F.when(n % 3 == 1, P.POSITIVE).otherwise(P.NEGATIVE).alias("label"))
    return sample.resolve_labels(sample.unsealed(given, sealed))


@query(f"""WITH {_packets} SELECT packet_id, lang FROM pk WHERE {_nth} % 3 = 0""")
def unlabelled_packets(spark, sf_dir):
    """What a labeler who starts again still has to do."""
    shown, sealed = sample.packets(_packet_items(spark, sf_dir))
    done = sealed.filter(F.substr("packet_id", F.lit(6)).cast("int") % 3 != 0).select("packet_id")
    return readers.resumed(shown, done, "packet_id").select("packet_id", "lang")


@query(f"""WITH {sql_matches('ip', P.LOOKALIKES[7][1])}, w AS (SELECT doc_id, greatest(0, min(line) - 25) AS a, max(line) + 25 AS b FROM ip GROUP BY doc_id), s AS (SELECT w.*, string_split(text, chr(10)) AS lines FROM w JOIN documents USING (doc_id)),
x AS (SELECT doc_id, a, CAST(coalesce(list_sum(list_transform(lines[1:a], lambda l: length(l) + 1)), 0) AS INTEGER) AS off, array_to_string(lines[a + 1:b], chr(10)) AS snippet FROM s)
SELECT doc_id, ip."start" - off AS "start", ip."end" - off AS "end", ip.line - a AS line, sha256(snippet) AS snippet_sha256, substr(snippet, ip."start" - off + 1, ip."end" - ip."start") AS value FROM ip JOIN x USING (doc_id)""")
def snippet_windows(spark, sf_dir):
    """The lines around a document's hits, with the hits' places in that snippet."""
    docs = read(spark, sf_dir)
    return spans.snippets(docs, spans.find(docs, P.LOOKALIKES[7][1]).select("doc_id", "start", "end", "line"), 25).select("doc_id", "start", "end", "line", F.sha2("snippet", 256).alias("snippet_sha256"), T.cut(F.col("snippet"), F.col("start"), F.col("end")).alias("value"))


@query(f"""WITH {TOK}, a AS (SELECT doc_id, "start", lang, row_number() OVER (PARTITION BY doc_id ORDER BY "start") AS k FROM tok JOIN documents USING (doc_id)), b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, "start") AS j FROM a WHERE k <= 2) SELECT doc_id, "start", lang FROM b WHERE j <= 40""")
def capped_harvest(spark, sf_dir):
    """At most two spans of a document, then at most forty of a language."""
    docs = read(spark, sf_dir)
    rows = D.tokens(docs).join(docs.select("doc_id", "lang"), "doc_id")
    return sample.capped(sample.capped(rows, ["doc_id"], ["start"], 2), ["lang"], ["doc_id", "start"], 40).select("doc_id", "start", "lang")


# ---- selection, readers, addresses

_repos = """rp AS (SELECT page_id AS node_id, url AS full_name, ['go', 'java', 'js', 'py'][CAST(page_id % 4 AS INTEGER) + 1] AS lang, CAST(page_id * 7919 % 5000 AS INTEGER) AS stars, page_id % 11 = 0 AS fork, page_id % 13 = 0 AS archived, CASE WHEN page_id % 17 = 0 THEN 'm' END AS mirror_url, page_id % 19 AS size, CASE WHEN page_id % 23 <> 0 THEN 'main' END AS default_branch FROM pages),
nm AS (SELECT *, regexp_replace(rtrim(trim(full_name), '/'), '\\.git$', '') AS u FROM rp), nn AS (SELECT *, lower(CASE WHEN regexp_extract(u, '([^/]+/[^/]+)$', 1) <> '' THEN regexp_extract(u, '([^/]+/[^/]+)$', 1) ELSE u END) AS norm FROM nm),
el AS (SELECT * FROM nn WHERE NOT fork AND NOT archived AND mirror_url IS NULL AND size > 0 AND default_branch IS NOT NULL QUALIFY row_number() OVER (PARTITION BY norm ORDER BY stars DESC, node_id) = 1), ex AS (SELECT * FROM el WHERE norm NOT IN (SELECT norm FROM nn WHERE node_id % 7 = 0)),
bu AS (SELECT *, CASE WHEN stars >= 3000 THEN 'high' WHEN stars >= 1000 THEN 'mid' WHEN stars >= 50 THEN 'low' END AS bucket FROM ex), ch AS (SELECT * FROM bu WHERE bucket IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang, bucket ORDER BY sha256('0|repo|' || node_id), node_id) <= 6)"""


def _chosen(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    n = F.col("page_id")
    repos = pages.select(n.alias("node_id"), F.col("url").alias("full_name"), F.get(F.array(*map(F.lit, ("go", "java", "js", "py"))), (n % 4).cast("int")).alias("lang"), (n * 7919 % 5000).cast("int").alias("stars"), (n % 11 == 0).alias("fork"), (n % 13 == 0).alias("archived"), F.when(n % 17 == 0, "m").alias("mirror_url"), (n % 19).alias("size"), F.when(n % 23 != 0, "main").alias("default_branch"))
    excluded = pages.filter(n % 7 == 0).select("url")
    return select.select(select.eligible(repos, excluded), 6, {"low": 50, "mid": 1000, "high": 3000}), excluded


@query(f"""WITH {_repos} SELECT node_id, norm, lang, bucket, chr(CAST(65 + (row_number() OVER (PARTITION BY lang, bucket ORDER BY stars DESC, node_id) - 1) % 3 AS INTEGER)) AS part FROM ch""")
def repo_selection(spark, sf_dir):
    """Repositories chosen by language and popularity out of captured search results, dealt to three benchmarks."""
    return _chosen(spark, sf_dir)[0].select("node_id", "norm", "lang", "bucket", "part")


@query(f"""WITH {_repos}, t AS (SELECT count(*) - count(DISTINCT norm) AS twice, count(*) FILTER (WHERE norm IN (SELECT norm FROM nn WHERE node_id % 7 = 0)) AS excluded FROM ch) SELECT 'twice' AS rule, twice AS n FROM t UNION ALL SELECT 'parts', twice FROM t UNION ALL SELECT 'excluded', excluded FROM t""")
def selection_contract(spark, sf_dir):
    return select.violations(*_chosen(spark, sf_dir))


@query(f"""WITH {TOK} SELECT CAST(doc_id AS VARCHAR) AS doc_id, "start", "end", line, value FROM tok""")
def span_file_round_trip(spark, sf_dir):
    """Spans written as JSON lines, a line for each document, and read again."""
    docs, path = read(spark, sf_dir), scratch_path(spark, "spans")
    sinks.write_span_docs(D.tokens(docs).withColumn("score", F.lit(1.0)), docs, path)
    return readers.flat_spans(readers.span_docs(spark, path)).select("doc_id", "start", "end", "line", "value")


@query(f"""WITH {TOK}, f AS (SELECT 'doc-' || doc_id AS file, line FROM tok) SELECT tool, file, CAST(line + CASE WHEN tool = 'trufflehog' THEN 1 ELSE 0 END AS INTEGER) AS line, count(*) AS n FROM f, (SELECT unnest(['detect-secrets', 'gitleaks', 'semgrep', 'trufflehog']) AS tool) GROUP BY ALL""")
def scanner_reports(spark, sf_dir):
    """Reports in the forms of four scanners, made of each document's tokens, read into findings."""
    tok = D.tokens(read(spark, sf_dir)).select(F.concat(F.lit("./doc-"), F.col("doc_id").cast("string")).alias("file"), "line", "start", "end")
    per = lambda item: tok.groupBy("file").agg(F.collect_list(item).alias("items"))
    report = lambda df, c: df.select(F.to_json(c).alias("report"))
    gitleaks = report(per(F.struct(F.col("file").alias("File"), F.col("line").alias("StartLine"), F.lit("r").alias("RuleID"), F.lit("REDACTED").alias("Secret"))), F.col("items"))
    detect_secrets = report(per(F.struct(F.lit("r").alias("type"), F.col("line").alias("line_number"))), F.struct(F.create_map("file", "items").alias("results")))
    semgrep = report(per(F.struct(F.col("file").alias("path"), F.struct("line").alias("start"), F.lit("r").alias("check_id"))), F.struct(F.col("items").alias("results")))
    trufflehog = report(tok, F.struct(F.struct(F.struct(F.struct("file", "line").alias("Filesystem")).alias("Data")).alias("SourceMetadata"), F.lit("r").alias("DetectorName")))
    each = {"gitleaks": readers.gitleaks_report(gitleaks).withColumnRenamed("start_line", "line"), "detect-secrets": readers.detect_secrets_report(detect_secrets), "semgrep": readers.semgrep_report(semgrep), "trufflehog": readers.trufflehog_report(trufflehog)}
    out = None
    for tool, found in each.items():
        one = found.select(F.lit(tool).alias("tool"), "file", "line")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("tool", "file", "line").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, replace(url_encode(url), '%2F', '/') AS quoted FROM pages")
def quoted_urls(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.quoted(F.col("url")).alias("quoted"))
