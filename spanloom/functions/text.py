"""Text expressions. Offsets are code points, half-open; lines count from 1."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import patterns as P


#: A noncharacter, put around matches.
EDGE = "\ufdd0"
MATCH = "array<struct<start:int,end:int,line:int,value:string,before:string>>"
#: Makes \\b, \\w, \\s and \\d mean what they mean in Unicode, on every Java release.
UNICODE = "(?U)"
#: Folds that build an array copy it at each step, so they run over blocks of so many elements.
BLOCK = 128


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it and in whatever loops."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def has(value: Column, pattern: str) -> Column:
    return value.rlike(UNICODE + pattern)


def _newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def _prefix_sums(numbers: Column, first: Column) -> Column:
    """first, and first with the numbers before each other one added. Quadratic in the array's length."""
    return F.aggregate(numbers, F.struct(first.cast("long").alias("at"), F.array().cast("array<long>").alias("out")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def running(numbers: Column) -> Column:
    """The sum of all numbers (longs) before each one, in time near the array's length."""
    cut = lambda ns: F.transform(F.sequence(F.lit(0), F.greatest(F.size(ns) - 1, F.lit(0)), F.lit(BLOCK)), lambda k: F.slice(ns, k + 1, F.lit(BLOCK)))
    sums = lambda bs: F.transform(bs, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda t, x: t + x))
    return let(let(numbers, cut), lambda bs: let(_prefix_sums(sums(bs), F.lit(0)), lambda firsts: F.flatten(F.transform(bs, lambda b, k: _prefix_sums(b, F.get(firsts, k))))))


LINE = 1 << 32  # a length and a number of line ends in one long


def _placed(ps: Column) -> Column:
    """Gap, match, gap, match... to matches with their places: running sums of lengths and line ends."""

    def rows(sums: Column) -> Column:
        start = lambda j: (F.get(sums, j) % LINE).cast("int")
        one = lambda j: F.struct(start(j).alias("start"), (start(j) + F.length(F.get(ps, j))).alias("end"), (F.shiftright(F.get(sums, j), 32) + 1).cast("int").alias("line"), F.get(ps, j).alias("value"), F.right(F.get(ps, j - 1), F.lit(1)).alias("before"))
        return F.transform(F.sequence(F.lit(1), F.size(ps) - 1, F.lit(2)), one)

    sizes = F.transform(ps, lambda x: F.length(x) + _newlines(x) * F.lit(LINE))
    return F.coalesce(F.when(F.size(ps) > 1, let(running(sizes), rows)), F.array().cast(MATCH))


def _pieces(text: Column, pattern: str, lead: str, tail: str) -> Column:
    marked = F.regexp_replace(text, F.lit(f"{UNICODE}({lead})({pattern}){tail}"), F.lit(f"$1{EDGE}$2{EDGE}"))
    whole = F.lit(rf"{UNICODE}(?s)\G(.*?{lead})({pattern}){tail}")
    slow = F.flatten(F.zip_with(F.regexp_extract_all(text, whole, F.lit(1)), F.regexp_extract_all(text, whole, F.lit(2)), lambda g, m: F.array(g, m)))
    held = F.contains(text, F.lit(EDGE))
    # most texts hold most patterns nowhere, and a search costs less than a replacement
    return F.when(held, slow).when(text.rlike(f"{UNICODE}{lead}(?:{pattern}){tail}"), F.split(marked, EDGE))


def matches(text: Column, pattern: str, lead: str = "", tail: str = "") -> Column:
    """array<struct<start,end,line,value,before>> of all matches of pattern, in order, without a Python function, in
    time near the length of the text. Character classes are those of Unicode.

    One replacement puts EDGE around each match and a split at EDGE gives gaps and matches in turn. A text that
    holds EDGE itself goes the slower way of extracting each match with the gap before it. lead is matched in
    front of the value and tail (zero-width) behind it, neither is part of it; before is the character in front
    of the value. Groups inside lead and pattern must not capture.
    """
    return let(_pieces(text, pattern, lead, tail), _placed)


def matches_each(text: Column, patterns: Sequence[tuple[str, str, str]]) -> Column:
    """An array of the matches of each (pattern, lead, tail); one expression places them all."""
    return F.transform(F.array(*[_pieces(text, *p) for p in patterns]), _placed)


def line_of(text: Column, start: Column) -> Column:
    head = F.substr(text, F.lit(1), start)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def line_starts(text: Column) -> Column:
    return let(F.split(text, "\n"), lambda lines: running(F.transform(lines, lambda x: F.length(x).cast("long") + 1)).cast("array<int>"))


def location_span(text: Column, start_line: Column, start_col: Column, end_line: Column, end_col: Column) -> Column:
    """Inclusive (line, column) pairs, from 1, to a half-open span; null if out of bounds."""
    starts = line_starts(text)
    s = F.get(starts, start_line - 1) + start_col - 1
    e = F.get(starts, end_line - 1) + end_col
    return F.when((s >= 0) & (s < e) & (e <= F.length(text)), F.struct(s.alias("start"), e.alias("end")))


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, end - start)


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty value."""
    n = F.length(value).cast("double")
    count = lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))).cast("double")
    total = F.aggregate(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")), F.lit(0.0), lambda a, c: a - count(c) / n * F.log2(count(c) / n))
    return F.when(n > 0, total).otherwise(F.lit(0.0))


def degenerate_hex(value: Column) -> Column:
    """Whether a hex string has too few characters or too little entropy to be a real hash."""
    return (F.size(F.array_distinct(F.split(value, ""))) < 6) | (entropy(value) < 3.0)


def shape(value: Column) -> Column:
    """class:length:entropy bucket of a value."""
    full = lambda chars: value.rlike(rf"^[{chars}]+$")
    kind = F.when(value.rlike(P.VENDOR_PREFIX), "vendor").when(full("0-9a-f"), "hexlo").when(full("0-9A-F"), "hexup").when(full("0-9"), "digits").when(full(r"A-Za-z0-9+/=_\-."), "b64ish").otherwise("mixed")
    size = F.when(F.length(value) < 20, "s").when(F.length(value) < 40, "m").otherwise("l")
    # fixed values: the cuts of length and entropy
    bits = F.when(entropy(value) < 3.0, "lo").when(entropy(value) < 4.2, "md").otherwise("hi")
    return F.when(F.coalesce(F.length(value), F.lit(0)) == 0, "empty").otherwise(F.concat_ws(":", kind, size, bits))


def value_class(value: Column) -> Column:
    """What kind of thing a flagged value is."""
    v = F.trim(F.btrim(F.trim(F.coalesce(value, F.lit(""))), F.lit("'\"`")))
    low = F.lower(v)
    out = F.when(v == "", "empty")
    placeholder = F.lit(False)
    for part in P.PLACEHOLDER_PARTS:
        placeholder = placeholder | F.contains(low, F.lit(part))
    key = F.startswith(v, F.lit("-----BEGIN")) | (F.contains(v, F.lit("BEGIN")) & (F.contains(v, F.lit("KEY")) | F.contains(v, F.lit("CERTIFICATE"))))
    out = out.when(placeholder, "placeholder/example/redacted").when(key, "private_key/cert_material")
    for name, pattern in P.VALUE_CLASSES:
        out = out.when(has(v, pattern), name)
    out = out.when(v.rlike(P.HEX_BLOB) & F.length(v).isin(*P.HASH_LENGTHS), F.concat(F.lit("hex_hash/checksum(len"), F.length(v).cast("string"), F.lit(")")))
    out = out.when(v.rlike(P.ENV_NAME), "env_var_name(no_value)").when(has(v, P.NUMERIC_ID), "numeric_id")
    return out.when(v.rlike(P.BASE64_BLOB) & (F.length(v) >= 24), "base64/hex_blob").when(F.length(v) >= 16, "high_entropy_other").otherwise("short/other")


@F.pandas_udf(StringType())
def _masked(text: pd.Series, starts: pd.Series, ends: pd.Series, mark: pd.Series) -> pd.Series:
    out = []
    for t, begin, end, m in zip(text, starts, ends, mark, strict=True):
        if t is None or begin is None or end is None or not len(begin):
            out.append(t)
            continue
        parts, at = [], 0
        last, stop = 0, -1  # the joined span that is open
        for s, e in sorted(zip(map(int, begin), map(int, end), strict=True)):
            if s < stop:
                stop = max(stop, e)
                continue
            if stop >= 0:
                parts += [t[at:last], m]
                at = stop
            last, stop = s, e
        out.append("".join([*parts, t[at:last], m, t[stop:]]))
    return pd.Series(out, dtype="object")


def mask(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each span (array of structs start, end) replaced, in one pass; spans that overlap are joined first, so
    that a mark never cuts another. The spans of one pattern need none of this: mask_matches."""
    field = lambda name: F.transform(spans, lambda s: s[name].cast("int"))
    return _masked(text, field("start"), field("end"), F.lit(mark))


def mask_matches(text: Column, pattern: str, mark: str = "[SECRET]") -> Column:
    """text with each match of pattern replaced, without a Python function."""
    return F.regexp_replace(text, F.lit(UNICODE + pattern), F.lit(re.sub(r"([\\$])", r"\\\1", mark)))


def context(text: Column, line: Column, around: int) -> Column:
    """The lines from `around` before a line to `around` after it."""
    first = F.greatest(line - around, F.lit(1))
    return F.array_join(F.slice(F.split(text, "\n"), first, line + around - first + 1), "\n")


def repo_name(url: Column) -> Column:
    """owner/name of a repository url, lower-cased; a trailing .git goes (only there)."""
    clean = F.regexp_replace(F.rtrim(F.trim(url), F.lit("/")), r"\.git$", "")
    tail = F.regexp_extract(clean, r"([^/]+/[^/]+)$", 1)
    return F.lower(F.when(tail != "", tail).otherwise(clean))


def quoted(url: Column) -> Column:
    """Percent-encoded, but for letters, digits and _ . - ~ /."""
    out = F.url_encode(url)
    for have, want in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(have), F.lit(want))
    return out


def file_kind(path: Column) -> Column:
    """Kind of a source file by its extension; null for others."""
    kinds = F.create_map(*[F.lit(x) for kv in P.EXTENSIONS.items() for x in kv])
    return F.try_element_at(kinds, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))
