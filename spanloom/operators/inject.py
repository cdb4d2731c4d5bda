"""Planting synthetic secrets in clean texts, with exact gold spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

def _byte(seed: Column, salt: str, k: Column) -> Column:
    """The k-th of 64 bytes drawn by hashing a seed."""
    digest = F.concat(*[F.sha2(F.concat_ws("|", F.lit(salt), F.lit(str(part)), seed), 256) for part in (0, 1)])
    return F.conv(F.substr(digest, k * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _chars(seed: Column, n: Column, alphabet: str, salt: str) -> Column:
    """n characters, 64 at most, of an alphabet."""
    one = lambda k: F.substr(F.lit(alphabet), _byte(seed, salt, k) % len(alphabet) + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), one), "")


def value_of(family: Column, seed: Column) -> Column:
    """A synthetic secret of a family (one of patterns.FAMILIES): a password of 14 to 24 characters, an API key of 32 to 40,
    a high-entropy string of 40, or a basic-auth header."""
    size = lambda least, most: F.lit(least) + _byte(seed, "n", F.lit(0)) % (most - least + 1)
    user = F.concat(F.lit("svc_"), _chars(seed, F.lit(4), P.DIGITS, "user"), F.lit(":"), _chars(seed, F.lit(16), P.ALNUM, "pass"))
    basic = F.concat(F.lit("Basic "), F.base64(user.cast("binary")))
    out = F.when(family == P.FAMILIES[0], _chars(seed, size(14, 24), P.ALNUM + P.SYMBOLS, "pw")).when(family == P.FAMILIES[1], _chars(seed, size(32, 40), P.ALNUM, "key"))
    return out.when(family == P.FAMILIES[2], _chars(seed, F.lit(40), P.ALNUM + P.BASE64_SYMBOLS, "he")).otherwise(basic)


def inject(docs: DataFrame, seed: str = "0", first_lines: int = 60, kind: Column | None = None) -> DataFrame:
    """doc_id, text, start, end, line, value, type: each text with one line more, behind the last of its first lines
    that assigns something, in the form of its kind of file (a column; without one, as in Python). The label leaves the
    scheme word of a basic-auth header out."""
    n = F.pmod(F.col("doc_id"), F.lit(len(P.FAMILIES))).cast("int")
    family = F.get(F.array(*[F.lit(f) for f in P.FAMILIES]), n)
    name = F.get(F.array(*[F.lit(k) for k in P.FAMILY_KEYS]), n)
    kind = F.lit("py") if kind is None else kind
    name = F.when(kind.isin(*P.UPPER_KEYS), F.upper(name)).otherwise(name)
    form = F.lit(P.INJECTED_LINES["py"])
    for k, v in P.INJECTED_LINES.items():
        form = F.when(kind == k, F.lit(v)).otherwise(form)
    value = value_of(family, F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))
    lines = F.split("text", "\n")
    assigns = lambda x: x.rlike(r"[:=]\s*\S") & ~F.trim(x).rlike(r"^(#|//|\*)")
    marked = F.transform(F.slice(lines, 1, first_lines), lambda x, k: F.when(assigns(x), k))
    anchor = F.coalesce(F.array_max(F.filter(marked, lambda k: k.isNotNull())), F.lit(0))
    t = docs.select("doc_id", lines.alias("lines"), (anchor + 1).alias("at"), family.alias("type"), name.alias("name"), value.alias("whole"), form.alias("form"))
    label = F.when(F.col("type") == P.FAMILIES[3], F.substr(F.col("whole"), F.lit(7))).otherwise(F.col("whole"))
    line = F.replace(F.replace("form", F.lit("{K}"), F.col("name")), F.lit("{V}"), F.col("whole"))
    t = t.select("doc_id", "lines", "at", "type", label.alias("value"), line.alias("line_text"), F.concat(F.array_join(F.slice("lines", 1, F.col("at")), "\n"), F.lit("\n")).alias("head"))
    start = F.length("head") + F.instr("line_text", F.col("value")) - 1
    tail = F.slice("lines", F.col("at") + 1, F.greatest(F.size("lines") - F.col("at"), F.lit(0)))
    text = F.concat("head", F.array_join(F.concat(F.array("line_text"), tail), "\n"))
    return t.select("doc_id", text.alias("text"), start.alias("start"), (start + F.length("value")).alias("end"), (F.col("at") + 1).alias("line"), "value", "type")
