"""Licence scans with a positional index of rare words, with DataFrame operations alone.

Each licence template is a sequence of words with a mandatory key phrase in it: a notice, a paragraph of the licence's
own text, or a line that names it. Document frequencies of the key phrases' telling words over all documents give
their IDF. A file's licence words (with their positions) tell which templates it has all key words of; for each
of these it looks up, of its words, the one of highest IDF. The posting (template, position in the template) and the
word's position in the file give the place where the template would start. There the posting of the next rarest
word is intersected (it must stand at its own relative position), the key phrase is verified word by word, and all
other words of the template are compared at their places. The share that agrees is the score; a template counts from
LEAST on. One pass over the texts keeps the licence words of each and, of those files that have all key words of
some template, all words; the rest happens within the rows of that table, without a shuffle.

Defined results: a null text is an empty one, with no words; null and repeated doc_ids are rows like any
other; an empty table gives no rows; texts of any length are scanned whole, with memory in proportion to the
longest text alone; other columns, whatever their names, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Words of a text whose A-Z are not lower-cased yet; lower-casing A-Z afterwards gives the same words.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: phrase, the place in it of the word it is found by, label
BASE = (("cc by", 0, "cc-by"), ("general public license", 0, "gpl"), ("all rights reserved", 1, "reserved"))
#: label, template, key phrase
TEMPLATES = (
    ("cc-by", "cc by", "cc by"),
    ("gpl", "general public license", "general public license"),
    ("reserved", "all rights reserved", "all rights reserved"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 international"),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "contributors may be used to endorse or promote products"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("boost-1.0", "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
)
#: Words too common to find a phrase by.
COMMON = frozenset("a all and any as be by for free in into is it may not of on or public the this to use used with you v 0 1 2 3 4".split())
LEAST = 0.5  # share of a template's words that stand at their places

KEY_WORDS = sorted({w for _, _, phrase in TEMPLATES for w in phrase.split()} - COMMON)


def _key_at(template: str, phrase: str) -> int:
    words, key = template.split(), phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def _is(at: Column, word: Column) -> Column:
    """Whether a word of the text, from 0, is the given one; false beyond the text's ends."""
    return F.coalesce(ascii_lower(F.get("words", at)) == word, F.lit(False))


def _stands(off: int, word: str):
    return lambda h: _is(h["pos"] + off, F.lit(word))


def _telling(phrase: str) -> list[str]:
    return sorted({w for w in phrase.split() if w not in COMMON})


def licence_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, have (its distinct key words), and, where these are all of some template's, words and hits
    (pos, word: each place of a key word)."""
    words = docs.select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("words"))
    # each step passes on what it is computed from, so that none is computed within a loop of the next
    places = F.filter(F.transform("words", lambda w, i: F.when(F.lower(w).isin(KEY_WORDS), i)), lambda i: i.isNotNull())
    rows = words.select("doc_id", "words", places.alias("places"))
    hits = F.filter(F.transform("places", lambda i: F.struct(i.alias("pos"), ascii_lower(F.get("words", i)).alias("word"))), lambda h: h["word"].isin(KEY_WORDS))
    rows = rows.select("doc_id", "words", "places", hits.alias("hits"))
    rows = rows.select("doc_id", "words", "hits", F.array_distinct("hits.word").alias("have"))
    needs = F.array(*[F.array(*map(F.lit, n)) for n in sorted({tuple(_telling(phrase)) for _, _, phrase in TEMPLATES})])
    some = F.exists(needs, lambda n: F.size(F.array_except(n, F.col("have"))) == 0)
    rows = rows.select("doc_id", "words", "hits", "have", some.alias("some"))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "have", F.when(F.col("some"), F.col("words")).alias("words"), F.when(F.col("some"), F.col("hits")).alias("hits"))


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = written(licence_words(docs), "licence-words")
    per_word = rows.select(F.explode("have").alias("word")).groupBy("word").count()
    in_docs = {r["word"]: r["count"] for r in per_word.collect()}  # a row for each of KEY_WORDS at most

    # per template: its words, its key phrase's place and telling words, and where the two rarest of these stand
    known = []
    for label, template, phrase in TEMPLATES:
        at, key = _key_at(template, phrase), phrase.split()
        rare = sorted(_telling(phrase), key=lambda w: (in_docs.get(w, 0), w))
        first, second = rare[0], rare[1 % len(rare)]
        fields = {"label": F.lit(label), "words": F.array(*map(F.lit, template.split())), "at": F.lit(at), "n_key": F.lit(len(key)), "needs": F.array(*map(F.lit, rare)), "rare": F.lit(first), "rare_at": F.lit(at + key.index(first)), "next": F.lit(second), "next_at": F.lit(at + key.index(second))}
        known.append(F.struct(*[v.alias(k) for k, v in fields.items()]))
    known = F.array(*known)

    rows = rows.withColumn("open", F.filter(known, lambda t: F.size(F.array_except(t["needs"], F.col("have"))) == 0))
    looked = F.flatten(F.transform("open", lambda t: F.transform(F.filter("hits", lambda h: h["word"] == t["rare"]), lambda h: F.struct(t.alias("t"), (h["pos"] - t["rare_at"]).alias("start")))))
    agreed = F.filter(looked, lambda x: _is(x["start"] + x["t"]["next_at"], x["t"]["next"]) & F.forall(F.sequence(F.lit(0), x["t"]["n_key"] - 1), lambda k: _is(x["start"] + x["t"]["at"] + k, F.get(x["t"]["words"], x["t"]["at"] + k))))
    rows = rows.select("doc_id", "n_words", "words", "hits", "open", agreed.alias("agreed"))
    same = lambda x: F.size(F.filter(F.sequence(F.lit(0), F.size(x["t"]["words"]) - 1), lambda k: _is(x["start"] + k, F.get(x["t"]["words"], k))))
    verified = F.transform("agreed", lambda x: F.struct(x["t"]["label"].alias("label"), (same(x) / F.size(x["t"]["words"]).cast("double")).alias("score")))

    def base_places(phrase: str, by: int, label: str) -> Column:
        matched = F.filter("hits", lambda h: h["word"] == phrase.split()[by])
        for k, w in enumerate(phrase.split()):
            matched = F.filter(matched, _stands(k - by, w))
        return F.transform(matched, lambda h: F.struct((h["pos"] - by).cast("long").alias("at"), F.lit(label).alias("label")))

    base = F.coalesce(F.concat(*[base_places(*b) for b in BASE]), F.array().cast("array<struct<at:long,label:string>>"))
    verified = F.coalesce(verified, F.array().cast("array<struct<label:string,score:double>>"))
    rows = rows.select("doc_id", "n_words", base.alias("base"), verified.alias("verified"))
    more = F.filter("verified", lambda v: v["score"] >= LEAST)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.at").alias("first_word"), F.array_max("base.at").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"), joined(F.concat("base.label", F.transform(more, lambda v: v["label"]))).alias("labels"), F.coalesce(F.array_max("verified.score"), F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    places, labels, scores = [], [], []
    for phrase, _, label in BASE:
        cond = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split()))
        places.append(f"list_transform(list_filter(range(len(w)), lambda i: {cond}), lambda i: {{'at': i, 'label': '{label}'}})")
    for label, template, phrase in TEMPLATES:
        words, key = template.split(), phrase.split()
        at = _key_at(template, phrase)
        cond = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(key))
        same = " + ".join(f"CASE WHEN i - {at} + {k} >= 0 AND w[greatest(i - {at} + {k + 1}, 1)] = '{x}' THEN 1 ELSE 0 END" for k, x in enumerate(words))
        score = f"CASE WHEN contains(s, ' {phrase} ') THEN list_max(list_transform(list_filter(range(len(w)), lambda i: {cond}), lambda i: {same})) / {float(len(words))}::DOUBLE ELSE 0.0::DOUBLE END"
        scores.append(f"{score} AS score{len(scores)}")
        labels.append(f"CASE WHEN score{len(labels)} >= {LEAST} THEN ['{label}'] ELSE [] END")
    flat = " || ".join
    pick = lambda x: f"array_to_string(list_sort(list_distinct({x})), ',')"
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), joined AS (
  SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM words
), found AS (
  SELECT doc_id, w, CASE WHEN contains(s, ' cc by ') OR contains(s, ' general public license ') OR contains(s, ' all rights reserved ') THEN {flat(places)} ELSE [] END AS b, {', '.join(scores)} FROM joined
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(b) AS BIGINT) AS n_base,
  CAST(list_min(list_transform(b, lambda x: x.at)) AS BIGINT) AS first_word, CAST(list_max(list_transform(b, lambda x: x.at)) AS BIGINT) AS last_word,
  coalesce({pick('list_transform(b, lambda x: x.label)')}, '') AS base_labels, coalesce({pick('list_transform(b, lambda x: x.label) || ' + flat(labels))}, '') AS labels, greatest({', '.join(f'score{k}' for k in range(len(scores)))}) AS score
FROM found"""
