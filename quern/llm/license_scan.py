"""Licence notices in whole texts, with DataFrame functions only.

Two ways of finding them, side by side:

* *phrases*: places where a phrase's words stand one after the other, found by one regular expression;
* *templates*: an exact set-similarity join of text blocks with licence templates, short forms and full notices.  Blocks
  are the lines and, for notices that wrap, the words around each line end: of a template of w words the w - 1 before and
  the w - 1 after it, over further line ends.  Token sets are put in order of global frequency, rarest first.  A block
  that contains at least ``percent`` of a template's tokens must hold one of its first ``n - t + 1`` (prefix filter), must
  have enough template tokens at all (length filter), and from the place of the first common token on both sets must have
  enough left (positional filter).  What is left is verified by intersecting the sets.  Every template that a block holds
  is reported in ``matches``; of those a label is given but for one whose common tokens a fuller one of the same block has
  all in common with it.

Texts are read and cut into words once: words, phrases and blocks of template tokens come from one pass and are kept.  A
document that as a whole holds too few tokens of every template has no such block and isn't cut into blocks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.arrays import let
from quern.llm.blocks import documents, durable


PERCENT = 80

#: Phrases and their labels, which the base columns report.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: Notices that the similarity join looks for, each with its label: the usual short forms, then full notices.
TEMPLATES = [
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version of the License, or (at your option) any later version."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]

_WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: What stands between lower-case words.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _sized(templates: list[tuple[str, str]]) -> list[tuple[str, list[str], int]]:
    """Label, distinct words and number of words of each template."""
    return [(label, sorted(set(w)), len(w)) for label, t in templates for w in [re.findall("[0-9a-z]+", t.lower())]]


def _pattern(phrase: str) -> str:
    return f"(?<!{_WORD})" + f"{_GAP}+".join(phrase.split()) + f"(?!{_WORD})"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _split(text: Column) -> Column:
    """Lower-case words, maybe with an empty one at either end; the Kelvin sign, whose lower case would be an ASCII letter, stays what it is."""
    return F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("é"))), _BETWEEN)


def _number(words: Column) -> Column:
    """How many words a split has."""
    empty = lambda i: F.when(F.element_at(words, i) == "", 1).otherwise(0)
    return (F.when(F.size(words) > 1, F.size(words) - empty(1) - empty(-1)).otherwise(F.size(words) - empty(1))).cast("long")


def _around_ends(lines: Column, sizes: list[int]) -> Column:
    """For each line end between words and each size: ``words, tokens`` of up to ``size - 1`` words before and after it."""
    found = F.filter(F.transform(lines, lambda x: F.filter(_split(x), lambda w: w != "")), lambda x: F.size(x) > 0)

    def cut(ls: Column) -> Column:
        words = F.flatten(ls)
        number = F.flatten(F.transform(ls, lambda x, i: F.array_repeat(i, F.size(x))))  # each word's line
        ends = let(number, lambda n: F.filter(F.transform(n, lambda v, i: F.when((i > 0) & (F.get(n, i - 1) != v), i)), lambda e: e.isNotNull()))

        def around(w: Column, e: Column, size: Column) -> Column:
            first = F.greatest(e - (size - 1), F.lit(0))
            return F.struct(size.alias("words"), F.slice(w, first + 1, e - first + size - 1).alias("tokens"))

        each = F.array(*map(F.lit, sizes))
        return let(words, lambda w: F.flatten(F.transform(ends, lambda e: F.transform(each, lambda size: around(w, e, size)))))

    return let(found, cut)


def _blocks(text: Column, vocabulary: list[str], wanted: list[tuple[str, list[str], int, int]]) -> Column:
    """Blocks that hold enough template tokens: ``words, tokens`` (distinct template tokens), each such pair once.

    ``words`` is null for lines, and for words around a line end the size of the templates they are meant for.
    """
    known = F.array(*map(F.lit, vocabulary))
    lines = F.split(text, r"[\r\n]+")
    single = F.transform(lines, lambda x: F.struct(F.lit(None).cast("int").alias("words"), _split(x).alias("tokens")))
    every = F.concat(single, _around_ends(lines, sorted({w for *_, w in wanted})))
    own = F.transform(every, lambda b: F.struct(b["words"].alias("words"), F.array_intersect(known, b["tokens"]).alias("tokens")))
    least = min(need for *_, need, _ in wanted)
    return F.array_distinct(F.filter(own, lambda b: F.size(b["tokens"]) >= least))


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, matches, score``.

    ``matches`` names the label of every template that a block holds and its greatest share in per cent (``gpl-3:100,
    lgpl:90``); ``labels`` are the phrases' and those of ``matches`` that aren't only a lesser likeness of a fuller
    template in the same block. ``score`` is 1 where a phrase stands, else the greatest share of a template's tokens in
    a block, from ``percent`` on, else 0. A null text is the empty text (0 words, no labels); a null id is kept; equal rows
    give equal rows; an empty table an empty result. Extra columns are ignored; whole texts are searched, however long.
    """
    wanted = [(label, t, -(-percent * len(t) // 100), words) for label, t, words in _sized(templates)]
    vocabulary = sorted({w for _, t, *_ in wanted for w in t})
    t = F.col("text")
    bodies = F.array(*[F.struct(F.array(*map(F.lit, own)).alias("body"), F.lit(need).alias("need")) for _, own, need, _ in wanted])
    enough = lambda v: F.exists(bodies, lambda b: F.size(F.array_intersect(v, b["body"])) >= b["need"])
    facts = let(_split(t), lambda w: F.struct(_number(w).alias("n_words"), let(F.array_intersect(F.array(*map(F.lit, vocabulary)), w), enough).alias("enough")))
    any_phrase = "(?:" + "|".join(_pattern(p) for p, _ in phrases) + ")"
    insensitive = "(?i)" + any_phrase
    has = F.col("has")
    before = lambda quantifier: F.regexp_extract(t, f"(?is)^(.{quantifier}){any_phrase}", 1)
    words = f"{_WORD}+"
    labels = F.array_sort(F.filter(F.array(*[F.when(t.rlike("(?i)" + _pattern(p)), F.lit(label)) for p, label in phrases]), lambda x: x.isNotNull()))
    none = F.array().cast("array<string>")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    read = own.select("doc_id", "text", t.rlike(insensitive).alias("has"), facts.alias("facts"))
    scanned = durable(
        read.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "facts.n_words",
            F.when(has, _count(t, insensitive)).otherwise(F.lit(0).cast("long")).alias("n_base"),
            F.when(has, _count(before("*?"), words)).alias("first_word"),
            F.when(has, _count(before("*"), words)).alias("last_word"),
            F.when(has, F.array_distinct(labels)).otherwise(none).alias("base"),
            F.when(F.col("facts.enough"), _blocks(t, vocabulary, wanted)).alias("blocks"),
        )
    )
    kept = scanned.select("row", F.explode("blocks").alias("b")).select("row", "b.words", "b.tokens")
    # global frequencies of the templates' tokens: as many rows as the templates have tokens
    counted = dict(kept.select(F.explode("tokens").alias("t")).groupBy("t").count().collect())
    order = sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index, sets = [], []
    for i, (label, own_tokens, need, size) in enumerate(wanted):
        ordered = sorted(own_tokens, key=rank.get)
        index += [(w, i, label, j, len(ordered), need, size) for j, w in enumerate(ordered[: len(ordered) - need + 1])]
        sets.append((i, ordered))
    spark = docs.sparkSession
    prefixes = F.broadcast(spark.createDataFrame(index, "token string, template int, label string, at int, n int, need int, size int"))  # a constant of this module
    whole = F.broadcast(spark.createDataFrame(sets, "template int, body array<string>"))
    blocks = kept.withColumn("tokens", F.array_intersect(F.array(*map(F.lit, order)), "tokens")).withColumn("m", F.size("tokens"))
    probes = blocks.select("*", F.posexplode("tokens").alias("pos", "token"))
    candidates = (
        probes.join(prefixes, "token")
        .where(F.col("m") >= F.col("need"))
        .groupBy("row", "words", "tokens", "m", "template", "label", "n", "need", "size")
        .agg(F.min(F.struct("at", "pos")).alias("first"))
        .where(F.least(F.col("n") - F.col("first.at"), F.col("m") - F.col("first.pos")) >= F.col("need"))
    )
    found = candidates.join(whole, "template").withColumn("common", F.array_intersect("tokens", "body")).where(F.size("common") >= F.col("need"))
    # a notice contains much of its relatives' templates too: those get no label whose common tokens a fuller (then longer) one has as well
    held = found.groupBy("row", "words", "tokens").agg(F.collect_list(F.struct((F.size("common") / F.col("n")).alias("share"), "n", "label", "common", "size")).alias("held"))
    key = lambda x: F.struct(x["share"], x["n"], x["label"])
    covers = lambda y, x: (key(y) > key(x)) & (F.size(F.array_except(x["common"], y["common"])) == 0)
    meant = F.filter("held", lambda x: F.col("words").isNull() | (x["size"] == F.col("words")))
    judged = F.transform(meant, lambda x: F.struct(x["label"].alias("label"), x["share"].alias("share"), F.floor(F.size(x["common"]) * 100 / x["n"]).cast("long").alias("percent"), (~F.exists("held", lambda y: covers(y, x))).alias("own")))
    each = held.select("row", F.explode(judged).alias("m")).groupBy("row", "m.label").agg(F.max("m.share").alias("share"), F.max("m.percent").alias("percent"), F.max("m.own").alias("own"))
    matched = F.array_sort(F.collect_list(F.concat("label", F.lit(":"), F.col("percent").cast("string"))))
    per_row = each.groupBy("row").agg(F.collect_list(F.when(F.col("own"), F.col("label"))).alias("found"), matched.alias("matches"), F.max("share").alias("share"))
    joined = scanned.drop("blocks").join(per_row, "row", "left")
    all_labels = F.array_sort(F.array_union("base", F.coalesce("found", none)))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"), F.array_join(F.coalesce("matches", none), ",").alias("matches"), score.alias("score"))


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def _oracle() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sized = _sized(TEMPLATES)
    rows = ", ".join(f"({i}, '{label}', string_split('{' '.join(t)}', ' '), {size})" for i, (label, t, size) in enumerate(sized))
    sizes = ", ".join(map(str, sorted({size for *_, size in sized})))
    phrases = [(p.replace(" ", "', '"), label, len(p.split())) for p, label in PHRASES]
    places = " UNION ALL ".join(f"SELECT doc_id, k - 1 AS k, '{label}' AS label FROM words, range(1, len(w) - {n} + 2) r(k) WHERE w[k:k + {n - 1}] = ['{p}']" for p, label, n in phrases)
    split = lambda x: f"list_filter(regexp_split_to_array({x}, '{_BETWEEN}'), lambda x: x <> '')"
    enough = f"100 * len(list_intersect(b, body)) >= {PERCENT} * len(body)"
    return f"""
WITH words AS (SELECT doc_id, {split(lower)} AS w FROM documents),
places AS ({places}),
base AS (SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
templates AS (SELECT i, label, body, size, len(body) AS n FROM (VALUES {rows}) t(i, label, body, size)),
likely AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, list_distinct(w) AS b FROM words), templates WHERE {enough}),
numbered AS (SELECT doc_id, unnest(regexp_split_to_array({lower}, '[\r\n]+')) AS line, generate_subscripts(regexp_split_to_array({lower}, '[\r\n]+'), 1) AS i FROM documents WHERE doc_id IN (SELECT doc_id FROM likely)),
lines AS (SELECT doc_id, i, {split('line')} AS w FROM numbered),
ends AS (SELECT doc_id, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) - len(w) AS e FROM lines WHERE len(w) > 0 QUALIFY e > 0),
around AS (SELECT doc_id, size, greatest(CAST(e AS BIGINT) - (size - 1), 0) AS a, CAST(e AS BIGINT) + size - 1 AS z FROM ends, (SELECT unnest([{sizes}]) AS size)),
blocks AS (SELECT doc_id, NULL AS size, list_distinct(w) AS b FROM lines UNION ALL SELECT doc_id, size, list_distinct(w[a + 1:z]) FROM around JOIN words USING (doc_id)),
found AS (SELECT k, doc_id, label, n, x.size IS NULL OR x.size = t.size AS meant, list_intersect(b, body) AS common FROM (SELECT *, row_number() OVER () AS k FROM blocks) x JOIN templates t ON {enough}),
shares AS (SELECT *, len(common) / n AS share FROM found),
judged AS (SELECT doc_id, label, share, len(common) * 100 // n AS pct, NOT EXISTS (SELECT 1 FROM shares y WHERE y.k = x.k AND (y.share, y.n, y.label) > (x.share, x.n, x.label) AND len(list_intersect(x.common, y.common)) = len(x.common)) AS own FROM shares x WHERE meant),
each AS (SELECT doc_id, label, max(share) AS share, max(pct) AS pct, bool_or(own) AS own FROM judged GROUP BY ALL),
method AS (SELECT doc_id, list(label) FILTER (own) AS labels, array_to_string(list_sort(list(label || ':' || pct)), ',') AS matches, max(share) AS share FROM each GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(b.n_base, 0) AS BIGINT) AS n_base, CAST(b.first_word AS BIGINT) AS first_word,
  CAST(b.last_word AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
  coalesce(m.matches, '') AS matches, CAST(CASE WHEN b.n_base > 0 THEN 1.0 ELSE coalesce(m.share, 0.0) END AS DOUBLE) AS score
FROM documents d JOIN words w USING (doc_id) LEFT JOIN base b USING (doc_id) LEFT JOIN method m USING (doc_id)
"""


ORACLE_SQL = _oracle()
