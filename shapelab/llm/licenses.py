"""License scans: phrases, and an exact set-similarity join with notice templates.

A text block is a run of SPAN words, one every STEP words, so that each run of SPAN - STEP + 1 words, which is more
than a template has, lies whole in a block, however its lines are wrapped. A template is found in a block that has
at least CONTAINS of the template's distinct words. Blocks with fewer template words than any template needs go at
once (length). The words of the templates are ordered by their frequency over the blocks left, rarest first. A block
that misses the first |T| - need + 1 of a template's words cannot reach it (prefix), nor can one with fewer template
words than needed (length), nor one whose words before and after a shared one are too few (position); what is left
is verified on the whole sets. Texts are read and cut into words once; what is kept of them are counts and, of blocks
that may hold a template, the template words. All of it is DataFrame expressions; only the counts of the templates'
own words reach the driver.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows get equal rows; a null
doc_id stays null; a text of any length is so many blocks. score is 1 with a base phrase, else the largest containment
found, else 0. Other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, documents, text_of, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words of a lower-cased text, as a class of what they hold, which the JVM's matcher takes far faster.
RUN = r"[0-9a-z\x{80}-\x{10FFFF}]++"
CONTAINS = 0.8
#: Words of a block, and words between the starts of two.
SPAN, STEP = 64, 32

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Sentences of well-known public notices and their labels.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]


def template_words() -> list[tuple[str, list[str], int]]:
    """(label, distinct words, how many of them a block needs)."""
    out = []
    for label, text in TEMPLATES:
        words = sorted(set(re.findall(WORD, text.lower())))
        out.append((label, words, math.ceil(CONTAINS * len(words) - 1e-9)))
    return out


def words_of(text: Column) -> Column:
    """The words of a text with A-Z in lower case: lower() with the one other letter that it would turn into a-z set apart."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e5"))), F.lit(RUN), F.lit(0))


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (of the text), n_words, n_base, first_word, last_word, base (labels) and blocks, an array of (block, words).

    A block has the distinct template words of its run, and is kept if they are as many as some template needs."""
    need = template_words()
    vocabulary = _strings(sorted({w for _, words, _ in need for w in words}))
    least = min(n for _, _, n in need)
    # a text without one of the longest |T| - need + 1 words of a template has no block with it
    some = _strings(sorted({w for _, words, n in need for w in sorted(words, key=lambda w: (-len(w), w))[: len(words) - n + 1]}))
    starts = _strings(sorted({p.split()[0] for p in PHRASES}))
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("words"))
    first = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("words") - STEP) / STEP).cast("int"), F.lit(1)) - 1)
    cut_ = F.transform(first, lambda k: F.struct(k.alias("block"), F.array_intersect(F.slice("words", k * STEP + 1, SPAN), vocabulary).alias("words")))
    blocks = F.when(F.arrays_overlap("words", some), F.filter(cut_, lambda b: F.size(b["words"]) >= least))
    # every word stands between spaces of its own, so that a phrase may begin right after another one
    spaced = F.when(F.arrays_overlap("words", starts), F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))).otherwise("")
    d = d.select("doc_id", "h", F.size("words").cast("long").alias("n_words"), spaced.alias("spaced"), blocks.alias("blocks"))
    count = lambda part: ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("long")
    n, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        mark = " " + phrase.replace(" ", "  ") + " "
        parts = F.split("spaced", mark, -1)
        k = F.when(F.contains("spaced", F.lit(mark)), F.size(parts) - 1).otherwise(0)
        n.append(k)
        firsts.append(F.when(k > 0, count(parts[0])))
        lasts.append(F.when(k > 0, F.col("n_words") - count(F.element_at(parts, -1)) - len(phrase.split())))
        labels.append(F.when(k > 0, F.lit(label)))
    return d.select("doc_id", "h", "n_words", sum(n[1:], n[0]).cast("long").alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), F.array_compact(F.array(*labels)).alias("base"), "blocks")


def template_matches(found: DataFrame) -> DataFrame:
    """doc_id, h, block, label and containment of every block of `scan` that holds a template."""
    spark = found.sparkSession
    b = found.where(F.size("blocks") > 0).select("doc_id", "h", F.explode("blocks").alias("b")).select("doc_id", "h", "b.block", "b.words")
    counts = b.select(F.explode("words").alias("w")).groupBy("w").count()
    often = {r[0]: r[1] for r in counts.collect()}  # at most the templates' own words
    order = {w: k for k, w in enumerate(sorted({w for _, words, _ in template_words() for w in words}, key=lambda w: (often.get(w, 0), w)))}
    prefixes, sets = [], []
    for t, (label, words, need) in enumerate(template_words()):
        ordered = sorted(words, key=order.__getitem__)
        sets.append((t, label, words, need))
        prefixes += [(w, t, place, len(words), need) for place, w in enumerate(ordered[: len(words) - need + 1])]
    index = F.broadcast(spark.createDataFrame(prefixes, "word string, template int, place int, size int, need int"))
    whole = F.broadcast(spark.createDataFrame(sets, "template int, label string, t_words array<string>, t_need int"))
    rank = F.create_map(*[F.lit(x) for w, k in order.items() for x in (w, k)])
    near = b.where(F.arrays_overlap("words", _strings(sorted({p[0] for p in prefixes}))))
    ranked = near.withColumn("sorted", F.array_sort(F.transform("words", lambda w: F.struct(rank[w].alias("k"), w.alias("w")))))
    hits = ranked.select("doc_id", "h", "block", "words", F.posexplode("sorted").alias("at", "own")).join(index, F.col("own.w") == F.col("word"))
    hits = hits.where((F.size("words") >= F.col("need")) & (F.least("place", "at") + F.least(F.col("size") - F.col("place"), F.size("words") - F.col("at")) >= F.col("need")))
    hits = hits.select("doc_id", "h", "block", "words", "template").distinct().join(whole, "template")
    both = F.size(F.array_intersect("words", "t_words"))
    return hits.where(both >= F.col("t_need")).select("doc_id", "h", "block", "label", (both / F.size("t_words")).alias("containment"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    base = written(scan(docs, id_col, text_col))
    own = template_matches(base).groupBy(F.col("doc_id").alias("i"), F.col("h").alias("g")).agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"))
    out = base.drop("blocks").join(own, F.expr("doc_id <=> i and h = g"), "left")
    everything = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(everything, ",").alias("labels"), score.alias("score"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir))


def _sql() -> str:
    words = "regexp_extract_all(translate({}, '" + UPPER + "', '" + LOWER + "'), '" + WORD + "')"
    phrases = " union all ".join(f"select {len(p.split())} as k, {p.split()!r} as p, '{g}' as label" for p, g in PHRASES.items())
    templates = " union all ".join(f"select '{g}' as label, {w!r} as t, {n} as need" for g, w, n in template_words())
    return f"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as r from documents),
w as (select r, doc_id, {words.format("text")} as w from d),
phrases as ({phrases}), templates as ({templates}),
places as (select r, label, i from (select r, w, label, p, k, unnest(range(1, len(w) + 1)) as i from w, phrases) where w[i:i + k - 1] = p),
base as (select r, count(*) as n, min(i) - 1 as a, max(i) - 1 as b, list(distinct label) as labels from places group by r),
blocks as (select r, list_distinct(w[i * {STEP} + 1:i * {STEP} + {SPAN}]) as b from (select r, w, unnest(range(0, greatest(1, cast(ceil((len(w) - {STEP}) / {STEP}) as bigint)))) as i from w)),
own as (select r, list(distinct label) as labels, max(c) as best from (select r, label, need, len(list_intersect(b, t)) as n, len(list_intersect(b, t)) / len(t) as c from blocks, templates) where n >= need group by r)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(base.n, 0) as bigint) as n_base, cast(base.a as bigint) as first_word, cast(base.b as bigint) as last_word,
 coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') as labels,
 cast(case when base.n > 0 then 1.0 else coalesce(own.best, 0.0) end as double) as score
from w left join base using (r) left join own using (r)"""


SQL = _sql()
