"""Operator 3: license scan in native expressions only.

Base phrases are places in a text's word sequence.  The method is an exact
set-similarity join of text blocks (lines) with license templates: a block meets
a template if it holds at least ``threshold`` of the template's distinct words.

1. The templates' words are ordered by the number of blocks in the whole corpus
   that hold them, rarest first (the global order).
2. A template of n words needs k = ceil(threshold * n) of them, so each block that
   meets it holds one of the template's first n - k + 1 words: the *prefix*.
   Blocks that hold no prefix word leave the scan; the rest meet the templates
   by an equi-join on (prefix word).
3. *Length filter*: the block has at least k distinct words.
   *Positional filter*: at the first common prefix word, at place i of the template
   and j of the block's words in the global order, at most 1 + min(n - i, m - j)
   words can be common (m: the block's template words); this must reach k.
4. What is left is verified by the full intersection; and the words that tell the
   template from similar ones must be there, those of another license not.

Only the word counts (as many rows as the templates have words) pass the driver;
the templates' side has a row per template and prefix word, both fixed lists.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import text_key

#: Base phrases and their labels, in order.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: License notices as commonly written, and their labels; then the words that tell a
#: notice from the others (all must be there) and, after them, those of other licenses (none may be).
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved."),
    ("mit", "Released under the MIT License.", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu 3", "lesser affero"),
    ("gpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "commons attribution", "noncommercial sharealike noderivatives"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", "nc", "sa nd"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", "sa", "nc nd"),
]
THRESHOLD = 0.8
#: Everything that is no word character after A-Z have become a-z (fixed value).
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    """Distinct words of a template, by the same rule as the texts' words."""
    import re

    low = text.translate(str.maketrans(_UPPER, _LOWER))
    return sorted({w for w in re.split(NO_WORD, low) if w})


def with_marks(templates) -> list[tuple[str, list[str], list[str], list[str]]]:
    """(label, words, words that must be there, words that may not) of each template."""
    full = [(label, template_words(t), *(marks[k].split() if k < len(marks) else [] for k in (0, 1))) for label, t, *marks in templates]
    return [x for x in full if x[1]]


def normal(text: Column) -> Column:
    """The words with one blank before each and one at the end; a blank if there are none."""
    low = F.regexp_replace(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(F.translate(low, _UPPER, _LOWER)), F.lit(" "))


def n_words(norm: Column) -> Column:
    return F.when(norm == "  ", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "))) - 1).cast("long")


def places(norm: Column) -> Column:
    """array<struct<at, label>>: the word places of all base phrases, in order."""
    split = "(?=" + "|".join(f" {p} " for p, _ in PHRASES) + ")"
    parts = F.split(norm, split, -1)
    kind = "struct<at:long,out:array<struct<at:long,label:string>>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:long,label:string>>").alias("out")).cast(kind)
    label = lambda x: F.coalesce(*[F.when(F.startswith(x, F.lit(f" {p} ")) | (x == f" {p}"), name) for p, name in PHRASES])

    def step(acc: Column, x: Column) -> Column:
        # A part ends before the blank of the next place, so its blanks count its words.
        words = F.length(x["s"]) - F.length(F.replace(x["s"], F.lit(" ")))
        here = F.when(x["label"].isNotNull(), F.array(F.struct(acc["at"].alias("at"), x["label"].alias("label")))).otherwise(F.array().cast("array<struct<at:long,label:string>>"))
        return F.struct((acc["at"] + words).alias("at"), F.concat(acc["out"], here).alias("out")).cast(kind)

    # A phrase's words go on into the next part only where two phrases share words; none do.
    rows = F.transform(parts, lambda s: F.struct(s.alias("s"), label(s).alias("label")))
    none = F.array().cast("array<struct<at:long,label:string>>")
    return F.when(norm.rlike("|".join(f" {p} " for p, _ in PHRASES)), F.aggregate(rows, empty, step, lambda acc: acc["out"])).otherwise(none)


def global_order(blocks: DataFrame, words: list[str]) -> list[str]:
    """The templates' words, rarest first, by the number of blocks that hold them."""
    held = blocks.select(F.explode(F.array_intersect(F.split("norm", " "), F.array(*map(F.lit, words)))).alias("word"))
    n = dict(held.groupBy("word").count().collect())  # as many rows as the templates have words
    return sorted(words, key=lambda w: (n.get(w, 0), w))


def blocks_of(docs: DataFrame, id_column: str, text_column: str, key: bool = False) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    own = [text_key(text).alias("key")] if key else []
    return docs.select(*own, F.explode(F.split(text, "\n", -1)).alias("block")).select(*(["key"] if key else []), normal(F.col("block")).alias("norm"))


def template_matches(docs: DataFrame, templates=None, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """(key, label, containment): per text (by content key) and label, the best
    containment of a template in a block of the text, from ``threshold`` up."""
    spark = docs.sparkSession
    templates = with_marks(templates or TEMPLATES)
    vocabulary = sorted({w for _, *lists in templates for ws in lists for w in ws})
    order = global_order(blocks_of(docs, "", text_column), vocabulary)
    place = {w: i for i, w in enumerate(order)}
    postings, needs = [], []
    for t, (label, ws, must, never) in enumerate(templates):
        ws = sorted(ws, key=place.get)
        k = math.ceil(threshold * len(ws) - 1e-9)
        needs.append(k)
        postings += [(w, t, label, i + 1, len(ws), k, ws, must, never) for i, w in enumerate(ws[:len(ws) - k + 1])]
    prefix = sorted({p[0] for p in postings})
    index = spark.createDataFrame(postings, "word string, template int, label string, i int, n int, k int, words array<string>, must array<string>, never array<string>")
    quick = " (?:" + "|".join(prefix) + ") "
    some = blocks_of(docs, "", text_column, key=True).where(F.col("norm").rlike(quick))
    # The block's template words in the global order, and its number of distinct words.
    rows = some.select("key", F.array_intersect(F.array(*map(F.lit, order)), F.split("norm", " ")).alias("own"),
                       (F.size(F.array_distinct(F.split(F.trim("norm"), " ")))).alias("size"))
    probes = rows.select("key", "own", "size", F.posexplode("own").alias("j", "word"))
    pairs = probes.join(F.broadcast(index), "word")  # a fixed list of postings
    bound = F.least(F.col("n") - F.col("i"), F.size("own") - (F.col("j") + 1)) + 1
    # The first common prefix word alone speaks for the pair.
    first = F.array_position("own", F.element_at(F.array_intersect(F.slice("words", 1, F.col("n") - F.col("k") + 1), F.col("own")), 1)) == F.col("j") + 1
    kept = pairs.where(first & (F.col("size") >= F.col("k")) & (bound >= F.col("k")))
    common = F.size(F.array_intersect("words", "own"))
    told = (F.size(F.array_except("must", "own")) == 0) & ~F.arrays_overlap("never", "own")
    met = kept.where(told).select("key", "label", "k", "n", common.alias("common")).where(F.col("common") >= F.col("k"))
    return met.groupBy("key", "label").agg(F.max(F.col("common") / F.col("n")).alias("containment"))


def licenses(docs: DataFrame, templates=None, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (1 with a base place, else the best containment, else 0).

    A null or empty text has no words and no labels; a null id stays null;
    repeated rows stay; further columns are left out.  Blocks are lines, so a
    phrase across lines counts for the base alone.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_key(text).alias("key"), normal(text).alias("norm"))
    base = base.select("doc_id", "key", n_words(F.col("norm")).alias("n_words"), places(F.col("norm")).alias("base"))
    found = template_matches(docs, templates, threshold, text_column).groupBy("key").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    rows = base.join(found, "key", "left")
    labels = F.transform("base", lambda x: x["label"])
    text_of = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.get("base", F.lit(0))["at"].alias("first_word"),
        F.get("base", F.size("base") - 1)["at"].alias("last_word"), text_of(labels).alias("base_labels"),
        text_of(F.concat(labels, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"))


def oracle_sql() -> str:
    """The same by comparing each line with each template."""
    words = lambda t: f"list_filter(regexp_split_to_array(translate({t}, '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    as_list = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]::VARCHAR[]"
    ts = ", ".join(f"('{label}', {as_list(ws)}, {as_list(must)}, {as_list(never)})" for label, ws, must, never in with_marks(TEMPLATES))
    ps = ", ".join(f"('{label}', ['" + "', '".join(p.split()) + "'])" for p, label in PHRASES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, {words("t")} AS ws FROM d),
b AS (SELECT k, i - 1 AS place, label FROM w, unnest(range(1, len(ws) + 1)) AS u(i), (VALUES {ps}) AS p(label, pw)
      WHERE list_slice(ws, i, i + len(pw) - 1) = pw),
l AS (SELECT k, list_distinct({words("line")}) AS ls FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d)),
m AS (SELECT k, label, len(list_intersect(ls, tw)) / len(tw) AS c FROM l, (VALUES {ts}) AS t(label, tw, must, never)
      WHERE len(list_intersect(ls, must)) = len(must) AND NOT list_has_any(ls, never) AND len(list_intersect(ls, tw)) >= ceil({THRESHOLD} * len(tw) - 1e-9)),
bb AS (SELECT k, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY k),
a AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM b UNION ALL SELECT k, label FROM m) GROUP BY k),
mm AS (SELECT k, max(c) AS c FROM m GROUP BY k)
SELECT doc_id, len(ws) AS n_words, coalesce(bb.n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(bb.labels, '') AS base_labels,
       coalesce(a.labels, '') AS labels, CASE WHEN bb.n > 0 THEN 1.0::DOUBLE ELSE coalesce(mm.c, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN bb USING (k) LEFT JOIN a USING (k) LEFT JOIN mm USING (k)
"""
