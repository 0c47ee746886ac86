"""License scan: exact set-similarity join of text blocks with license templates.

A template is found in a text if a block holds enough of the template's distinct words: CONTAINMENT percent,
or all of them if they are fewer than SHORT, where one word tells a license from plain prose.
Blocks are all runs of consecutive words, a quarter longer than the template, whatever line breaks and comment
signs stand between; so wrapped notices are found, and words far apart are none.
A text that has such a block holds so many of the words as a whole. The words of the templates get one
global order, rarest in the corpus first; a text that meets the threshold has a word of the
template's prefix (all but so many of the last words), so only texts with such a word are
candidates. Length and position filters (words of the text, words of the template after the
common one) drop most of those before the overlap is counted; the blocks are looked at in what
is left. Templates are a fixed list of bounded size.

Beside it stand the fixed phrases, counted at word positions over the whole text.

Everything runs as DataFrame expressions. Texts are split into words once, in a pass that keeps of each its templates' words, number of
words and phrases; only candidates are split again. Words are runs of letters and digits, all
characters beyond ASCII included, A-Z lower-cased.

Defined cases: a null or empty text has no words, no labels and score 0. A template that
several blocks hold gives its label once; the score is the best share of a block. Ids may be null or repeat: rows are
told apart by id and a hash of the text, and repeated rows each get their own row with the same result. Of very long texts or lines all blocks are looked at. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shards import Scratch, if_small

# Phrase -> label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices of public licenses: label -> texts.
TEMPLATES = {
    "mit-notice": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    ],
    "apache-notice": [
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl-notice": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "bsd-notice": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "isc-notice": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "zlib-notice": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "lgpl-notice": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl-notice": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "epl-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution"],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "cc0": ["To the extent possible under law, the person who associated this work with CC0 has waived all copyright and related or neighboring rights to this work"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0."],
    "as-is": ["The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}
#: Percent of a template's distinct words that a block must hold, and distinct words below which it must hold all.
CONTAINMENT, SHORT = 80, 12

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _template_words() -> list[tuple[int, str, list[str]]]:
    return [(t, label, list(dict.fromkeys(words))) for t, label, words in _templates()]


def _templates() -> list[tuple[int, str, list[str]]]:
    out = []
    for label, texts in TEMPLATES.items():
        for text in texts:
            out.append((len(out), label, "".join(c if c.isalnum() else " " for c in text.lower()).split()))
    return out


def needed(words: list[str], containment: int = CONTAINMENT) -> int:
    """Distinct words of a template that a block must hold."""
    return len(words) if len(words) < SHORT else -(-containment * len(words) // 100)


def run_length(n: int) -> int:
    """Words of a block, for a template of n words."""
    return -(-5 * n // 4)


def words_of(text: Column) -> Column:
    """The lower-cased words, without empty ones."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), "")


def _once(c: Column) -> Column:
    """The same value, computed once: no filter above moves below it with the expression in the column's place."""
    return F.explode(F.array(c))


def text_table(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text_key, n_words, held, places of each phrase): what is read off each text by splitting it once; a written table."""
    vocabulary = sorted({w for _, _, words in _template_words() for w in words})
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").rlike("(?i)license").alias("_has"), _once(words_of(text)).alias("_w"))
    places = [F.when(F.col("_has") & (F.size("_w") > 0), _places(phrase.split())).otherwise(F.array().cast("array<int>")).alias(f"_p{i}") for i, phrase in enumerate(PHRASES)]
    held = F.array_intersect("_w", F.array(*map(F.lit, vocabulary))).alias("held")
    return scratch.save(split.select("doc_id", "text_key", F.size("_w").cast("long").alias("n_words"), held, *places), "license_words")


def template_matches(docs: DataFrame, texts: DataFrame, scratch: Scratch, containment: int = CONTAINMENT) -> DataFrame:
    """(doc_id, text_key, template, label, share) of every text with a block that holds enough of a template."""
    spark = docs.sparkSession
    templates = _template_words()
    length = {t: run_length(len(words)) for t, _, words in _templates()}
    # The numbers of texts that hold the templates' words give the global order.
    df = {r.w: r.n for r in texts.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    rank = {w: i for i, w in enumerate(sorted({w for _, _, words in templates for w in words}, key=lambda w: (df.get(w, 0), w)))}
    prefix, whole = [], []
    for t, label, words in templates:
        words, need = sorted(words, key=rank.__getitem__), needed(words, containment)
        whole.append((t, label, words, len(words), need, length[t]))
        prefix += [(w, t, i) for i, w in enumerate(words[: len(words) - need + 1])]
    leads = F.array(*map(F.lit, sorted({w for w, _, _ in prefix})))
    seeds = F.broadcast(spark.createDataFrame(prefix, "w string, template int, place int"))
    whole = F.broadcast(spark.createDataFrame(whole, "template int, label string, template_words array<string>, size int, need int, run int"))
    # Of a text's words, those of templates are all that the filters need.
    hits = texts.select("doc_id", "text_key", "n_words", "held", F.explode(F.array_intersect("held", leads)).alias("w")).join(seeds, "w").join(whole, "template")
    hits = hits.where(F.col("n_words") >= F.col("need")).where(F.col("size") - F.col("place") >= F.col("need"))
    hits = hits.where(F.size(F.array_intersect("held", "template_words")) >= F.col("need"))
    found = scratch.save(hits.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set("template").alias("of")), "license_candidates")
    again = docs.join(if_small(found), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))).select("doc_id", "_key", "text", "of")
    hits = again.select("doc_id", "_key", "of", _once(words_of(F.col("text"))).alias("all")).select("doc_id", "_key", "all", F.explode("of").alias("template")).join(whole, "template")
    # A block may as well start at its first word of the template.
    starts = F.filter(F.sequence(F.lit(1), F.size("all")), lambda i: F.array_contains("template_words", F.get("all", i - 1)))
    common = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("all", i, F.col("run")), "template_words"))))
    hits = hits.select("*", _once(common).alias("common")).where("common >= need")
    return hits.select("doc_id", F.col("_key").alias("text_key"), "template", "label", (F.col("common") / F.col("size")).alias("share"))


def scan(docs: DataFrame, scratch: Scratch | None = None, containment: int = CONTAINMENT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    scratch, docs = scratch or Scratch(docs.sparkSession), docs.select("doc_id", "text")
    texts = text_table(docs, scratch)
    found = template_matches(docs, texts, scratch, containment).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set("label").alias("_labels"), F.max("share").alias("_share"))
    found = scratch.save(found, "license_labels")
    places = F.concat(*(F.col(f"_p{i}") for i in range(len(PHRASES))))
    base = F.array_sort(F.array_compact(F.array(*(F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())))))
    out = texts.select("doc_id", "text_key", "n_words", places.alias("_at"), base.alias("_base"))
    out = out.join(if_small(found), F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key")), "left")
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("_labels", F.array().cast("array<string>")))))
    return out.select(
        "doc_id",
        "n_words",
        F.size("_at").cast("long").alias("n_base"),
        F.array_min("_at").cast("long").alias("first_word"),
        F.array_max("_at").cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce("_share", F.lit(0.0)).alias("score"),
    )


def _places(phrase: list[str]) -> Column:
    """Word numbers where the phrase stands in _w."""
    return F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: _all([F.get("_w", i + k) == x for k, x in enumerate(phrase)]))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
