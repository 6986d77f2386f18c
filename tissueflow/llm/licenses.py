"""Operator 9, license scans as an exact set-similarity join. DataFrame functions only.

Blocks of text are joined with license templates by containment: at least CONTAINMENT of a template's distinct
words stand in the block. Blocks are all runs of consecutive words twice as long as the template, whatever the lines of a text, so
words far apart do not add up and wrapped notices are found. Template words are put in order of their frequency in the whole corpus,
rarest first, and a block's words that stand in any template follow the same order. Of a block B that reaches the threshold of
a template T, the first shared word is among the first |T| - need + 1 words of T and |B| - need + 1 of B (prefix filters), B has
need words or more (length filter), and where that word is T's i-th and B's j-th, as many must be left on both sides, so
|T| - i and |B| - j reach need (positional filter). What passes is counted exactly.

Base labels are places where a phrase's words stand consecutively, found in the text with its separators made
single spaces.

Defined results: a null or empty text has no words, no places and score 0; repeated rows get equal results; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Fixed values of the contract.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
CONTAINMENT = 0.8
#: A notice is looked for in runs of RUN times a template's words; a stretch has STEP places of a run.
RUN, STEP = 2, 64

#: Notices of widely used public licenses, as their holders ask them to be quoted.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
]
_WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z alone in lower case. lower() does the same but for two letters that it turns into ASCII ones."""
    odd = text.contains("\u212a") | text.contains("\u0130")
    return F.when(odd, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def spaced(text: Column) -> Column:
    """The words of lower-cased text, one space between; no words: empty."""
    return F.trim(F.regexp_replace(text, SEPARATORS, " "))


def template_words(text: str) -> list[str]:
    return sorted(set(re.findall(_WORD, text.lower())))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" ")))


def _places(padded: Column, phrase: str) -> Column:
    """n, first and last place in words of a phrase in ' w1 w2 ... '."""
    gaps = F.split(padded, f" {phrase}(?= )", -1)
    n = F.size(gaps) - 1
    before = F.aggregate(F.slice(gaps, 1, n), F.lit(0), lambda acc, g: acc + _spaces(g))
    here = F.struct(n.cast("long").alias("n"), _spaces(gaps[0]).cast("long").alias("first"), (before + (n - 1) * len(phrase.split())).cast("long").alias("last"))
    return F.when(padded.contains(f" {phrase} "), here)


def base(docs: DataFrame) -> DataFrame:
    """key (hash of the row), doc_id, n_words, and the places of the phrases."""
    words = spaced(lowered(F.coalesce("text", F.lit(""))))
    d = docs.select("doc_id", _key().alias("key"), words.alias("w"))
    d = d.select("doc_id", "key", F.when(F.col("w") == "", 0).otherwise(_spaces(F.col("w")) + 1).cast("long").alias("n_words"), F.concat(F.lit(" "), "w", F.lit(" ")).alias("p"))
    d = d.select("doc_id", "key", "n_words", *[_places(F.col("p"), ph).alias(f"at{k}") for k, ph in enumerate(PHRASES)])
    at = [F.col(f"at{k}") for k in range(len(PHRASES))]
    labels = F.filter(F.array(*[F.when(a.isNotNull(), F.lit(label)) for a, label in zip(at, PHRASES.values(), strict=True)]), lambda x: x.isNotNull())
    total = sum((F.coalesce(a["n"], F.lit(0)) for a in at), F.lit(0))
    return d.select("doc_id", "key", "n_words", total.cast("long").alias("n_base"), F.least(*[a["first"] for a in at]).alias("first_word"), F.greatest(*[a["last"] for a in at]).alias("last_word"), labels.alias("base_labels"))


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def _some(near: list[str]) -> str:
    return "(?<![0-9a-z\\x{80}-\\x{10FFFF}])(?:" + "|".join(map(re.escape, near)) + ")(?![0-9a-z\\x{80}-\\x{10FFFF}])"


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each template word stands; the result is as large as the templates."""
    words = F.array_intersect(F.split(spaced(lowered(F.coalesce("text", F.lit("")))), " ", -1), F.array(*[F.lit(w) for w in vocabulary]))
    rows = docs.select(F.explode(words).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in rows}


class Prefixes:
    """Template words in order of frequency: the table of each template's first words, and what bounds the search."""

    def __init__(self, docs: DataFrame, templates: list[tuple[str, str]], threshold: float):
        sets = [(label, template_words(t), RUN * len(re.findall(_WORD, t))) for label, t in templates]
        vocabulary = sorted({w for _, s, _ in sets for w in s})
        count = frequencies(docs, vocabulary)
        self.order = sorted(vocabulary, key=lambda w: (count[w], w))
        place = {w: k for k, w in enumerate(self.order)}
        rows = []
        for k, (label, s, run) in enumerate(sets):
            order = sorted(s, key=place.__getitem__)
            need = math.ceil(threshold * len(order) - 1e-9)
            rows += [(k, label, w, i, order, need, run) for i, w in enumerate(order[: len(order) - need + 1])]
        self.table = docs.sparkSession.createDataFrame(rows, "template int, label string, word string, i int, ordered array<string>, need int, run int")  # as large as the templates
        self.near = sorted({r[2] for r in rows})
        self.longest = max((r[6] for r in rows), default=1)
        self.least = min((r[5] for r in rows), default=1)

    def pairs(self, words: DataFrame) -> DataFrame:
        """Rows with words and each template of which they hold as many words as it needs, each pair once."""
        # of the words only those of a template count; array_intersect keeps the order of its first array
        block = words.withColumn("words", F.array_intersect(F.array(*[F.lit(w) for w in self.order]), "words")).filter(F.size("words") >= self.least)
        held = block.select("*", F.posexplode(F.slice("words", F.lit(1), F.size("words") - (self.least - 1))).alias("j", "word"))
        left = F.least(F.size("ordered") - F.col("i"), F.size("words") - F.col("j"))
        pairs = held.join(F.broadcast(self.table), "word").filter((F.size("words") >= F.col("need")) & (left >= F.col("need")))
        shared = F.array_intersect("ordered", "words")
        return pairs.filter((F.size(shared) >= F.col("need")) & (F.get(shared, F.lit(0)) == F.col("word")))


def _runs(docs: DataFrame, p: Prefixes) -> DataFrame:
    """key, label, score of runs of a text's words: the best run of each stretch of STEP places.

    A stretch is followed by the words that its last run still needs. The prefix, length and positional filters look
    at it whole; only what passes is counted run by run, from each place that holds a word of the template.
    """
    d = docs.select(_key().alias("key"), lowered(F.coalesce("text", F.lit(""))).alias("t")).filter(F.col("t").rlike(_some(p.near)))
    d = d.select("key", F.split(spaced(F.col("t")), " ", -1).alias("all"))
    places = F.sequence(F.lit(1), F.size("all"), F.lit(STEP))
    d = d.select("key", F.transform(places, lambda k: F.slice("all", k, STEP + p.longest - 1)).alias("stretches"))
    d = d.select("key", F.explode("stretches").alias("stretch")).filter(F.arrays_overlap("stretch", F.array(*[F.lit(w) for w in p.near])))
    pairs = p.pairs(d.select("key", "stretch", F.col("stretch").alias("words")))
    begin = F.filter(F.sequence(F.lit(1), F.least(F.lit(STEP), F.size("stretch"))), lambda k: F.array_contains("ordered", F.get("stretch", k - 1)))
    overlap = F.array_max(F.transform(begin, lambda k: F.size(F.array_intersect("ordered", F.slice("stretch", k, F.col("run"))))))
    return pairs.select("key", "label", "ordered", "need", overlap.alias("n")).filter(F.col("n") >= F.col("need")).select("key", "label", (F.col("n") / F.size("ordered")).alias("score"))


def containment_join(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """key, label, score: the best run of each text for each label of which a template reaches the threshold."""
    return _runs(docs, Prefixes(docs, templates, threshold)).groupBy("key", "label").agg(F.max("score").alias("score"))


def licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """Per document the base places and labels, the labels of both ways, and the best score."""
    found = _runs(docs, Prefixes(docs, templates, threshold)).groupBy("key").agg(F.collect_set("label").alias("found"), F.max("score").alias("score"))
    rows = base(docs).join(found, "key", "left")
    both = F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0)))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base_labels")).alias("base_labels"), joined(both).alias("labels"), score.alias("score"))
