"""License notices by phrases and by an exact set-similarity join with license templates.

A text is cut into blocks: its lines, long lines in overlapping windows, and, for notices that are wrapped over
lines, the words of the whole text in half-overlapping windows of twice a template's words (wider ones would meet
short templates by words that only happen to stand in one text). A block meets a template when it holds at least
``theta`` of the template's distinct words (containment). The join is exact: the words of all
templates are ordered by how many documents hold them, rarest first; a block that shares none of a template's
``prefix`` rarest words can't reach the overlap (prefix filter), nor can one with too few words (length filter),
nor one whose first shared word stands too late in either order (positional filter). Only what is left is
compared word by word. The template table is a fixed part of the job, so its size is known when it is broadcast.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.operators.staging import literal_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Opening sentences of public license notices and their labels.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("mit", "This project is licensed under the MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("reserved", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential"),
)


@dataclass(frozen=True)
class LicenseConfig:
    """Containment to reach, and the words of a window of a long line (windows overlap by half)."""

    theta: float = 0.8
    window: int = 96
    templates: tuple[tuple[str, str], ...] = TEMPLATES


def plain_words(text: Column) -> Column:
    """The words in lower case (A-Z only), joined by single spaces; empty if there are none."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), BREAK, " "))


def _template_words(config: LicenseConfig) -> list[list[str]]:
    return [re.sub(BREAK, " ", t.translate(str.maketrans(UPPER, LOWER))).split() for _, t in config.templates]


def _template_sets(config: LicenseConfig) -> list[tuple[int, str, list[str]]]:
    """Number, label and distinct words of each template."""
    return [(i, label, list(dict.fromkeys(w))) for i, ((label, _), w) in enumerate(zip(config.templates, _template_words(config), strict=True))]


def _n_words(plain: Column) -> Column:
    return F.when(plain == "", 0).otherwise(F.char_length(plain) - F.char_length(F.replace(plain, F.lit(" "), F.lit(""))) + 1)


def _phrase(padded: Column, n_words: Column, phrase: str) -> Column:
    """Places of a phrase in words: how many, first start, last start."""
    k = len(phrase.split())
    parts = F.split(padded, f"(?<= ){phrase}(?= )", -1)
    count = F.size(parts) - 1
    # a part starts and ends with a space: one word less than spaces
    inside = lambda p: F.char_length(p) - F.char_length(F.replace(p, F.lit(" "), F.lit(""))) - 1
    first = inside(F.element_at(parts, 1))
    last = n_words - inside(F.element_at(parts, -1)) - k
    none = F.lit(None).cast("int")
    hit = F.struct(count.alias("n"), F.when(count > 0, first).otherwise(none).alias("first"), F.when(count > 0, last).otherwise(none).alias("last"))
    return F.when(F.contains(padded, F.lit(f" {phrase} ")), hit).otherwise(F.struct(F.lit(0).alias("n"), none.alias("first"), none.alias("last")))


def template_order(docs: DataFrame, text_col: str, sets: list[tuple[int, str, list[str]]]) -> list[str]:
    """All template words, by the number of documents that hold them, rarest first. Counted over all documents."""
    vocabulary = sorted({w for _, _, words in sets for w in words})
    plain = plain_words(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    known = F.array(*[F.lit(w) for w in vocabulary])
    counts = (
        docs.select(F.array_intersect(F.split(plain, " "), known).alias("ws"))
        .select(F.explode("ws").alias("w"))
        .groupBy("w")
        .agg(F.count("*").alias("n"))
        .collect()  # at most a row for each word of the fixed templates
    )
    seen = {r["w"]: r["n"] for r in counts}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def blocks(text: Column, window: int) -> Column:
    """Arrays of words: a line each, lines over ``window`` words cut into windows that overlap by half."""
    step = window // 2
    lines = F.filter(F.transform(F.split(text, r"[\n\r]+"), lambda x: F.split(plain_words(x), " ")), lambda w: w[0] != "")

    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - step, F.lit(1)), F.lit(step))
        return F.transform(starts, lambda s: F.slice(words, s, window))

    return F.flatten(F.transform(lines, cut))


def _best_window(words: Column, wanted: Column, step: Column) -> Column:
    """The most of the wanted words that one window of ``2 * step`` words holds; every run of ``step`` words is in a window."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - step, F.lit(1)), step)
    return F.array_max(F.transform(starts, lambda s: F.size(F.array_intersect(wanted, F.slice(words, s, 2 * step)))))


def license_matches(docs: DataFrame, *, text_col: str = "text", config: LicenseConfig = LicenseConfig()) -> DataFrame:  # noqa: B008
    """Documents (``__key`` and the best containment of each label met). Needs a column ``__key``.

    Documents none of whose words is in a template's prefix are left out before anything is cut or joined.
    """
    spark = docs.sparkSession
    sets = _template_sets(config)
    rank = {w: i for i, w in enumerate(template_order(docs, text_col, sets))}
    ordered = [(i, label, sorted(words, key=rank.__getitem__)) for i, label, words in sets]
    need = {i: math.ceil(config.theta * len(words) - 1e-9) for i, _, words in ordered}
    prefix = {i: words[: len(words) - need[i] + 1] for i, _, words in ordered}
    length = [len(words) for words in _template_words(config)]
    entries = [(w, i, label, " ".join(words), p, need[i], len(prefix[i]), length[i]) for i, label, words in ordered for p, w in enumerate(prefix[i])]
    table = literal_rows(spark, entries, "word string, template int, label string, words string, p int, need int, n_prefix int, length int")
    table = table.withColumn("words", F.split("words", " "))
    every = F.array(*[F.lit(w) for w in rank])  # in the global order
    rare = F.array(*[F.lit(w) for w in sorted({w for ws in prefix.values() for w in ws}, key=rank.__getitem__)])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hopeful = docs.select("__key", text.alias("t")).where(F.arrays_overlap(F.split(plain_words(F.col("t")), " "), rare))
    cut = hopeful.select("__key", F.explode(blocks(F.col("t"), config.window)).alias("block"))
    met = _join_templates(cut, table, every, rare).withColumn("overlap", F.size(F.array_intersect("tokens", "words"))).where("overlap >= need")
    # the whole text as one block finds the templates whose words it holds at all; windows of it decide, once a template
    whole = _join_templates(hopeful.select("__key", F.split(plain_words(F.col("t")), " ").alias("block")), table, every, rare)
    whole = whole.where(F.get(F.array_intersect(F.slice("words", 1, F.col("n_prefix")), "tokens"), F.lit(0)) == F.col("word"))
    whole = whole.where(F.size(F.array_intersect("tokens", "words")) >= F.col("need"))
    wrapped = whole.withColumn("overlap", _best_window(F.col("block"), F.col("words"), F.col("length"))).where("overlap >= need")
    found = met.select("__key", "label", "overlap", "words").unionByName(wrapped.select("__key", "label", "overlap", "words"))
    return found.groupBy("__key", "label").agg(F.max(F.col("overlap") / F.size("words")).alias("containment"))


def _join_templates(cut: DataFrame, table: DataFrame, every: Column, rare: Column) -> DataFrame:
    """Blocks with each template that the prefix, length and positional filters leave, a row a shared prefix word."""
    # a block's words that count, in the global order; the others can't be in a template
    tokens = cut.withColumn("tokens", F.array_intersect(every, F.col("block"))).where(F.size("tokens") > 0)
    probes = tokens.select("__key", "block", "tokens", F.posexplode(F.array_intersect("tokens", rare)).alias("_", "word")).drop("_")
    q = F.array_position("tokens", F.col("word")).cast("int") - 1
    return (
        probes.join(F.broadcast(table), "word")
        .where(F.size("tokens") >= F.col("need"))
        .where(1 + F.least(F.size("words") - F.col("p") - 1, F.size("tokens") - q - 1) + F.least(F.col("p"), q) >= F.col("need"))
    )


def scan_licenses(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", config: LicenseConfig = LicenseConfig()) -> DataFrame:  # noqa: B008
    """One row for every row of ``docs``: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    Null texts count as empty: no words, no labels, score 0. The score is the best containment of a template,
    1 where a base phrase stands. Rows are told apart by id and text (its length and two hashes of it), so rows of one
    id with unlike texts have each its own labels; a null id is an id like any other.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.struct(F.col(id_col).alias("id"), F.octet_length(text).alias("n"), F.xxhash64(text).alias("x"), F.crc32(text.cast("binary")).alias("c"))
    base = docs.select(key.alias("__key"), plain_words(text).alias("plain"))
    base = base.withColumn("n_words", _n_words(F.col("plain"))).withColumn("padded", F.concat(F.lit(" "), F.col("plain"), F.lit(" ")))
    hits = [f"h{i}" for i in range(len(PHRASES))]
    base = base.select("__key", "n_words", *[_phrase(F.col("padded"), F.col("n_words"), p).alias(h) for h, (p, _) in zip(hits, PHRASES, strict=True)])
    own = F.array_compact(F.array(*[F.when(F.col(f"{h}.n") > 0, label) for h, (_, label) in zip(hits, PHRASES, strict=True)]))
    base = base.select(
        "__key",
        F.col("n_words").cast("long"),
        sum(F.col(f"{h}.n") for h in hits).cast("long").alias("n_base"),
        F.least(*[F.col(f"{h}.first") for h in hits]).cast("long").alias("first_word"),
        F.greatest(*[F.col(f"{h}.last") for h in hits]).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(own)).alias("own"),
    )
    keyed = docs.select(key.alias("__key"), F.col(text_col))
    met = license_matches(keyed, text_col=text_col, config=config)
    by_doc = met.groupBy(F.col("__key").alias("k")).agg(F.collect_set("label").alias("met"), F.max("containment").alias("best"))  # a label each at most
    joined = base.join(by_doc, F.col("__key").eqNullSafe(F.col("k")), "left")
    labels = F.array_sort(F.array_union("own", F.coalesce("met", F.array().cast("array<string>"))))
    return joined.select(
        F.col("__key.id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("own") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
