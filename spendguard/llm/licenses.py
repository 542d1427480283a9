"""Licence scans by a positional index of rare words.

The index holds, for each rare word of the licence templates, the templates and the positions where
it stands. All of these words of a file are looked up, so a file may hold any number of notices; a word
at place p of the file that stands at place q of a template votes for the template to begin at p - q,
and the votes that agree are intersected. A template is reported where enough of its rare words stand
at the right places relative to each other and the file holds its mandatory key phrases.

Everything is DataFrame functions: the index is a literal, document frequencies are counted for the
index's words alone, and only files that hold a template's mandatory phrases are exploded.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, text_of

#: Characters that stand between words, and phrases whose places are always reported.
_BETWEEN = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"
_SEPARATORS = "".join(chr(c) for c in (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)))
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: A licence word is rare from this inverse document frequency on (natural logarithm), and the rarer
#: half of a template's words are its rare words however many files hold them.
MIN_IDF = 2.0
#: Share of a template's weight that must agree.
MIN_COVERAGE = 0.5


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: tuple[str, ...]

    def words(self) -> list[str]:
        return re.findall(r"[a-z0-9]+", self.text.lower())


#: Short notices and opening sentences of public licences, with the phrases they cannot lack.
TEMPLATES = (
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("except in compliance with the license",)),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license", "free software foundation")),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
    Template("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
)


def words_of(text: Column) -> Column:
    """The lower-case words of a text, in order."""
    inner = F.btrim(F.lower(text), F.lit(_SEPARATORS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{_BETWEEN}]+"))


def _lookup(entries: dict, kind: str) -> Column:
    """A literal map as a column."""
    pairs = [x for k, v in entries.items() for x in (F.lit(k), v)]
    return (F.create_map(*pairs) if pairs else F.create_map().cast(f"map<string,{kind}>"))


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def document_frequencies(words: DataFrame, lexicon: list[str]) -> tuple[int, dict[str, int]]:
    """Number of rows, and how many hold each word of the lexicon: one row per word reaches the driver."""
    held = words.select(F.explode(F.array_union(F.array(F.lit("")), F.array_intersect(_array(lexicon), "_words"))).alias("w"))
    counts = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return counts.pop("", 0), counts


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES,
         min_idf: float = MIN_IDF, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words``, ``base`` (array of phrase number and place,
    for each place of each of ``BASE_PHRASES``), ``found`` (the labels of the templates) and
    ``coverage`` (the highest share of a reported template's weight, else 0).

    A null or empty text has no words. Repeated rows and null ids stay as they are; other columns
    are ignored. An empty table has no rows.
    """
    lexicon = sorted({w for t in templates for w in t.words()})
    words = docs.select(column(id_col).alias("_id"), words_of(text_of(text_col)).alias("_words"))
    n, df = document_frequencies(words, lexicon)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in lexicon}
    # in a table of few rows, or where many hold a notice, none of its words is rare by its count
    rare_of = []
    for template in templates:
        own = sorted(idf[w] for w in {*template.words()})
        bound = min([min_idf, *own[len(own) // 2:]])
        rare_of.append({w for w in template.words() if idf[w] >= bound})
    rare = sorted({w for own in rare_of for w in own})
    # a word that every row holds still weighs something, less than any other
    weights = {w: max(idf[w], 1 / (n + 2)) for w in rare}

    last_words = _array(sorted({p.split()[-1] for p, _ in BASE_PHRASES}))
    at = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: F.array_contains(last_words, F.element_at("_words", i + 1)))
    ends = F.when(F.arrays_overlap("_words", last_words), at).otherwise(F.array().cast("array<int>"))

    def places(k: int, phrase: str) -> Column:
        parts = phrase.split()
        return F.transform(
            F.filter("_ends", lambda e: _all([F.get("_words", e - len(parts) + 1 + i) == F.lit(p) for i, p in enumerate(parts)])),
            lambda e: F.struct(F.lit(k).alias("phrase"), (e - len(parts) + 1).cast("long").alias("place")))

    found = F.concat(*(places(k, p) for k, (p, _) in enumerate(BASE_PHRASES)))
    present = F.array_intersect(_array(rare), "_words")
    files = (words.withColumn("_ends", ends).withColumn("_n", F.size("_words").cast("long"))
             .withColumn("base", F.when(F.size("_ends") > 0, found).otherwise(F.array().cast("array<struct<phrase:int,place:bigint>>")))
             .withColumn("_present", present)
             .withColumn("_keys", F.array_intersect(_array(sorted({w for t in templates for p in t.mandatory for w in p.split()})), "_words")))
    # no label without the words of its mandatory phrases; the array binds them, as a filter computes a column where it is named
    candidate = F.exists(F.array("_keys"), lambda keys: _any([
        _all([F.array_contains(keys, w) for w in sorted({w for p in t.mandatory for w in p.split()})]) for t in templates]))
    plain = files.where(~candidate).select(column("_id").alias(id_col), F.col("_n").alias("n_words"), "base",
                                           F.array().cast("array<string>").alias("found"), F.lit(0.0).alias("coverage"))

    # the rest: rare words with their places vote for where templates begin
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        for q, w in enumerate(template.words()):
            if w in rare_of[t]:
                postings.setdefault(w, []).append((t, q))
    posting_map = _lookup({w: F.array(*(F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in places)) for w, places in postings.items()},
                          "array<struct<t:int,q:int>>")
    weight = _lookup({w: F.lit(float(weights[w])) for w in postings}, "double")
    totals = _lookup({str(t): F.lit(sum(weights[w] for w in x.words() if w in rare_of[t]) or 1.0) for t, x in enumerate(templates)}, "double")
    labels = _array([t.label for t in templates])

    joined = F.concat(F.lit(" "), F.concat_ws(" ", "_words"), F.lit(" "))
    verified = F.array(*(_all([F.contains("_joined", F.lit(f" {p} ")) for p in t.mandatory]) for t in templates))
    hits = F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("p"))), lambda h: F.array_contains("_present", h["w"]))
    kept = ["_row", "_id", "_n", "base"]
    votes = (files.where(candidate).withColumn("_row", F.monotonically_increasing_id())
             .withColumn("_joined", joined).withColumn("_verified", verified)
             .withColumn("_hits", F.when(F.exists("_verified", lambda v: v), hits).otherwise(F.array().cast("array<struct<w:string,p:int>>")))
             .select(*kept, "_verified", F.explode_outer("_hits").alias("_h"))
             .select(*kept, "_verified", "_h", F.explode_outer(F.element_at(posting_map, F.col("_h.w"))).alias("_at"))
             .select(*kept, F.when(F.element_at("_verified", F.col("_at.t") + 1), F.col("_at.t")).alias("_t"),
                     (F.col("_h.p") - F.col("_at.q")).alias("_start"), F.element_at(weight, F.col("_h.w")).alias("_w")))
    # a place of a template is met by one place of the file at a given start, so weights add up once
    aligned = (votes.groupBy(*kept, "_t", F.when(F.col("_t").isNotNull(), F.col("_start")).alias("_start"))
               .agg(F.sum("_w").alias("_sum"))
               .withColumn("_share", F.least(F.lit(1.0), F.round(F.col("_sum") / F.element_at(totals, F.col("_t").cast("string")), 6)))
               .withColumn("_fits", F.coalesce(F.col("_share") >= min_coverage, F.lit(False))))
    label = F.element_at(labels, F.col("_t") + 1)
    rich = (aligned.groupBy(*kept).agg(F.collect_set(F.when(F.col("_fits"), label)).alias("found"),
                                       F.coalesce(F.max(F.when(F.col("_fits"), F.col("_share"))), F.lit(0.0)).alias("coverage"))
            .select(column("_id").alias(id_col), F.col("_n").alias("n_words"), "base", "found", "coverage"))
    return plain.unionByName(rich)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def report(scanned: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The row of ``op8``: counts and places of the base phrases, and labels as text. The score is
    the coverage of the best template, or 1 for a file with a base phrase."""
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: F.element_at(_array([x for _, x in BASE_PHRASES]), b["phrase"] + 1))))
    place = F.transform("base", lambda b: b["place"])
    return scanned.select(
        column(id_col), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, "found")), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.col("coverage")).alias("score"))
