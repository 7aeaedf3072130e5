"""License scans: parts of a text against licence templates by the Dice coefficient over word bigrams.

Parts are the lines of a text, the sentences of a line, and windows of consecutive words whatever the line ends between
them. A part's words are its runs of ASCII letters and digits, lower-cased. Dice = 2 common / (a + b) over the distinct
bigrams of both; since common is min(a, b) at most, a template is a candidate only if its size lets Dice reach the
threshold, and a line or sentence with too few words for every template is not compared at all.

A text is only taken apart if it holds, as substrings, both words of as many bigrams of a template as Dice needs. A
template's windows have as many bigrams as its size lets reach the threshold, and start and end with one of its own
(without a foreign end Dice is larger). Of overlapping windows those that no other beats are taken, and none that a better match of
the same licence contains. DataFrame functions only; the templates are a fixed list of literals.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Licence notices as they are commonly printed, (licence id, notice).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

#: ``TEMPLATES`` and the whole sentence of the MIT permission, which its shorter form is too short to find.
NOTICES = [*TEMPLATES, (
    "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
           "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
           "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
           "conditions:")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SENTENCE_END = r"(?<=[.!?]) +"


def template_bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def words(part: Column) -> Column:
    return F.regexp_extract_all(F.translate(part, UPPER, LOWER), F.lit("[a-z0-9]+"), 0)


def bigrams(word_list: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(word_list, 1, F.size(word_list) - 1), F.slice(word_list, 2, F.size(word_list)),
                                       lambda a, b: F.concat(a, F.lit(" "), b)))


def parts(text: Column) -> Column:
    """The distinct lines of a text, and the sentences of its lines."""
    lines = F.split(text, "\n", -1)
    sentences = F.flatten(F.transform(lines, lambda line: F.split(line, SENTENCE_END, -1)))
    return F.array_distinct(F.concat(lines, sentences))


def _least_common(size: int, threshold: float) -> int:
    """The fewest common bigrams with which Dice against a template of ``size`` can reach the threshold."""
    return max(1, math.ceil(size * threshold / (2 - threshold) - 1e-9))


def may_hold(lower: Column, grams: list[str], threshold: float) -> Column:
    """Whether a lower-cased text holds both words of enough of a template's bigrams; first a few words decide.

    The first words take part in so many bigrams that too few are left without them; long words are rare, so they go first.
    """
    need, left, first = _least_common(len(grams), threshold), [g.split(" ") for g in grams], []
    while len(left) >= need:
        word = max({w for g in left for w in g}, key=lambda w: (sum(w in g for g in left) * len(w) ** 3, w))
        first.append(word)
        left = [g for g in left if word not in g]
    has = lower.contains
    both = reduce(Column.__add__, ((has(a) & has(b)).cast("int") for a, b in (g.split(" ") for g in grams)))
    return F.when(reduce(Column.__or__, map(has, first)), both >= need).otherwise(False)


def windows(pairs: Column, name: str, grams: list[str], threshold: float) -> Column:
    """The template's matches (dice, licence, part, words) among windows of a text's bigrams ``pairs``, in text order."""
    size, need, reach = len(grams), _least_common(len(grams), threshold), threshold / (2 - threshold)
    own, most = F.array(*map(F.lit, grams)), math.floor(size / reach + 1e-9)
    held = F.filter(F.transform(pairs, lambda g, i: F.when(F.array_contains(own, g), i)), lambda i: i.isNotNull())

    def from_here(at: Column, i: Column, k: Column) -> Column:
        ends = F.filter(F.slice(at, k + need - 1, max(1, most - need + 1)), lambda j: j - i < most)
        scored = F.transform(ends, lambda j: F.struct(dice_of(F.array_distinct(F.slice(pairs, i + 1, j - i + 1))).alias("dice"),
                                                      (-i).alias("i"), (-j).alias("j")))
        return F.array_max(F.filter(scored, lambda w: w["dice"] >= threshold))

    def dice_of(window: Column) -> Column:
        return 2.0 * F.size(F.array_intersect(window, own)) / (F.size(window) + size)

    def best(found: Column) -> Column:
        # in order of distinct starts, overlapping windows are fewer than ``most`` places apart
        near = lambda k: F.slice(found, F.greatest(k + 2 - most, F.lit(1)), 2 * most)
        return F.filter(found, lambda w, k: ~F.exists(near(k), lambda o: (o > w) & (o["i"] >= w["j"]) & (o["j"] <= w["i"])))

    def match(w: Column) -> Column:
        rest = F.transform(F.slice(pairs, 1 - w["i"], w["i"] - w["j"] + 1), lambda g: F.substring_index(g, " ", -1))
        text = F.concat(F.substring_index(F.get(pairs, -w["i"]), " ", 1), F.lit(" "), F.array_join(rest, " "))
        return F.struct(w["dice"].alias("dice"), F.lit(name).alias("licence"), text.alias("part"), text.alias("words"))

    # arrays of one array: a lambda's variable is computed once, whatever it is used for
    starts = F.transform(F.array(held), lambda at: F.filter(F.transform(at, lambda i, k: from_here(at, i, k + 1)),
                                                            lambda w: w.isNotNull()))
    return F.flatten(F.transform(starts, lambda found: F.transform(best(found), match)))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, licence, dice, part, matches) of every row: its best match, or nulls (dice 0) without one of the threshold.

    ``matches`` holds all (dice, licence, part) that reach the threshold, best first; none is an empty array. Of equal scores the smallest licence id, then the smallest part is taken. A window's part is its words with single
    spaces. Null and empty texts match nothing; repeated rows and ids stay. No template can match if there is none. Other
    columns are left out.
    """
    known = [(name, grams) for name, t in (NOTICES if templates is None else templates) if (grams := template_bigrams(t))]
    row = df.select(df[doc_id].alias("doc_id"), F.coalesce(df[text], F.lit("")).alias("text"))
    kind = "struct<dice: double, licence: string, part: string, words: string>"
    if not known:
        return row.select("doc_id", F.lit(None).cast("string").alias("licence"), F.lit(0.0).alias("dice"),
                          F.lit(None).cast("string").alias("part"),
                          F.array().cast("array<struct<dice: double, licence: string, part: string>>").alias("matches"))
    reach = threshold / (2 - threshold)
    least = min(len(g) for _, g in known) * reach

    def matches(part: Column) -> Column:
        """The part's candidates that reach the threshold."""
        scored = F.transform(F.array(bigrams(part["words"])),
                             lambda own: F.array(*(score(own, part, *t) for t in known)))
        return F.filter(F.flatten(scored), lambda m: m.isNotNull())

    def score(own: Column, part: Column, name: str, grams: list[str]) -> Column:
        size = len(grams)
        dice = 2.0 * F.size(F.array_intersect(own, F.array(*map(F.lit, grams)))) / (F.size(own) + size)
        fits = (F.size(own) >= size * reach) & (F.size(own) <= size / reach)
        match = F.struct(dice.alias("dice"), F.lit(name).alias("licence"), part["part"].alias("part"),
                         F.array_join(part["words"], " ").alias("words")).cast(kind)
        return F.when(fits & (dice >= threshold), match)

    with_words = F.transform(parts(F.col("text")), lambda p: F.struct(p.alias("part"), words(p).alias("words")))
    # n words have n - 1 bigrams, or fewer distinct ones: only the lower bound holds for words
    sized = F.filter(with_words, lambda p: (F.size(p["words"]) > 1) & (F.size(p["words"]) - 1 >= least))
    none = F.array().cast(f"array<{kind}>")
    may = F.filter(F.array(*(F.when(may_hold(F.col("lower"), g, threshold), i) for i, (_, g) in enumerate(known))),
                   lambda i: i.isNotNull())
    wide = reduce(F.concat, (F.when(F.array_contains("may", i), windows(F.col("pairs"), *t, threshold).cast(f"array<{kind}>"))
                             .otherwise(none) for i, t in enumerate(known)))
    rows = row.withColumn("lower", F.lower("text")).withColumn("may", may) \
        .withColumn("ws", F.when(F.size("may") > 0, words(F.col("text")))) \
        .withColumn("pairs", _pairs(F.col("ws"))) \
        .select("doc_id", F.when(F.size("may") > 0, F.flatten(F.transform(sized, matches))).otherwise(none).alias("found"),
                F.when(F.size("may") > 0, F.array_distinct(wide)).otherwise(none).alias("wide"))
    new = F.filter("wide", lambda w: ~F.exists("found", lambda m: _covers(m, w)) & ~F.exists(
        "wide", lambda m: (m["words"] != w["words"]) & _covers(m, w)))
    every = F.array_sort(F.array_distinct(F.transform(F.concat("found", new), lambda m: m.dropFields("words"))), _order)
    return rows.withColumn("matches", every).withColumn("m", F.get("matches", F.lit(0))).select(
        "doc_id", F.col("m.licence").alias("licence"), F.coalesce("m.dice", F.lit(0.0)).alias("dice"),
        F.col("m.part").alias("part"), "matches")


def _pairs(word_list: Column) -> Column:
    """All bigrams in text order, repeated ones too."""
    return F.zip_with(F.slice(word_list, 1, F.greatest(F.size(word_list) - 1, F.lit(0))),
                      F.slice(word_list, 2, F.greatest(F.size(word_list), F.lit(0))),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def _covers(m: Column, w: Column) -> Column:
    """Whether match m of the same licence holds the words of w and is no worse."""
    space = F.lit(" ")
    return (m["licence"] == w["licence"]) & (m["dice"] >= w["dice"]) & \
        F.concat(space, m["words"], space).contains(F.concat(space, w["words"], space))


def _order(a: Column, b: Column) -> Column:
    return F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1) \
        .when(a["licence"] < b["licence"], -1).when(a["licence"] > b["licence"], 1) \
        .when(a["part"] < b["part"], -1).when(a["part"] > b["part"], 1).otherwise(0)
