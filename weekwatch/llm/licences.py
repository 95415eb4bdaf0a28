"""Licence scan: passages of a text compared with licence templates by the Dice coefficient of their word bigrams.

A text's passages are its lines and its blocks between blank lines. They and the templates are normalised (ASCII lower
case, anything but letters and digits becomes one space) and turned into sets of word bigrams. With ``a`` and ``b``
bigrams, Dice cannot reach ``t`` unless ``a / b`` lies between ``t / (2 - t)`` and ``(2 - t) / t``; only templates
within these bounds are compared. Everything is column expressions; templates are a literal, bounded by their list.

Defined results: null and empty texts and one-word passages match nothing; rows that share an id are one document; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Least Dice coefficient of a match.
THRESHOLD = 0.8
# SPDX identifiers and the customary notices of the licences.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams_of(text: str) -> list[str]:
    """Word bigrams of a template, by the same rule as the column expressions."""
    kept = "".join(c if c in _LOWER + "0123456789" else " " for c in text.translate(str.maketrans(_UPPER, _LOWER)))
    words = kept.split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _passages(text: Column) -> Column:
    return F.array_distinct(F.concat(F.split(text, "\n", -1), F.split(text, "\n[ \t\r]*\n", -1)))


def _words(passage: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.translate(passage, _UPPER, _LOWER), "[^a-z0-9]+", " ")), " ", -1)


def scan(df: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
         templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``(id, licence, dice, n_passages)``: each licence of a document with its best coefficient and its passages."""
    grams = [(name, bigrams_of(body)) for name, body in templates]
    slack = 1e-9  # of the bounds only, for rounding; the coefficient itself decides
    low, high = threshold / (2 - threshold) - slack, (2 - threshold) / threshold + slack
    literal = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(len(g)).alias("size"),
                                 F.array(*map(F.lit, g)).alias("grams")) for name, g in grams])
    least = int(min(len(g) for _, g in grams) * low)
    words = df.select(F.col(id_column), F.explode(_passages(F.coalesce(F.col(text), F.lit("")))).alias("_p")).select(
        id_column, _words(F.col("_p")).alias("_w")).filter(F.size("_w") > max(1, least))
    sets = words.select(id_column, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.concat_ws(" ", F.get("_w", i - 1), F.get("_w", i)))).alias("_b"))
    near = sets.withColumn("_t", F.explode(F.filter(literal, lambda t: (F.size("_b") >= t["size"] * low) & (
        F.size("_b") <= t["size"] * high))))
    dice = 2.0 * F.size(F.array_intersect("_b", F.col("_t.grams"))) / (F.size("_b") + F.col("_t.size"))
    found = near.select(id_column, F.col("_t.licence").alias("licence"), dice.alias("dice")).filter(
        F.col("dice") >= threshold)
    return found.groupBy(id_column, "licence").agg(F.max("dice").alias("dice"), F.count("*").alias("n_passages"))


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the same rows over ``documents``."""
    rows = ", ".join("('{}', [{}])".format(n, ", ".join(f"'{g}'" for g in bigrams_of(b))) for n, b in TEMPLATES)
    words = ("string_split(trim(regexp_replace(translate(p, '" + _UPPER + "', '" + _LOWER
             + "'), '[^a-z0-9]+', ' ', 'g')), ' ')")
    return f"""
WITH t(licence, g) AS (VALUES {rows}),
p AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)),
    string_split_regex(text, '\\n[ \\t\\r]*\\n')))) AS p FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, list_distinct([w[i] || ' ' || w[i + 1] for i in generate_series(1, len(w) - 1)]) AS b
    FROM (SELECT doc_id, {words} AS w FROM p) WHERE len(w) > 1),
d AS (SELECT doc_id, licence, 2.0::DOUBLE * len(list_intersect(b, g)) / (len(b) + len(g)) AS dice FROM b, t)
SELECT doc_id, licence, max(dice) AS dice, count(*) AS n_passages FROM d WHERE dice >= {threshold}::DOUBLE GROUP BY ALL"""
