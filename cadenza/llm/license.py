"""Operator 6, licence scan: Dice over word bigrams (SQL functions only).

A text's segments are its lines and, if it has several, the whole text.  A
segment is normalised to lower-case words; its distinct word bigrams are compared
with those of each licence template: ``2 |A n B| / (|A| + |B|)``.  A Dice of ``t``
needs ``|A|`` between ``t / (2 - t) |B|`` and ``(2 - t) / t |B|``, so only templates
whose bounds admit the segment's size are compared; segments with too many distinct words for any
template are left out before their bigrams are made.  All of it happens inside the
row: nothing is shuffled.

Cases: null, empty and one-word segments match nothing; the best match of a text
has the highest Dice, then the first template, then the first line (-1: the whole
text); very long texts are compared whole; repeated rows are scanned each;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import text_of

#: fixed values: licence notices (public wording), by identifier
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
]
THRESHOLD = 0.9


def _bigrams(text: str) -> list[str]:
    w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


TEMPLATE_BIGRAMS = [_bigrams(t) for _, t in TEMPLATES]


def bounds(size: int, threshold: float) -> tuple[float, float]:
    """Sizes of segments that can reach ``threshold`` with a template of ``size`` bigrams."""
    return size * threshold / (2 - threshold), size * (2 - threshold) / threshold


def _dices(b: Column, threshold: float) -> Column:
    """Per template: (Dice, place) where the size bounds admit the segment, else null."""
    n = F.size(b)
    out = []
    for i, t in enumerate(TEMPLATE_BIGRAMS):
        lo, hi = bounds(len(t), threshold)
        d = F.size(F.array_intersect(b, F.array(*[F.lit(x) for x in t]))) * 2.0 / (n + len(t))
        out.append(F.when(n.between(F.lit(lo), F.lit(hi)), F.struct(d.alias("dice"), F.lit(-i).alias("t"))))
    return F.array_max(F.filter(F.array(*out), lambda x: x["dice"] >= threshold))


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per text: ``doc_id, license, dice, line, licenses`` (sorted, comma-joined), ``n_lines``."""
    sizes = [bounds(len(t), threshold) for t in TEMPLATE_BIGRAMS]
    least, most = min(x for x, _ in sizes), max(x for _, x in sizes)
    # one step a select: what a step uses more than once is not computed more than once
    d = docs.select("doc_id", F.regexp_replace(F.lower(text_of()), r"[^\p{L}\p{N}\n]+", " ").alias("t"))
    d = d.select("doc_id", "t", F.split("t", "\n").alias("lines"))
    lines = F.col("lines")
    whole = F.when(F.size(lines) > 1, F.array(F.translate("t", "\n", " "))).otherwise(F.array().cast("array<string>"))

    def words(x: Column) -> Column:
        return F.filter(F.split(x, " "), lambda y: y != "")

    def admitted(w: Column) -> Column:
        """Words of a segment whose bigrams may be within some template's bounds: a text
        of n distinct words has n - 1 distinct bigrams or more."""
        n = F.size(w)
        fits = F.when(n - 1 <= most, n - 1 >= least).otherwise(F.size(F.array_distinct(w)) - 1 <= most)
        return F.when(fits, w).otherwise(F.array().cast("array<string>"))

    def grams(w: Column) -> Column:
        n = F.size(w) - 1
        pairs = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(n >= least, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))
    segments = F.transform(F.transform(F.concat(whole, lines), words), admitted)
    best = F.transform(F.transform(segments, grams), lambda b: F.when(F.size(b) > 0, _dices(b, threshold)))
    first = F.when(F.size(lines) > 1, F.lit(-1)).otherwise(F.lit(0))
    d = d.select("doc_id", best.alias("best"), first.alias("first"))
    hits = F.filter(F.transform("best", lambda m, i: F.struct(m["dice"].alias("dice"), m["t"].alias("t"),
                                                              (-(i + F.col("first"))).alias("line"))),
                    lambda m: m["dice"].isNotNull())
    d = d.select("doc_id", hits.alias("hits")).withColumn("top", F.array_max("hits"))
    names = F.array(*[F.lit(k) for k, _ in TEMPLATES])
    name = lambda m: F.element_at(names, 1 - m["t"])
    return d.select("doc_id", F.when(F.size("hits") > 0, name(F.col("top"))).alias("license"), F.col("top.dice").alias("dice"),
                    (-F.col("top.line")).cast("long").alias("line"),
                    F.array_join(F.array_sort(F.array_distinct(F.transform("hits", name))), ",").alias("licenses"),
                    F.size(F.filter("hits", lambda m: m["line"] <= 0)).cast("long").alias("n_lines"))


def oracle(threshold: float = THRESHOLD) -> str:
    """The same scan in DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(f"({i}, {q(k)}, [{', '.join(map(q, b))}], {bounds(len(b), threshold)[0]!r}, {bounds(len(b), threshold)[1]!r})"
                      for i, ((k, _), b) in enumerate(zip(TEMPLATES, TEMPLATE_BIGRAMS)))
    return rf"""
WITH tpl(i, name, g, lo, hi) AS (VALUES {rows}),
n AS (SELECT doc_id, row_number() OVER () AS r, string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), chr(10)) AS ls FROM documents),
seg AS (SELECT r, unnest(range(0, len(ls)))::BIGINT AS line, unnest(ls) AS s FROM n
        UNION ALL SELECT r, -1, array_to_string(ls, ' ') FROM n WHERE len(ls) > 1),
w AS (SELECT r, line, [x FOR x IN string_split(s, ' ') IF x <> ''] AS w FROM seg),
b AS (SELECT r, line, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM w WHERE len(w) > 1),
d AS (SELECT r, line, i, name, len(list_intersect(b.g, tpl.g)) * 2.0::DOUBLE / (len(b.g) + len(tpl.g)) AS dice
      FROM b JOIN tpl ON len(b.g) BETWEEN lo AND hi),
top AS (SELECT r, line, max(dice) AS dice, arg_max(name, (dice, -i)) AS name, max((dice, -i)) AS k FROM d WHERE dice >= {threshold} GROUP BY r, line),
agg AS (SELECT r, arg_max(name, (k, -line)) AS license, max(dice) AS dice, -max((k, -line))[2] AS line,
        array_to_string(list_sort(list(DISTINCT name)), ',') AS licenses, count(*) FILTER (WHERE line >= 0) AS n_lines FROM top GROUP BY r)
SELECT doc_id, license, dice, line, coalesce(licenses, '') AS licenses, coalesce(n_lines, 0) AS n_lines
FROM n LEFT JOIN agg USING (r)
"""
