"""Licence scans: Dice coefficient over word bigrams against templates.

A text is cut into lines, blank-line paragraphs and the whole text; each segment
is normalised (lower case, runs of other than a-z and 0-9 become one blank) and
its set of word bigrams is compared with every template whose size allows the
threshold: Dice >= t needs |A| between t / (2 - t) |B| and (2 - t) / t |B|.

A licence that no segment shows may share its line with other words or span
paragraphs, so windows of the whole text's words are compared with its templates.
A window starts and ends with one of the template's bigrams and has at most
(2 / t - 2) |B| others in it, repeats included; growing over a run of the template's
bigrams never lowers Dice, so only windows from run to run are tried.  A window below the template's size counts with |A| = |B|, as if the
words around it were inside: else "Apache License, Version 1.1" in a sentence would
be cut to the words it shares with version 2.0.

Segments are only made of texts with one of the anchor words.  The anchors are
derived so that more than 1 - t / (2 - t) of each template's bigrams hold one,
and a segment at the threshold shares t / (2 - t) of them at least, so a segment
(or window) without an anchor cannot match: the test prunes, it loses nothing.

All of it is arithmetic within a row: no join, no shuffle, no expansion to rows;
templates are constants of the code.  Null, empty and unmatched texts give 0
matches with empty names and dice 0; repeated rows get equal results; equal Dice
goes to the first name; an empty table gives an empty result; a long text is read
whole, and one with an anchor has its bigrams in memory; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.llm.common import table

THRESHOLD = 0.8

# Notices of public licences in the words their stewards publish,
# and the usual one-line statements.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "GFDL-1.3": ("GNU Free Documentation License Version 1.3, 3 November 2008",),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Creative Commons Legal Code CC0 1.0 Universal"),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "All-Rights-Reserved": ("Copyright (c) All rights reserved.", "All rights reserved."),
}


# Words of most English texts, the last choice for anchors.
COMMON = frozenset("a all an and any are as at be by can do for from if in is it its may no not of on or our shall such that the these this those to under was we which will with without you your".split())


def bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).strip().split(" ")
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))  # noqa: B905


def least_share(threshold: float) -> float:
    """The smaller set's share of the larger that the threshold allows; less by a
    trifle, as rounding must not prune a Dice of just the threshold."""
    return threshold / (2 - threshold) - 1e-9


def anchors(templates: dict[str, tuple[str, ...]], threshold: float) -> list[str]:
    """Words, rare, long and shared ones first, of which each template has one in
    more of its bigrams than a match may lack."""
    share = threshold / (2 - threshold)
    sets = [bigrams(t) for ts in templates.values() for t in ts]
    found: list[str] = []

    def lacks(grams: list[str]) -> bool:
        return sum(any(w in found for w in g.split(" ")) for g in grams) <= len(grams) - share * len(grams)

    while short := [g for g in sets if lacks(g)]:
        score = Counter(w for grams in short for g in grams for w in set(g.split(" ")) if w not in found and not any(x in found for x in g.split(" ")))
        found.append(max(score, key=lambda w: (w not in COMMON, len(w) >= 7, len(w) >= 4, score[w], w)))
    return sorted(found)


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_matches (segment and licence pairs at the threshold, and one for
    each licence that only windows show), licenses (names, sorted, comma-joined), best_license and best_dice (ties: first by
    name) of every row."""
    rows = [(name, bigrams(t)) for name, ts in templates.items() for t in ts]
    lits: list[Column] = [F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, g)).alias("g")) for n, g in rows]
    every = F.array(*map(F.lit, dict.fromkeys(x for _, g in rows for x in g)))
    share = least_share(threshold)
    made = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.array(*lits).alias("templates"), every.alias("every"))
    segments = r"array_distinct(concat(split(t, '\n'), split(t, '\\n[ \\t\\r]*\\n'), array(t)))"
    rx = anchor_regex(templates, threshold)
    words = "array(split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ')), ' '))"
    pairs = "transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1]))"
    grams = """transform(filter({0}, s -> lower(s) RLIKE '{1}'), s ->
        transform({2}, w -> IF(size(w) < 2, cast(array() AS array<string>), array_distinct({3})))[0])"""
    grams = grams.format(segments, rx.replace("\\", "\\\\"), words.format("s"), pairs)
    none = "cast(array() AS array<struct<dice: double, name: string>>)"
    found = f"""flatten(transform(grams, a -> filter(
        transform(filter(templates, b -> size(a) >= {share}D * size(b.g) AND size(a) * {share}D <= size(b.g)),
            b -> struct(2D * size(array_intersect(a, b.g)) / (size(a) + size(b.g)) AS dice, b.name AS name)),
        x -> x.dice >= {threshold}D)))"""
    # the last segment is the whole text; a window shares threshold * |B| bigrams at least
    hidden = f"""transform(array(array_intersect(element_at(grams, -1), every)), known ->
        filter(templates, b -> size(array_intersect(known, b.g)) / size(b.g) >= {threshold}D AND NOT exists(found, x -> x.name = b.name)))[0]"""
    # p: places of the template's bigrams; q: other bigrams before each; f, l: first and last of each run, as indices of p
    slack = 2 / threshold - 2
    window = f"""transform(array(filter(sequence(0, size(s) - 1), i -> array_contains(b.g, s[i]))), p -> transform(array(transform(p, (i, k) -> i - k)), q ->
        transform(array(struct(filter(sequence(0, size(p) - 1), k -> k = 0 OR q[k - 1] < q[k]) AS f, filter(sequence(0, size(p) - 1), k -> k = size(p) - 1 OR q[k + 1] > q[k]) AS l)), r ->
            array_max(flatten(transform(r.f, (a, j) -> transform(
                filter(slice(r.l, j + 1, int({slack}D * size(b.g)) + 1), e -> q[e] - q[a] <= {slack}D * size(b.g) AND (e - a + 1) / size(b.g) >= {threshold}D),
                e -> transform(array(slice(s, p[a] + 1, p[e] - p[a] + 1)), x ->
                    2D * size(array_intersect(x, b.g)) / (greatest(size(array_distinct(x)), size(b.g)) + size(b.g)))[0])))))[0])[0])[0]"""
    inside = f"""transform(array(filter(transform(hidden, b -> struct({window} AS dice, b.name AS name)), x -> x.dice >= {threshold}D)), m ->
        transform(array_distinct(transform(m, x -> x.name)), n -> struct(array_max(transform(filter(m, x -> x.name = n), x -> x.dice)) AS dice, n AS name)))[0]"""
    inside = f"IF(size(hidden) = 0, {none}, transform(transform({words.format('t')}, w -> {pairs}), s -> {inside})[0])"
    found = f"transform(array({found}), found -> concat(found, transform(array({hidden}), hidden -> {inside})[0]))[0]"
    found = f"transform(array({grams}), grams -> {found})[0]"
    made = made.withColumn("m", F.expr(f"IF(lower(t) RLIKE '{rx.replace(chr(92), chr(92) * 2)}', {found}, {none})"))
    best = F.expr("array_min(transform(m, x -> struct(-x.dice AS d, x.name AS name)))")
    made = made.select("doc_id", "m", best.alias("best"))
    return made.select(
        "doc_id", F.size("m").cast("long").alias("n_matches"), F.expr("array_join(array_sort(array_distinct(transform(m, x -> x.name))), ',')").alias("licenses"),
        F.coalesce("best.name", F.lit("")).alias("best_license"), F.coalesce(F.round(-F.col("best.d"), 6), F.lit(0.0)).alias("best_dice"),
    )


def anchor_regex(templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    return "(?<![a-z0-9])(?:" + "|".join(anchors(templates, threshold)) + ")(?![a-z0-9])"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Segments, then every window of the templates that no segment shows."""
    rows = ", ".join("({}, '{}', [{}])".format(i, n, ", ".join(f"'{x}'" for x in bigrams(t))) for i, (n, t) in enumerate((n, t) for n, ts in TEMPLATES.items() for t in ts))
    share, slack = least_share(THRESHOLD), 2 / THRESHOLD - 2
    return rf"""
WITH templates(tid, name, g) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
segs AS (SELECT DISTINCT r, s FROM (
  SELECT r, unnest(string_split(t, chr(10))) AS s FROM docs UNION ALL SELECT r, unnest(regexp_split_to_array(t, '\n[ \t\r]*\n')) FROM docs UNION ALL SELECT r, t FROM docs)),
words AS (SELECT r, string_split(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM segs),
grams AS (SELECT r, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS a FROM words WHERE len(w) >= 2),
hits AS (SELECT * FROM (SELECT r, name, 2.0::DOUBLE * len(list_intersect(a, g)) / (len(a) + len(g)) AS dice FROM grams, templates
  WHERE len(a) >= {share}::DOUBLE * len(g) AND len(a) * {share}::DOUBLE <= len(g)) WHERE dice >= {THRESHOLD}::DOUBLE),
whole AS (SELECT r, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] AS s FROM (
  SELECT r, string_split(trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM docs) WHERE len(w) >= 2),
parts AS (SELECT tid, name, len(g) AS n, unnest(g) AS x FROM templates),
spots AS (SELECT r, i, s[i] AS x FROM (SELECT r, s, unnest(range(1, len(s) + 1)) AS i FROM whole) WHERE s[i] IN (SELECT x FROM parts)),
hidden AS (SELECT r, tid, name, n FROM spots JOIN parts USING (x) WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.r = spots.r AND h.name = parts.name)
  GROUP BY ALL HAVING count(DISTINCT x) / n >= {THRESHOLD}::DOUBLE),
places AS (SELECT r, tid, name, n, i, row_number() OVER (PARTITION BY r, tid ORDER BY i) AS k FROM hidden JOIN spots USING (r) JOIN parts USING (tid, name, n, x)),
spans AS (SELECT r, tid, name, a.i AS lo, e.i AS hi FROM places a JOIN places e USING (r, tid, name, n)
  WHERE e.k >= a.k AND (e.i - e.k) - (a.i - a.k) <= {slack}::DOUBLE * n AND (e.k - a.k + 1) / n >= {THRESHOLD}::DOUBLE),
inside AS (SELECT r, name, max(2.0::DOUBLE * len(list_intersect(x, g)) / (greatest(len(x), len(g)) + len(g))) AS dice
  FROM (SELECT r, tid, p.name, g, list_distinct(s[lo : hi]) AS x FROM spans p JOIN whole USING (r) JOIN templates USING (tid)) GROUP BY r, name),
found AS (SELECT * FROM hits UNION ALL SELECT * FROM inside WHERE dice >= {THRESHOLD}::DOUBLE),
good AS (SELECT r, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, arg_min(name, {{'d': -dice, 'n': name}}) AS best, max(dice) AS dice FROM found GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_matches, coalesce(names, '') AS licenses, coalesce(best, '') AS best_license, coalesce(round(dice, 6), 0.0::DOUBLE) AS best_dice
FROM docs LEFT JOIN good USING (r)
"""


SQL = _sql()
