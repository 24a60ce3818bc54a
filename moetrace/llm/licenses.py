"""License scans: units of text against licence templates by the Dice coefficient over word bigrams.

A unit is a line, or the whole text (line -1) where it has more than one line. Texts are normalised (A-Z lower-cased,
other than a-z and 0-9 a separator); a unit's distinct bigrams are compared with those of each template whose number of
bigrams lies within the bounds that the threshold sets: with a and b bigrams, Dice is at most 2 min(a, b) / (a + b).
Texts without any of the words that every match must hold are passed over at once.
Word windows slide over the whole normalised text too, line breaks or not: for each template of which the text holds
enough bigrams, the best window from each of them on, up to the size bound. Of overlapping windows the best stays; one
on a line, or in a text, that is itself a match with the same template is that match and not given again. A window's
line is the one it begins on.
Everything is DataFrame functions without a shuffle.

Defined results: null and empty texts and units of fewer than two words match nothing; repeated rows each give their
matches; a unit may match several templates."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient of a match, in hundredths.
PERCENT = 80
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Names and wording of common licence notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "Copyright. All rights reserved.",
}


def _plain(text: str) -> list[str]:
    low = text.translate(str.maketrans(UPPER, LOWER))
    return "".join(c if c in LOWER or c in "0123456789" else " " for c in low).split()


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    return {k: sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}) for k, v in templates.items() if len(w := _plain(v)) > 1}


def keywords(known: dict[str, list[str]], percent: int) -> list[str]:
    """Words of which every possible match holds at least one.

    A match shares at least percent / (200 - percent) of the template's bigrams, so words that stand in so many of them
    that fewer than that are left stand in every match. Long words are taken first: they are the rarest."""
    out: list[str] = []
    for grams in sorted(known.values(), key=len):
        need = -(-percent * len(grams) // (200 - percent))
        left = [set(g.split()) for g in grams if not set(g.split()) & set(out)]
        while len(left) >= need:
            words = {w for g in left for w in g}
            word = max(words, key=lambda w: (min(len(w), 7), sum(w in g for g in left), w))
            out.append(word)
            left = [g for g in left if word not in g]
    return out


def _bigrams(words: str) -> Column:
    return F.expr(f"array_distinct(zip_with(slice({words}, 1, size({words}) - 1), slice({words}, 2, size({words}) - 1), (a, b) -> concat(a, ' ', b)))")


def _windows(docs: DataFrame, known: dict[str, list[str]], listed: Column, percent: int) -> DataFrame:
    """Matches of word windows that are no units."""
    every = F.array(*map(F.lit, sorted({g for b in known.values() for g in b})))
    words = F.split(F.trim(F.regexp_replace(F.translate("text", UPPER, LOWER), "[^a-z0-9]+", " ")), " ")
    at = docs.select("doc_id", "text", words.alias("_words")).select("doc_id", "text", _bigrams("_words").alias("_set"))
    # Few texts hold any bigram of a template: templates are compared with those that do only.
    at = at.select("doc_id", "text", F.size("_set").alias("_n"), F.array_intersect("_set", every).alias("_any"))
    # A match shares at least percent / (200 - percent) of the template's bigrams; a text that is a match as a whole has its row.
    shared = lambda t: F.size(F.array_intersect("_any", t["grams"]))
    may = F.filter(listed, lambda t: (200 - percent) * F.least(F.size("_any"), t["n"]) >= percent * t["n"])
    # An inner explode would be filtered by its own array first, which makes the bigrams anew for each template.
    at = at.select("doc_id", "text", "_n", "_any", F.explode_outer(may).alias("t"))
    at = at.where((200 - percent) * shared(F.col("t")) >= percent * F.col("t.n")).where(200 * shared(F.col("t")) < percent * (F.col("_n") + F.col("t.n")))
    plain = f"split(trim(regexp_replace(translate(l, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ')), ' ')"
    at = at.select("doc_id", "t", F.expr(f"flatten(transform(split(text, '\n', -1), (l, k) -> transform(filter({plain}, w -> w <> ''), w -> struct(w, k))))").alias("_w"))
    at = at.select("doc_id", "t", F.expr("transform(_w, w -> w.k)").alias("_k"), F.expr("zip_with(slice(_w, 1, size(_w) - 1), slice(_w, 2, size(_w) - 1), (a, b) -> concat(a.w, ' ', b.w))").alias("_g"))
    # A bigram is new in the windows that begin after the place before it that has the same one.
    placed = "array_sort(transform(_g, (g, i) -> struct(g, i)))"
    before = "zip_with(_s, concat(array(cast(null as struct<g:string,i:int>)), slice(_s, 1, size(_s) - 1)), (x, y) -> struct(x.i as i, if(x.g = y.g, y.i, -1) as prev, array_contains(t.grams, x.g) as own))"
    at = at.select("*", F.expr(placed).alias("_s"))
    at = at.select("doc_id", "_k", "_g", "t", F.expr(f"array_sort({before})").alias("_p"))
    span = f"slice(_p, x.i + 1, t.w * {200 - percent} div {percent} + 1)"
    new = "cast(y.prev < x.i as int)"
    own = "cast(y.prev < x.i and y.own as int)"
    better = f"y.own and (a.s + {own}) * cast(a.sum as bigint) > a.shared * cast(a.d + {new} + t.n as bigint)"
    grown = f"""aggregate({span}, struct(0 as s, 0 as d, 0 as shared, 1 as sum, 0 as upto),
      (a, y) -> struct(a.s + {own} as s, a.d + {new} as d, if({better}, a.s + {own}, a.shared) as shared, if({better}, a.d + {new} + t.n, a.sum) as sum, if({better}, y.i, a.upto) as upto),
      a -> struct(x.i as at, a.upto as upto, a.shared as shared, a.sum as sum))"""
    starts = f"filter(_p, x -> x.own and {200 - percent} * size(filter({span}, y -> y.own)) >= {percent} * t.n)"
    at = at.select("doc_id", "_k", "_g", "t", F.expr(f"filter(transform({starts}, x -> {grown}), x -> 200 * x.shared >= {percent} * x.sum)").alias("_f"))
    best = """aggregate(_f, cast(array() as array<struct<at:int,upto:int,shared:int,sum:int>>), (a, x) -> case when size(a) = 0 or x.at > element_at(a, -1).upto + 1 then concat(a, array(x))
      when x.shared * cast(element_at(a, -1).sum as bigint) > element_at(a, -1).shared * cast(x.sum as bigint) then concat(slice(a, 1, size(a) - 1), array(x)) else a end)"""
    at = at.select("doc_id", "_k", "_g", "t", F.explode_outer(F.expr(best)).alias("x")).where("x is not null")
    line = "array_distinct(filter(_g, (g, i) -> _k[i] = k and _k[i + 1] = k))"
    unit = f"exists(transform(sequence(_k[x.at], _k[x.upto + 1]), k -> {line}), u -> 200 * size(array_intersect(u, t.grams)) >= {percent} * (size(u) + t.n))"
    return at.where(f"not {unit}").select("doc_id", F.expr("_k[x.at]").alias("line"), F.col("t.license").alias("license"), F.col("x.shared").cast("long").alias("shared"), F.round(2 * F.col("x.shared") / F.col("x.sum"), 6).alias("dice"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """doc_id, line, license, shared, dice: one row per match of a unit with a template."""
    known = template_bigrams(templates)
    most = max(len(b) for b in known.values()) * (200 - percent) // percent + 1
    listed = F.array(*[F.struct(F.lit(k).alias("license"), F.array(*map(F.lit, b)).alias("grams"), F.lit(len(b)).alias("n"), F.lit(len(_plain(templates[k])) - 1).alias("w")) for k, b in known.items()])
    low = F.lower("text")
    # A short word would be found inside many others, so its edges count.
    has = [low.contains(w) if len(w) > 4 else low.contains(w) & low.rlike(f"(?<![a-z0-9]){w}(?![a-z0-9])") for w in keywords(known, percent)]
    docs = docs.where(reduce(or_, has))
    windows = _windows(docs, known, listed, percent)
    lines = F.split("text", "\n", -1)
    units = F.when(F.size(lines) > 1, F.concat(F.array("text"), lines)).otherwise(lines)
    at = docs.select("doc_id", F.size(lines).alias("_many"), F.posexplode(units).alias("_at", "_unit"))
    at = at.withColumn("line", F.when(F.col("_many") > 1, F.col("_at") - 1).otherwise(F.col("_at")).cast("int"))
    plain = F.trim(F.regexp_replace(F.translate("_unit", UPPER, LOWER), "[^a-z0-9]+", " "))
    at = at.select("doc_id", "line", F.split(plain, " ").alias("_words")).where("size(_words) > 1")
    # A unit of w words has at most w - 1 distinct bigrams, and may have far fewer: only long runs of one word do.
    at = at.withColumn("_grams", _bigrams("_words")).where(F.size("_grams") <= most)
    near = F.filter(listed, lambda t: (2 * 100 * F.least(t["n"], F.size("_grams")) >= percent * (t["n"] + F.size("_grams"))))
    hits = F.transform(near, lambda t: F.struct(t["license"].alias("license"), F.size(F.array_intersect("_grams", t["grams"])).alias("shared"), (t["n"] + F.size("_grams")).alias("sum")))
    at = at.select("doc_id", "line", F.explode(hits).alias("_hit")).where(200 * F.col("_hit.shared") >= percent * F.col("_hit.sum"))
    units = at.select("doc_id", "line", F.col("_hit.license").alias("license"), F.col("_hit.shared").cast("long").alias("shared"), F.round(2 * F.col("_hit.shared") / F.col("_hit.sum"), 6).alias("dice"))
    return units.unionByName(windows)


def oracle(templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> str:
    """The same in DuckDB SQL over the view documents."""
    rows = ", ".join(f"('{k}', [{', '.join(repr(x) for x in b)}])" for k, b in template_bigrams(templates).items())
    return f"""
    WITH t(license, grams) AS (VALUES {rows}),
    d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, CAST(i - 1 AS INT) AS line, ls[i] AS unit FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM d)
          UNION ALL SELECT doc_id, CAST(-1 AS INT), text FROM d WHERE len(ls) > 1),
    w AS (SELECT doc_id, line, string_split(trim(regexp_replace(translate(unit, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM u),
    g AS (SELECT doc_id, line, list_distinct(list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1])) AS grams FROM w WHERE len(ws) > 1),
    p AS (SELECT doc_id, line, license, len(list_intersect(g.grams, t.grams)) AS shared, len(g.grams) + len(t.grams) AS n_both FROM g, t
          WHERE 200 * least(len(g.grams), len(t.grams)) >= {percent} * (len(g.grams) + len(t.grams)))
    SELECT doc_id, line, license, CAST(shared AS BIGINT) AS shared, round(2 * CAST(shared AS DOUBLE) / n_both, 6) AS dice FROM p WHERE 200 * shared >= {percent} * n_both"""
