"""Licence scans: Dice coefficient over word bigrams against licence templates.

A text is normalised (A-Z in lower case, every run of other characters than
a-z and 0-9 a space) and compared in units: each line, each paragraph of
several lines, the whole text if it has several paragraphs, and, for every
template, each window of the text that has as many bigrams as the template,
wherever it begins and whatever lines or paragraphs it crosses. With a and b
bigrams (repeats count) and o in common, the Dice coefficient is 2 o / (a + b).
It can reach t only if t / (2 - t) * b <= a <= (2 - t) / t * b, so the sizes
alone drop most pairs: a bigram meets only templates whose size fits its unit.
Each text is read and normalised once: the places of template bigrams and the
beginnings of its lines become rows, from which units and windows are counted.

Windows are not enumerated. The i-th occurrence of a bigram that the template
has m times adds one to the overlap of the windows that begin after the
occurrence m before it and hold it, which is one interval of beginnings; a
running sum over the ends of these intervals gives the fullest window.

Native functions only. The templates are a fixed list, so their bigrams are
broadcast; only bigrams that some template has become rows.

Defined results: null, empty and short texts match nothing (license null, dice
0); of equally good matches the first template name, then the first unit, is
reported; a window is reported, and counted as a unit, only if it is better than
every line, paragraph and text of its document; repeated rows are reported row by row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spooltrace.llm.common import let, materialize

THRESHOLD = 0.8
# characters other than A-Z, a-z, 0-9 and line feed, as ranges (Java matches a negated class ten times slower)
OTHER = r"\x00-\x09\x0B-/:-@\[-`{-\x{10FFFF}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SPDX = ["AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1",
        "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"]


def _gnu_header(name: str, version: str, what: str = "program") -> str:
    return f"""This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by
        the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of
        the {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""


# fixed values: texts of public licences (whole ones in license_texts) and of the headers and notices that name them
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution.""",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details.""",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    # whole standard headers
    "agpl-3.0-header": _gnu_header("GNU Affero General Public License", "3"),
    "epl-2.0-header": """This program and the accompanying materials are made available under the terms of the Eclipse Public License
        2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "gpl-2.0-header": _gnu_header("GNU General Public License", "2"),
    "gpl-3.0-header-whole": _gnu_header("GNU General Public License", "3"),
    "lgpl-2.1-header": _gnu_header("GNU Lesser General Public License", "2.1", "library"),
    "lgpl-3.0-header": _gnu_header("GNU Lesser General Public License", "3"),
    # usual notices
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0-notice-short": "Licensed under the Apache License 2.0.",
    "bsd-2-clause-notice": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause-notice": "Licensed under the BSD 3-Clause License.",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-header": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0-notice": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to
        this work.""",
    "epl-2.0-notice": "Licensed under the Eclipse Public License, version 2.0.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "isc-notice": "Licensed under the ISC License.",
    "lgpl-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit-notice-distributed": "Distributed under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "mpl-2.0-notice": "Licensed under the Mozilla Public License, version 2.0.",
    **{f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in SPDX},
    **{f"{f.stem}-text": f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))},
}


@functools.lru_cache(maxsize=128)
def _normal(text: str) -> list[str]:
    kept = "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or "0" <= c <= "9" else " " for c in text)
    return kept.split()


def template_bigrams(templates: dict[str, str] = TEMPLATES) -> list[tuple[str, str, int, int]]:
    """(license, bigram, times, bigrams of the template)."""
    out = []
    for name, text in sorted(templates.items()):
        words = _normal(text)
        pairs = Counter(f"{a} {b}" for a, b in zip(words, words[1:]))
        out += [(name, p, n, len(words) - 1) for p, n in sorted(pairs.items())]
    return out


def _size_fits(a: Column, b: Column, t: float) -> Column:
    return (a * (2 - t) >= b * t) & (a * t <= b * (2 - t))


def size_spans(sizes: set[int], t: float) -> list[tuple[int, int]]:
    """Numbers of bigrams with which a unit can reach ``t`` against a template of one of the sizes, as joined ranges."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((max(1, math.floor(b * t / (2 - t))), math.ceil(b * (2 - t) / t)) for b in sizes):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _words(text: Column) -> Column:
    """The text's normalised words; the line feeds before a word stand at its front (those at the end alone, as a last item)."""
    kept = F.lower(F.regexp_replace(text, f"[{OTHER}]+", " "))
    lines = F.replace(F.replace(kept, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return F.split(F.btrim(F.regexp_replace(lines, "(\n+)", " $1"), F.lit(" ")), " ")


def _feeds(word: Column) -> Column:
    """Line feeds at the front of a word."""
    return F.when(F.startswith(word, F.lit("\n")), F.length(word) - F.length(F.ltrim(word, F.lit("\n")))).otherwise(F.lit(0))


def _bare(word: Column) -> Column:
    return F.when(F.startswith(word, F.lit("\n")), F.ltrim(word, F.lit("\n"))).otherwise(word)


def template_places(keyed: DataFrame, keys: list[str], text_col: str, templates: dict[str, str]) -> DataFrame:
    """Where the texts hold bigrams of the templates, and where their lines begin; the one read of the texts.

    (keys, _row, n, blocks, pos, feeds, bigram, next_feeds): ``pos`` counts words, ``n`` is their number, ``feeds`` the line
    feeds before the word, ``bigram`` the template bigram that starts there (or null), ``next_feeds`` those inside it.
    The templates' bigrams are a fixed list, tested inside the array, so that no other bigram becomes a row.
    """
    pairs = sorted({p for _, p, _, _ in template_bigrams(templates)})
    firsts = sorted({p.split(" ")[0] for p in pairs})

    def mark(ws: Column, x: Column, i: Column) -> Column:
        after = F.coalesce(F.get(ws, i + 1), F.lit(""))
        pair = F.when(_bare(x).isin(firsts), F.concat(_bare(x), F.lit(" "), _bare(after)))
        return F.struct(i.alias("pos"), _feeds(x).alias("feeds"), F.when(pair.isin(pairs), pair).alias("bigram"),
                        _feeds(after).alias("next_feeds"))

    def counted(ws: Column) -> Column:
        trailing = F.when(_bare(F.element_at(ws, -1)) == "", 1).otherwise(0)
        marks = F.filter(F.transform(ws, lambda x, i: F.when(
            F.startswith(x, F.lit("\n")) | _bare(x).isin(firsts), mark(ws, x, i))),
            lambda m: m.isNotNull() & ((m["feeds"] > 0) | m["bigram"].isNotNull()))
        return F.struct((F.size(ws) - trailing).alias("n"), marks.alias("marks"))

    rows = keyed.select(*keys, F.monotonically_increasing_id().alias("_row"),  # rows with equal keys are compared apart
                        let(_words(F.coalesce(F.col(text_col), F.lit(""))), counted).alias("t"))
    some = F.exists("t.marks", lambda m: m["bigram"].isNotNull())
    blocks = F.exists("t.marks", lambda m: m["feeds"] > 1)
    places = rows.where(some).select(*keys, "_row", "t.n", blocks.alias("blocks"), F.explode("t.marks").alias("m"))
    return materialize(places.select(*keys, "_row", "n", "blocks", "m.*"), "places")


def _full_units(places: DataFrame, keys: list[str], threshold: float = THRESHOLD,
                templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(keys, kind, no, license, dice) of every line, paragraph and text that reaches the threshold."""
    rows = template_bigrams(templates)
    known = places.sparkSession.createDataFrame(rows, "license string, bigram string, times int, size_b int")
    spans = size_spans({r[3] for r in rows}, threshold)
    row = Window.partitionBy("_row")
    so_far = row.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = row.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    line_start, block_start = (F.when(F.col("feeds") > k, F.col("pos")) for k in (0, 1))
    # of a run of line feeds, every two part blocks; one that is left over stands inside a block
    placed = (places
              .withColumn("line", F.sum("feeds").over(so_far)).withColumn("block", F.sum(F.expr("feeds div 2")).over(so_far))
              .withColumn("line_from", F.coalesce(F.last(line_start, True).over(so_far), F.lit(0)))
              .withColumn("block_from", F.coalesce(F.last(block_start, True).over(so_far), F.lit(0)))
              .withColumn("line_to", F.coalesce(F.last(line_start, True).over(ahead), F.col("n")))
              .withColumn("block_to", F.coalesce(F.last(block_start, True).over(ahead), F.col("n")))
              .withColumn("several", F.max(F.col("feeds") % 2).over(Window.partitionBy("_row", "block")) > 0)
              .where("bigram IS NOT NULL"))

    def unit(held: Column, kind: str, no: Column, words: Column) -> Column:
        size = words - 1
        fits = F.lit(False)
        for lo, hi in spans:
            fits = fits | size.between(lo, hi)
        return F.when(held & fits, F.struct(F.lit(kind).alias("kind"), no.cast("int").alias("no"), size.cast("int").alias("size_a")))

    units = F.filter(F.array(
        unit(F.col("next_feeds") == 0, "line", F.col("line"), F.col("line_to") - F.col("line_from")),
        unit((F.col("next_feeds") < 2) & F.col("several"), "paragraph", F.col("block"), F.col("block_to") - F.col("block_from")),
        unit(F.col("blocks"), "text", F.lit(0), F.col("n"))), lambda u: u.isNotNull())
    keys = [*keys, "_row"]
    inside = placed.select(*keys, "bigram", F.explode(units).alias("u")).select(*keys, "bigram", "u.*")
    met = inside.join(F.broadcast(known), "bigram").where(_size_fits(F.col("size_a"), F.col("size_b"), threshold))
    pair = [*keys, "kind", "no", "license", "size_a", "size_b"]
    shared = met.groupBy(*pair, "bigram", "times").count().withColumn("o", F.least("count", "times"))
    dice = 2 * F.col("o") / (F.col("size_a") + F.col("size_b"))
    return (shared.groupBy(*pair).agg(F.sum("o").alias("o")).withColumn("dice", dice)
            .where(F.col("dice") >= threshold).select(*keys, "kind", "no", "license", "dice").drop("_row"))


def _fullest_windows(places: DataFrame, keys: list[str], threshold: float = THRESHOLD,
                     templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(keys, kind, no, license, dice) of the fullest window of each template that reaches the threshold; ``no`` is the
    window's first word."""
    known = places.sparkSession.createDataFrame(template_bigrams(templates), "license string, bigram string, times int, size_b int")
    keys = [*keys, "_row"]
    bigrams = places.where("bigram IS NOT NULL").select(*keys, (F.col("n") - 1).alias("n"), "pos", "bigram")
    found = bigrams.groupBy(*keys, "n", "bigram").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    pair = [*keys, "license", "size_b", "n"]
    # a text that shares too few bigrams with a template as a whole has no window that reaches the threshold
    near = (found.join(F.broadcast(known), "bigram").where(F.col("n") >= F.col("size_b"))
            .groupBy(*pair).agg(F.sum(F.least(F.size("at"), "times")).alias("o"),
                                F.collect_list(F.struct("at", "times")).alias("held"))
            .where(F.col("o") >= threshold * F.col("size_b")))
    ends = F.flatten(F.transform("held", lambda g: F.flatten(F.transform(g["at"], lambda p, i: F.array(
        F.struct(F.greatest(p - F.col("size_b") + 1, F.coalesce(F.get(g["at"], i - g["times"]) + 1, F.lit(0))).alias("no"),
                 F.lit(1).alias("step")),
        F.struct((p + 1).alias("no"), F.lit(-1).alias("step")))))))
    steps = near.select(*pair, F.explode(ends).alias("e")).groupBy(*pair, "e.no").agg(F.sum("e.step").alias("step"))
    so_far = Window.partitionBy(*pair).orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = steps.withColumn("o", F.sum("step").over(so_far)).where(F.col("no") <= F.col("n") - F.col("size_b"))
    best = full.groupBy(*pair).agg(F.min(F.struct((-F.col("o")).alias("o"), "no")).alias("w"))
    dice = -F.col("w.o") / F.col("size_b")
    return (best.withColumn("dice", dice).where(F.col("dice") >= threshold)
            .select(*keys, F.lit("window").alias("kind"), "w.no", "license", "dice").drop("_row"))


def license_matches(keyed: DataFrame, keys: list[str], text_col: str = "text", threshold: float = THRESHOLD,
                    templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(keys, kind, no, license, dice) of every unit that reaches the threshold, for each row of ``keyed``."""
    return _full_units(template_places(keyed, keys, text_col, templates), keys, threshold, templates)


def window_matches(keyed: DataFrame, keys: list[str], text_col: str = "text", threshold: float = THRESHOLD,
                   templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """The same for the fullest window of each template."""
    return _fullest_windows(template_places(keyed, keys, text_col, templates), keys, threshold, templates)


def license_query(docs: DataFrame) -> DataFrame:
    """Best match of every document, and how many units matched."""
    i, t = F.col("doc_id"), F.col("text")
    keyed = docs.select("doc_id", "text", F.xxhash64(i, t).alias("k1"), F.xxhash64(t, i, F.lit(1)).alias("k2"))
    keys = ["k1", "k2"]
    places = template_places(keyed, keys, "text", TEMPLATES)
    found = _full_units(places, keys).unionByName(_fullest_windows(places, keys))
    rank = F.struct((-F.col("dice")).alias("d"), "license", "kind", "no")
    unit = F.col("kind") != "window"
    hits = found.groupBy(*keys).agg(F.min(F.when(unit, rank)).alias("unit"), F.min(F.when(~unit, rank)).alias("window"),
                                    F.count_distinct(F.when(unit, F.struct("kind", "no"))).alias("n"))
    better = F.coalesce(F.col("window.d") < F.coalesce("unit.d", F.lit(0.0)), F.lit(False))
    best = hits.select(*keys, F.when(better, F.col("window")).otherwise(F.col("unit")).alias("best"),
                       (F.col("n") + better.cast("int")).alias("n_units"))
    return keyed.select(*keys, "doc_id").join(best, keys, "left").select(
        "doc_id", F.col("best.license").alias("license"), F.coalesce(-F.col("best.d"), F.lit(0.0)).alias("dice"),
        F.concat_ws(":", "best.kind", "best.no").alias("unit"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"))


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def licenses_sql(threshold: float = THRESHOLD) -> str:
    values = ", ".join(f"({_literal(n)}, {_literal(t)})" for n, t in sorted(TEMPLATES.items()))
    clean = f"regexp_replace(translate({{}}, '{UPPER}', '{LOWER}'), '[^a-z0-9\\n]+', ' ', 'g')"
    words = "list_filter(string_split_regex({}, '[ \\n]+'), lambda w: w <> '')"
    return f"""
WITH templates(license, body) AS (VALUES {values}),
tw AS (SELECT license, {words.format(clean.format('body'))} AS w FROM templates),
tp AS (SELECT license, len(w) - 1 AS nb, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM tw),
tb AS (SELECT license, nb, p, count(*) AS cb FROM tp GROUP BY ALL),
d AS (SELECT row_number() OVER () AS rid, doc_id, {clean.format("coalesce(text, '')")} AS c FROM documents),
para AS (SELECT rid, string_split_regex(c, '\\n ?\\n') AS bs FROM d),
u AS (
    SELECT rid, 'line' AS kind, unnest(range(len(ls))) AS no, unnest(ls) AS body FROM (SELECT rid, string_split(c, chr(10)) AS ls FROM d)
    UNION ALL
    SELECT * FROM (SELECT rid, 'paragraph' AS kind, unnest(range(len(bs))) AS no, unnest(bs) AS body FROM para)
    WHERE contains(trim(body), chr(10))
    UNION ALL SELECT rid, 'text', 0, c FROM d JOIN para USING (rid) WHERE len(bs) > 1),
w AS (SELECT rid, kind, no, {words.format('body')} AS w FROM u),
g AS (SELECT rid, kind, no, len(w) - 1 AS na, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM w),
a AS (SELECT rid, kind, no, na, p, count(*) AS ca FROM g GROUP BY ALL),
m AS (
    SELECT rid, kind, no, license, 2.0::DOUBLE * sum(least(ca, cb))::DOUBLE / (na + nb) AS dice
    FROM a JOIN tb USING (p) GROUP BY rid, kind, no, na, license, nb),
hit AS (SELECT * FROM m WHERE dice >= {threshold}),
best AS (
    SELECT rid, min(struct_pack(d := -dice, license := license, kind := kind, no := no)) AS b, count(DISTINCT (kind, no)) AS n_units
    FROM hit GROUP BY rid)
SELECT doc_id, b.license AS license, coalesce(-b.d, 0.0)::DOUBLE AS dice,
    CASE WHEN b IS NULL THEN '' ELSE b.kind || ':' || b.no END AS unit, coalesce(n_units, 0)::BIGINT AS n_units
FROM d LEFT JOIN best USING (rid)
"""
