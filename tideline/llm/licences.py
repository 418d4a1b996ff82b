"""Licence scan: lines, paragraphs and whole texts against licence templates by Dice coefficient.

Text and templates are lower-cased and every run of ASCII characters other than letters and digits is
a gap; what remains are words. Two word sequences are as alike as twice the bigrams they share, with
repeats, over the bigrams of both. The score of a unit of n bigrams against a template of m is at most
2 min(n, m) / (n + m), so most units meet no template at all and long ones cost nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

GAP = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"

# Notices and short texts of public licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "reserved": ("All rights reserved.",),
}


def bigrams(text: str) -> Counter:
    words = re.sub(GAP, " ", text.lower()).split()
    return Counter(map(" ".join, zip(words, words[1:])))


def anchors(counts: Counter, threshold: float) -> set[str]:
    """Words of which a unit must hold one to reach the threshold against a template.

    With s of the template's m bigrams shared, a unit has at least s, so the score is at most
    2 s / (s + m): s has to be m t / (2 - t) or more. Without any of the returned words the unit
    misses more bigrams than that leaves. Long words are taken first, as they are seldom elsewhere.
    """
    m = counts.total()
    spare = m - math.ceil(m * threshold / (2 - threshold) - 1e-9)
    taken: set[str] = set()
    for word in sorted({w for g in counts for w in g.split()}, key=lambda w: (-len(w), w)):
        taken.add(word)
        if sum(c for g, c in counts.items() if not taken.isdisjoint(g.split())) > spare:
            break
    return taken


def _grams(words: Column) -> Column:
    ahead = F.slice(words, F.lit(2), F.size(words) - 1)
    return F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), ahead, lambda a, b: F.concat_ws(" ", a, b))


def scan(
    df: DataFrame,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    threshold: float = 0.8,
    text: str = "text",
    out: str = "hits",
) -> DataFrame:
    """Add ``hits``: for each unit that is like a template, its best one.

    Units are the lines, the paragraphs of several lines (between empty lines), and the whole text
    where it has several paragraphs. A hit has the unit's kind and number in the text, the licence
    and the score, at least ``threshold``; of equal scores the template that comes first wins. A
    null text counts as empty and has no hits. A template needs at least two words.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    known = [(name, counts) for name, texts in templates.items() for t in texts if (counts := bigrams(t))]
    if not known:
        raise ValueError("no template has two words")
    table = F.array(
        *[
            F.struct(
                F.lit(-k).alias("rank"),
                F.lit(name).alias("licence"),
                F.lit(sum(counts.values())).alias("n"),
                F.array(*[F.lit(g) for g in counts]).alias("grams"),
                F.array(*[F.lit(c) for c in counts.values()]).alias("counts"),
            )
            for k, (name, counts) in enumerate(known)
        ]
    )
    sizes = [sum(counts.values()) for _, counts in known]
    least, most = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold
    needed = F.array(*map(F.lit, sorted(set().union(*[anchors(counts, threshold) for _, counts in known]))))
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), GAP, " ")

    def units(kind: str, parts: Column, wanted) -> Column:
        named = F.transform(
            parts,
            lambda p, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("number"), F.array_remove(F.split(p, "[ \n]+"), "").alias("words"), p.alias("p")),
        )
        fitting = F.filter(named, lambda u: wanted(u["p"]) & (F.size(u["words"]) - 1).between(least, most) & F.arrays_overlap(u["words"], "_needed"))
        return F.transform(fitting, lambda u: F.struct(u["kind"].alias("kind"), u["number"].alias("number"), _grams(u["words"]).alias("grams")))

    def best(unit: Column) -> Column:
        n = F.size(unit["grams"])
        fitting = F.filter("_templates", lambda t: 2 * F.least(n, t["n"]) >= threshold * (n + t["n"]))

        def shared(t: Column) -> Column:
            each = F.zip_with(t["grams"], t["counts"], lambda g, c: F.least(c, n - F.size(F.array_remove(unit["grams"], g))))
            return F.aggregate(each, F.lit(0), lambda a, b: a + b)

        scores = F.transform(
            fitting, lambda t: F.struct((2.0 * shared(t) / (n + t["n"])).alias("score"), t["rank"].alias("rank"), t["licence"].alias("licence"))
        )
        return F.array_max(scores)

    step = (
        df.withColumn("_plain", plain)
        .withColumn("_blocks", F.split("_plain", "\n *\n[ \n]*"))
        .withColumn("_templates", table)
        .withColumn("_needed", needed)
        .withColumn(
            "_units",
            # Most texts have none of the words that a template calls for.
            F.when(F.arrays_overlap(F.split("_plain", "[ \n]+"), "_needed"), F.concat(
                units("line", F.split("_plain", "\n"), lambda p: F.lit(True)),
                units("paragraph", F.col("_blocks"), lambda p: F.contains(p, F.lit("\n"))),
                units("text", F.when(F.size("_blocks") > 1, F.array("_plain")).otherwise(F.array().cast("array<string>")), lambda p: F.lit(True)),
            )).otherwise(F.array().cast("array<struct<kind:string,number:int,grams:array<string>>>")),
        )
    )
    scored = F.transform("_units", lambda u: F.struct(u["kind"].alias("kind"), u["number"].alias("number"), best(u).alias("best")))
    hits = F.transform(
        F.filter("_scored", lambda s: F.coalesce(s["best"]["score"] >= threshold, F.lit(False))),
        lambda s: F.struct(s["kind"].alias("kind"), s["number"].alias("number"), s["best"]["licence"].alias("licence"), s["best"]["score"].alias("score"), s["best"]["rank"].alias("rank")),
    )
    kept = [c for c in df.columns if c != out]
    # Generators, so that no later projection or filter repeats the work.
    return step.select(*kept, F.explode(F.array(scored)).alias("_scored")).select(*kept, hits.alias(out))


def summary(hits: Column) -> list[Column]:
    """``licence`` and ``score`` of the best hit (null without one) and ``n_hits``."""
    top = F.array_max(F.transform(hits, lambda h: F.struct(h["score"].alias("score"), h["rank"].alias("rank"), h["licence"].alias("licence"))))
    return [top["licence"].alias("licence"), top["score"].alias("score"), F.size(hits).cast("long").alias("n_hits")]
