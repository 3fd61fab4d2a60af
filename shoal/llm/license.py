"""Licence scans: Dice coefficient of word bigrams between windows of a text and licence templates.

Only DataFrame expressions are used. Text and templates are put in normal form (lower case, runs
of other characters than a-z and 0-9 as one blank), so that line ends, comment marks and
punctuation don't count. A window is as many consecutive words as the template has; a text
of fewer words is one window. Its coefficient is twice the number of shared bigrams over
the number of bigrams of both, each counted as often as it occurs. Every window of
every text counts, wherever a notice begins.

Three bounds keep this cheap, and lose nothing. A text must be long enough for a template at
all. It must hold one of a few rare bigrams of it: so many that a text without any of them
can share too little. And a shared bigram counts for a range of window starts, so that
running sums over the ends of these ranges give all windows' counts at once.

A window that reaches the coefficient is a match, unless a better one, of any template, covers
at least a third of its words.

Defined results: null and empty texts, and texts of fewer than two words, match nothing;
very long texts are scanned whole; of equally good matches the longer counts, then the first by
name, then by place; repeated rows and null ids each give their rows; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.runtime import durable

#: Least coefficient of a match.
LEAST_DICE = 0.8
#: Words too common to tell a licence by.
COMMON = set("a an and any any as at be by for from in is it its may not of on or other that the this to use with you".split())
#: Licence notices as they stand in files, and short licences whole.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause": "Licensed under the BSD 3-Clause License.",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "boost-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def template_bigrams() -> dict[str, list[str]]:
    """The word bigrams of every template, in order, repeats included."""
    out = {}
    for name, text in sorted(TEMPLATES.items()):
        words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
        out[name] = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return out


def least_size(t: int, least: float) -> int:
    """The fewest bigrams of a window that can reach the coefficient with a template of ``t``: 2 * n / (n + t) >= least."""
    return next(n for n in range(1, t + 1) if 2.0 * n / (n + t) >= least)


def least_shared(t: int, least: float) -> int:
    """The fewest shared bigrams of any window that reaches the coefficient; a little less where rounding could matter."""
    return max(1, ceil(least * (least_size(t, least) + t) / 2 - 1e-9))


def anchors(least: float) -> list[str]:
    """Bigrams of which a text holds one at least, if it reaches the coefficient with any template; the rarest by their words."""
    chosen: set[str] = set()
    for own in template_bigrams().values():
        counts = Counter(own)
        common = lambda g: sum(w in COMMON for w in g.split())
        missing = len(own) - least_shared(len(own), least) + 1
        for g in sorted(counts, key=lambda g: (common(g), g not in chosen, g)):
            if missing <= 0:
                break
            chosen.add(g)
            missing -= counts[g]
    return sorted(chosen)


def any_of(phrases: list[str]) -> str:
    """A pattern of the phrases in a raw text, whatever separates their words; a tree by letters, so that most places fail at once."""

    def branch(rest: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for r in rest:
            if r:
                heads.setdefault(r[0], []).append(r[1:])
        parts = [("[^A-Za-z0-9]+" if h == " " else h) + branch(own) for h, own in sorted(heads.items())]
        if "" in rest:
            parts.append("(?![A-Za-z0-9])")
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return f"(?i)(?<![A-Za-z0-9]){branch(phrases)}"


def scan(docs: DataFrame, least: float = LEAST_DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, word, n_words, dice): the matches; ``word`` counts the words of the normal form from 0."""
    spark = docs.sparkSession
    templates = template_bigrams()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(any_of(anchors(least))))
    normal = F.trim(F.lower(F.regexp_replace("text", "[^A-Za-z0-9]+", " ")))
    # two hashes stand for a text: equal texts are scanned once, however many there are
    passing = durable(rows.select("id", F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("h2"), normal.alias("t")), "licence_texts")
    key = ["h", "h2"]
    distinct = passing.groupBy(*key).agg(F.first("t").alias("t"))
    w = F.split("t", " ")
    n = F.size("w") - 1
    paired = distinct.select(*key, w.alias("w")).filter(n > 0).select(*key, n.alias("n"), F.zip_with(F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)).alias("b"))
    grams = [(name, g, c, len(own), least_size(len(own), least)) for name, own in templates.items() for g, c in sorted(Counter(own).items())]
    table = F.broadcast(spark.createDataFrame(grams, "license string, gram string, c int, t int, least_n int"))  # fixed, some thousand rows
    hits = paired.select(*key, "n", F.posexplode("b").alias("p", "gram")).join(table, "gram").filter(F.col("n") >= F.col("least_n"))
    own = [*key, "license"]
    # one text and template in one task; the sums below need no further shuffle
    hits = hits.repartition(*own).groupBy(*own, "gram", "c", "t", "n").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    # a place counts for the windows that hold it, unless they hold ``c`` earlier places of its bigram
    each = hits.select(*own, "t", "n", F.inline(F.transform("ps", lambda p, i: F.struct(p.alias("p"), F.when(i >= F.col("c"), F.get("ps", i - F.col("c"))).alias("before")))))
    begin = F.greatest(F.coalesce(F.col("before") + 1, F.lit(0)), F.col("p") - F.col("t") + 1, F.lit(0))
    end = F.least(F.col("p"), F.greatest(F.col("n") - F.col("t"), F.lit(0)))
    ranges = each.select(*own, "t", "n", begin.alias("begin"), end.alias("end")).filter("begin <= end")
    ends = ranges.select(*own, "t", "n", F.inline(F.array(F.struct(F.col("begin").alias("s"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("s"), F.lit(-1).alias("d")))))
    steps = ends.groupBy(*own, "t", "n", "s").agg(F.sum("d").alias("d"))
    by_place = Window.partitionBy(*own).orderBy("s")
    size = F.least("n", "t")
    counted = steps.select(*own, "t", "n", "s", F.sum("d").over(by_place).alias("shared"), F.lead("s").over(by_place).alias("until"))
    good = counted.select(*own, (size + 1).alias("words"), "s", (F.col("until") - 1).alias("last"), (F.lit(2.0) * F.col("shared") / (size + F.col("t"))).alias("dice"))
    # starts s..last have the same coefficient, so only the first can be best; nor can it be if the start just before or after them is better
    good = good.filter(F.col("dice") >= least)
    before, after = F.lag(F.struct("last", "dice")).over(by_place), F.lead(F.struct("s", "dice")).over(by_place)
    beaten = ((before["last"] + 1 == F.col("s")) & (before["dice"] >= F.col("dice"))) | ((F.col("last") + 1 == after["s"]) & (after["dice"] > F.col("dice")))
    matches = durable(good.withColumn("beaten", F.coalesce(beaten, F.lit(False))), "licence_matches")
    # a match and the windows that might cover it meet in stretches of the longest window
    longest = max(len(b) for b in templates.values()) + 1
    stretches = lambda to: F.explode(F.sequence(F.floor(F.col("s") / longest), F.floor((to + F.col("words") - 1) / longest))).alias("stretch")
    peaks = matches.filter(~F.col("beaten"))
    rank = lambda m: F.struct(-F.col(f"{m}.dice"), -F.col(f"{m}.words"), F.col(f"{m}.license"), F.col(f"{m}.s"))
    # of the starts that b stands for, one that shares the most words with a
    start = F.least("b.last", F.greatest("b.s", F.least(F.col("a.s"), F.expr("a.s + a.words - b.words"))))
    common = F.least(F.expr("a.s + a.words"), start + F.col("b.words")) - F.greatest(F.col("a.s"), start)
    lost = (
        peaks.select("*", stretches(F.col("s"))).alias("a")
        .join(matches.select("*", stretches(F.col("last"))).alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*key, "stretch")])
        .filter((rank("b") < rank("a")) & (3 * common >= F.col("a.words")))
        .select(*[F.col(f"a.{c}") for c in (*own, "s")]).distinct()
    )
    kept = peaks.join(lost, [*own, "s"], "left_anti")
    found = passing.select("id", *key).join(kept, key)
    return found.select(F.col("id").alias(id_col), "license", F.col("s").cast("long").alias("word"), F.col("words").cast("long").alias("n_words"), "dice")


def scan_sql(least: float = LEAST_DICE) -> str:
    """The definition over the table ``documents`` in DuckDB's SQL: every window's bigrams counted one by one."""
    values = ", ".join(f"('{name}', [{', '.join(repr(b) for b in own)}])" for name, own in template_bigrams().items())
    return f"""
WITH templates(license, tb) AS (VALUES {values}),
wanted AS (SELECT license, gram, count(*) AS c, any_value(t) AS t FROM (SELECT license, unnest(tb) AS gram, len(tb) AS t FROM templates) GROUP BY license, gram),
worded AS (SELECT row_number() OVER () AS r, doc_id, string_split(trim(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS w FROM documents WHERE text IS NOT NULL),
grams AS (SELECT r, doc_id, len(w) - 1 AS n, unnest(range(len(w) - 1)) AS p, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM worded WHERE len(w) > 1),
held AS (SELECT r, doc_id, n, license, t, gram, c, unnest(range(greatest(p - t + 1, 0), least(p, greatest(n - t, 0)) + 1)) AS s FROM grams JOIN wanted USING (gram)),
shared AS (SELECT r, doc_id, n, license, t, s, gram, least(count(*), any_value(c)) AS k FROM held GROUP BY r, doc_id, n, license, t, s, gram),
scored AS (SELECT r, doc_id, license, s AS word, least(n, t) + 1 AS n_words, 2.0::DOUBLE * sum(k)::DOUBLE / (least(n, t) + t) AS dice FROM shared GROUP BY r, doc_id, n, license, t, s),
good AS (SELECT * FROM scored WHERE dice >= {least}::DOUBLE)
SELECT doc_id, license, word::BIGINT AS word, n_words::BIGINT AS n_words, dice FROM good a WHERE NOT EXISTS (
  SELECT 1 FROM good b WHERE b.r = a.r AND (-b.dice, -b.n_words, b.license, b.word) < (-a.dice, -a.n_words, a.license, a.word)
  AND 3 * (least(a.word + a.n_words, b.word + b.n_words) - greatest(a.word, b.word)) >= a.n_words)
"""
