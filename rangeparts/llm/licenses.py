"""License scan by diagonal voting, in DataFrame operations only.

The rolling word k-grams of every text are joined, by their hash and then by their words, with the
places of the same k-grams in the templates. A match votes for its diagonal, the difference between
the two places: a text that follows a template stays on one diagonal, and moves to a neighbouring one
where words have been put in or left out. Neighbouring diagonals are merged into spans, which are
verified by the words of the template that they cover.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What stands between words, once A-Z are lower-cased; words are of digits, a-z and all that is not ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a k-gram, for phrases and for licence texts.
SHORT, LONG = 2, 4
#: Words that may be put in or left out between two parts of a span.
DRIFT = 8
#: Words of a template that a span has to cover: this share, and so many (or all) at least.
COVERED, SURE = 0.5, 12

# The phrases and the labels that they stand for.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Public licence texts, and the notices of those that are too long to stand here; names of holders left out.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER
OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim
that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not
be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In
jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the
public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License."""
GNU_NOTICE = """is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software
Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more
details. You should have received a copy of the GNU {name} along with this {what}. If not, see"""
GPL_TERMS = """You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and
appropriately publish on each copy an appropriate copyright notice; keep intact all notices stating that this License and any non-permissive terms added
in accord with section 7 apply to the code; keep intact all notices of the absence of any warranty; and give all recipients a copy of this License along
with the Program."""
APACHE_GRANT = """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive,
no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and
distribute the Work and such Derivative Works in Source or Object form."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at"""
BOOST = """The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or
derivative works are solely in the form of machine-executable object code generated by a source language processor."""
TEMPLATES = (
    (MIT, "mit-text"),
    (f"{BSD_CONDITIONS} {BSD_DISCLAIMER}", "bsd-2-clause"),
    (f"{BSD_CONDITIONS} {BSD_NAMES} {BSD_DISCLAIMER}", "bsd"),
    (BSD_CONDITIONS, "bsd"),
    (BSD_NAMES, "bsd-3-clause"),
    (ISC, "isc"),
    (ZLIB, "zlib"),
    (UNLICENSE, "unlicense"),
    (APACHE_NOTICE, "apache-2.0"),
    (APACHE_GRANT, "apache-2.0"),
    (GPL_TERMS, "gpl-3.0"),
    (GNU_NOTICE.format(name="General Public License", version=3, what="program"), "gpl-notice"),
    (GNU_NOTICE.format(name="Lesser General Public License", version=3, what="library"), "lgpl-notice"),
    (GNU_NOTICE.format(name="Affero General Public License", version=3, what="program"), "agpl-notice"),
    (MPL_NOTICE, "mpl-2.0"),
    (BOOST, "boost"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc-4.0"),
    ("Licensed under CC BY 4.0", "cc-by-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
)


def words_in(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def template_rows(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple]:
    """(template, label, k, words, needed, text): the phrases and templates by number, and how many words a span has to cover."""
    rows = []
    for i, (text, label) in enumerate(PHRASES + templates):
        words, phrase = words_in(text), i < len(PHRASES)
        n = len(words)
        k, needed = (SHORT, n) if phrase else (LONG, max(int(COVERED * n + 0.999), min(n, SURE)))
        rows.append((i, label, k, n, needed, " ".join(words)))
    return rows


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased.

    Of all other letters ``lower`` turns only two into ASCII ones; texts with them have them replaced
    by a third, which is a letter of a word as well.
    """
    odd = text.contains("İ") | text.contains("K")
    text = F.when(odd, F.translate(text, "İK", "ıı")).otherwise(text)
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def _grams(rows: DataFrame, *ks: int) -> DataFrame:
    """``rows`` with the array ``words`` replaced by (at, a, b, c, d, k, gram): a row for each place and each k of ``ks``
    that has the words for it, and one of k 0 for each row of ``rows``."""
    kept, n = [c for c in rows.columns if c != "words"], F.size("words")
    shifted = [F.col("words").alias("a"), *(F.slice("words", F.lit(i), n).alias(c) for i, c in ((2, "b"), (3, "c"), (4, "d")))]
    placed = rows.select(*kept, F.posexplode_outer(F.arrays_zip(*shifted)).alias("at", "z"))

    def key(k: int) -> Column:
        part = [F.col(f"z.{c}") for c in "abcd"[:k]]
        return F.struct(F.lit(k).alias("k"), (F.when(part[-1].isNotNull(), F.xxhash64(*part)) if k else F.lit(0).cast("long")).alias("gram"))

    first = F.col("at").isNull() | (F.col("at") == 0)
    keys = F.when(first, F.array(*map(key, (0, *ks)))).otherwise(F.array(*map(key, ks)))
    return placed.select(*kept, "at", "z.*", F.explode(keys).alias("key")).select(*kept, "at", "a", "b", "c", "d", "key.*")


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(template, k, place, gram, a, b, c, d): the k-grams of all templates, some two thousand, and template -1 of k 0."""
    schema = "template int, label string, size int, words int, needed int, text string"
    rows = spark.createDataFrame(template_rows(templates), schema).select("template", "size", F.split("text", " ").alias("words"))
    grams = _grams(rows, SHORT, LONG).where((F.col("k") == F.col("size")) & F.col("gram").isNotNull())
    grams = grams.select("template", "k", F.col("at").alias("place"), "gram", "a", "b", "c", "d")
    none = spark.range(1).select(F.lit(-1), F.lit(0), F.lit(0), F.lit(0).cast("long"), *[F.lit(None).cast("string")] * 4)
    return grams.union(none)


def votes(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(id, th, template, diagonal, places, n, copies): the places of a template that a diagonal has.

    Each different row of ``docs`` has one row of template -1, with the number of its words and how
    often it is given. Texts are read once, and a row that is exploded carries no more than four words.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), words_of(text).alias("words"))
    rows = _grams(rows.select("id", "th", F.size("words").alias("n"), "words"), SHORT, LONG)
    table = template_table(docs.sparkSession, templates).select(
        "template", "place", "gram", *(F.col(c).alias(f"t_{c}") for c in ("k", "a", "b", "c", "d"))
    )
    same = F.col("k") == F.col("t_k")
    for i, c in enumerate("abcd"):
        same = same & ((F.col("k") <= i) | (F.col(c) == F.col(f"t_{c}")))
    found = rows.join(F.broadcast(table), "gram").where(same)
    word = F.col("k") > 0
    return (
        found.select("id", "th", "n", "template", F.when(word, F.col("at") - F.col("place")).alias("diagonal"), F.when(word, F.col("place")).alias("place"))
        .groupBy("id", "th", "template", "diagonal")
        .agg(F.collect_set("place").alias("places"), F.max("n").alias("n"), F.count("*").alias("copies"))
    )


def _spans(diagonals: DataFrame, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """Neighbouring diagonals merged: (id, th, template, label, phrase, low, high, covered, share, sure), and template -1 as it is.

    Diagonals are taken in their order, so that one far off doesn't part two neighbours. A phrase stands on one diagonal or not at all.
    """
    phrase = F.col("template") < len(PHRASES)
    order = Window.partitionBy("id", "th", "template").orderBy("diagonal")
    before = F.lag("diagonal").over(order)
    apart = before.isNull() | (F.col("diagonal") - before > DRIFT) | phrase
    numbered = diagonals.withColumn("new", apart.cast("int")).withColumn("span", F.sum("new").over(order))
    merged = numbered.groupBy("id", "th", "template", "span").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.min(F.col("diagonal") + F.array_min("places")).alias("low"),
        F.max(F.col("diagonal") + F.array_max("places")).alias("last"),
        F.max("n").alias("n"), F.max("copies").alias("copies"),
    )
    about = diagonals.sparkSession.createDataFrame(
        template_rows(templates), "template int, label string, k int, words int, needed int, text string"
    ).drop("text")
    about = about.union(about.sparkSession.range(1).select(F.lit(-1), F.lit(""), F.lit(0), F.lit(1), F.lit(1)))
    known = merged.join(F.broadcast(about), "template")
    words = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("k") - 1))))
    known = known.withColumn("covered", F.when(F.col("template") < 0, 0).otherwise(F.size(words)))
    return known.select(
        "id", "th", "template", "label", phrase.alias("phrase"), "low", (F.col("last") + F.col("k") - 1).alias("high"), "n", "copies",
        (F.col("covered") / F.col("words")).alias("share"), (F.col("covered") >= F.col("needed")).alias("sure"),
    )


def spans(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, label, phrase, first_word, last_word, share): where texts follow a template, words counted from 0."""
    found = _spans(votes(docs, templates).where("template >= 0"), templates).where("sure")
    return found.select(F.col("id").alias("doc_id"), "label", "phrase", F.col("low").alias("first_word"), F.col("high").alias("last_word"), "share")


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, any others), repeated rows included.

    (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): the places where a
    phrase of PHRASES stands whole, their number and the words they begin at (null without any), the
    labels of the phrases, those and the labels of ``templates`` of which a span covers COVERED and
    SURE words, and the largest share of a phrase or template that is covered; the score counts
    lesser shares of templates too. ``templates`` are any (text, label). A null text is an empty one;
    a null doc_id is kept. No rows give no rows.
    """
    found = _spans(votes(docs, templates), templates)
    base = F.col("phrase") & F.col("sure") & (F.col("template") >= 0)
    labelled = F.col("sure") & (F.col("template") >= 0)

    def labels(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    by_text = found.groupBy("id", "th").agg(
        F.max(F.when(F.col("template") < 0, F.col("n"))).cast("long").alias("n_words"),
        F.max(F.when(F.col("template") < 0, F.col("copies"))).alias("copies"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("low"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(labelled).alias("labels"),
        F.max(F.when(base | ((F.col("template") >= 0) & ~F.col("phrase")), F.col("share"))).alias("score"),
    )
    rows = by_text.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
        F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"),
    )


def scan_sql() -> str:
    """DuckDB SQL of ``scan`` over documents."""
    templates = ", ".join(f"({i}, '{label}', {k}, {n}, {needed}, '{text}')" for i, label, k, n, needed, text in template_rows())
    return rf"""
WITH t AS (
  SELECT template, label, k, words, needed, template < {len(PHRASES)} AS phrase, string_split(text, ' ') AS w
  FROM (VALUES {templates}) AS v(template, label, k, words, needed, text)
), tp AS (
  SELECT template, k, i - 1 AS place, w[i:i + k - 1] AS gram FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM t)
), d AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{WORD}') AS w FROM documents
), g AS (
  SELECT id, k, i - 1 AS pos, w[i:i + k - 1] AS gram FROM (
    SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES ({SHORT}), ({LONG})) AS s(k))
), diag AS (
  SELECT id, template, pos - place AS diagonal, list(DISTINCT place) AS places FROM g JOIN tp USING (k, gram) GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN lag(diagonal) OVER o IS NULL OR diagonal - lag(diagonal) OVER o > {DRIFT} OR template < {len(PHRASES)}
    THEN 1 ELSE 0 END AS new FROM diag WINDOW o AS (PARTITION BY id, template ORDER BY diagonal)
), numbered AS (
  SELECT *, sum(new) OVER (PARTITION BY id, template ORDER BY diagonal) AS span FROM marked
), merged AS (
  SELECT id, template, span, list_distinct(flatten(list(places))) AS places, min(diagonal + list_min(places)) AS low FROM numbered GROUP BY ALL
), spans AS (
  SELECT id, label, phrase, low, covered / words::DOUBLE AS share, covered >= needed AS sure FROM (
    SELECT m.*, t.*, len(list_distinct(flatten(list_transform(places, lambda p: range(p, p + k))))) AS covered FROM merged m JOIN t USING (template))
), by_doc AS (
  SELECT id, count(*) FILTER (phrase AND sure) AS n_base, min(low) FILTER (phrase AND sure) AS first_word,
    max(low) FILTER (phrase AND sure) AS last_word,
    list(DISTINCT label ORDER BY label) FILTER (phrase AND sure) AS base_labels,
    list(DISTINCT label ORDER BY label) FILTER (sure) AS labels,
    max(share) FILTER (sure OR NOT phrase) AS score
  FROM spans GROUP BY id
)
SELECT d.id AS doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(array_to_string(base_labels, ','), '') AS base_labels,
  coalesce(array_to_string(labels, ','), '') AS labels, round(coalesce(score, 0.0)::DOUBLE, 9) AS score
FROM d LEFT JOIN by_doc USING (id)
"""
