"""License scans by diagonal voting.

Rolling word k-gram hashes of every text are joined with the k-gram positions of license templates.
Hits of one template vote for the diagonal ``place in text - place in template``. Each diagonal is judged
by itself; neighbouring diagonals, which an inserted or missing word sets apart, are merged, and a merged
span counts too when it holds enough of the template within a plausible length. So a notice that stands
twice in a row is found by its own diagonals, though the two merge to a span that is too long.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resolvescope.llm.common import Scratch, ascii_lower, let, split_words, text_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"

GAP = 3
"""Diagonals at most so far apart are merged."""

COVERED = 0.6
"""Share of a template's k-grams that a span must hold."""

STRETCH = 1.6
"""Most words of a span, as a multiple of the template's words."""


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False

    def words(self) -> list[str]:
        import re

        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", self.text.lower())

    def size(self) -> int:
        """Words of its k-grams."""
        return min(3, len(self.words()))

    def grams(self) -> list[str]:
        words, k = self.words(), self.size()
        return [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]


# Phrases of the base labels, and wording of public licenses and their notices.
TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    Template("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("proprietary", "All rights reserved"),
)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(hash, gram, template, at) of every k-gram, and one row of template -1 for the mark that each text emits."""
    rows = [("", -1, 0)] + [(gram, t, at) for t, template in enumerate(templates) for at, gram in enumerate(template.grams())]
    return spark.createDataFrame(rows, "gram string, template int, at int").select(F.xxhash64("gram").alias("hash"), F.col("gram").alias("t_gram"), "template", "at")


def _runs(words: Column, size: int) -> Column:
    """All runs of ``size`` words, space-joined."""
    run = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, run).otherwise(F.array().cast("array<string>"))


def license_hits(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Every k-gram hit of (doc_id, text) rows once per document, with how many rows repeat the document;
    every document has a row of template -1."""
    grams = let(split_words(ascii_lower(F.col("text")), SEPARATORS), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.concat(F.array(F.lit("")), _runs(w, 2), _runs(w, 3)).alias("grams")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), grams.alias("g"))
    placed = rows.select("doc_id", "digest", "g.n_words", F.posexplode("g.grams").alias("i", "gram"))
    # The template table is a constant of the library, a few hundred rows.
    table = F.broadcast(template_table(docs.sparkSession, templates))
    hits = placed.join(table, (F.xxhash64("gram") == F.col("hash")) & (F.col("gram") == F.col("t_gram")))
    # 0 is the mark, then come the n - 1 pairs, then the triples.
    start = F.when(F.col("i") < F.greatest("n_words", F.lit(1)), F.col("i") - 1).otherwise(F.col("i") - F.greatest("n_words", F.lit(1)))
    return hits.select("doc_id", "digest", "n_words", "template", "at", start.cast("long").alias("start")).groupBy("doc_id", "digest", "n_words", "template", "at", "start").agg(F.count("*").alias("copies"))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts all places of the base phrases, ``first_word`` and ``last_word`` are their smallest
    and largest start. ``labels`` adds those of verified spans of the other templates. ``score`` is 1
    with a base place, else the largest share of a template in a verified span, else 0. Documents
    without a hit have empty labels. Null and empty texts have no words; rows with a null doc_id are
    scanned too; repeated rows give repeated rows; extra columns are ignored.

    Nothing but hits is shuffled, and the k-grams meet the constant template table map-side. The hits are
    written once, so whole texts are read and cut into k-grams once.
    """
    key = ["doc_id", "digest", "n_words"]
    size = [len(t.words()) for t in templates]
    number = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("template") + 1)
    hits = Scratch(docs.sparkSession).cut(license_hits(docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")), templates))
    kind = F.when(F.col("template") < 0, "mark").otherwise(number(["base" if t.base else "own" for t in templates]))
    hits = hits.withColumn("label", F.when(F.col("template") >= 0, number([t.label for t in templates]))).withColumn("kind", kind)

    along = Window.partitionBy(*key, "template").orderBy("diagonal", "at")
    voted = hits.where("kind = 'own'").withColumn("diagonal", F.col("start") - F.col("at"))
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > GAP, F.lit(True))
    merged = voted.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    alone = merged.withColumn("own_votes", F.count(F.lit(1)).over(Window.partitionBy(*key, "template", "diagonal")))
    spans = alone.groupBy(*key, "template", "label", "span").agg(
        F.max("own_votes").alias("own_votes"), F.size(F.collect_set("at")).alias("votes"), (F.max("start") - F.min("start") + 3).alias("length"))
    grams = number([len(t.grams()) for t in templates])
    fits = F.col("length") <= number([float(n) for n in size]) * STRETCH
    verified = spans.withColumn("share", F.when(fits, F.col("votes")).otherwise(F.col("own_votes")) / grams).where(F.col("share") >= COVERED)

    parts = hits.where("kind <> 'own'").select(*key, "kind", "label", "start", "copies", F.lit(0.0).alias("share")).unionByName(
        verified.select(*key, F.lit("own").alias("kind"), "label", F.lit(None).cast("long").alias("start"), F.lit(0).cast("long").alias("copies"), "share"))
    base = F.col("kind") == "base"
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    found = parts.groupBy(*key).agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), joined(F.collect_set("label")).alias("labels"),
        F.max("share").alias("share"), F.max(F.when(F.col("kind") == "mark", F.col("copies"))).alias("copies"))
    repeated = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("share")).alias("score"))


def scan_sql(templates=TEMPLATES) -> str:
    """The scan of table ``documents`` as DuckDB SQL, for distinct document rows."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(
        f"({t}, {quoted(x.label)}, {str(x.base).lower()}, {len(x.words())}, {len(x.grams())}, {at}, {quoted(gram)})"
        for t, x in enumerate(templates) for at, gram in enumerate(x.grams()))
    return f"""
WITH templates(template, label, base, size, n_grams, place, gram) AS (VALUES {rows}),
docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
    FROM documents
), placed AS (
    SELECT doc_id, words, unnest(range(len(words))) AS start FROM docs
), grams AS (
    SELECT doc_id, start, k, array_to_string(words[start + 1:start + k], ' ') AS gram FROM placed, (VALUES (2), (3)) AS sizes(k) WHERE start + k <= len(words)
), hits AS (
    SELECT g.doc_id, g.start, t.* FROM grams g JOIN templates t ON g.gram = t.gram
), voted AS (
    SELECT *, start - place AS diagonal FROM hits WHERE NOT base
), merged AS (
    SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal, place ROWS UNBOUNDED PRECEDING) AS span FROM
    (SELECT doc_id, template, label, size, n_grams, place, start, diagonal, CASE WHEN diagonal - lag(diagonal) OVER w <= {GAP} THEN 0 ELSE 1 END AS apart
     FROM voted WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal, place))
), alone AS (
    SELECT *, count(*) OVER (PARTITION BY doc_id, template, diagonal) AS own_votes FROM merged
), spans AS (
    SELECT doc_id, label, n_grams, CASE WHEN max(start) - min(start) + 3 <= size * {STRETCH}::DOUBLE THEN count(DISTINCT place) ELSE max(own_votes) END AS votes
    FROM alone GROUP BY doc_id, template, label, size, n_grams, span
), verified AS (
    SELECT doc_id, label, votes * 1.0::DOUBLE / n_grams AS share FROM spans WHERE votes * 1.0::DOUBLE / n_grams >= {COVERED}
), parts AS (
    SELECT doc_id, label, true AS base, start, 0.0::DOUBLE AS share FROM hits WHERE base
    UNION ALL SELECT doc_id, label, false, NULL, share FROM verified
), found AS (
    SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share
    FROM parts GROUP BY doc_id
)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM docs d LEFT JOIN found USING (doc_id)
"""
