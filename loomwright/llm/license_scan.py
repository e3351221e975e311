"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word bigram of a document is hashed and joined to the bigrams of a fixed list of license
notices and whole license texts; a hit must also have the third word of the template where it has one. A hit at word ``p`` of
template place ``t`` votes for the diagonal ``p - t``. Votes are gathered as bit masks of template places, 63
places each, per diagonal, diagonals at most ``slack`` apart are merged (a word added or left out moves the diagonal),
and a merged span counts if the template places that it holds, word for word, are enough of the template.

The template list is a constant, so broadcasting it is bounded. Each document adds one sentinel row with its
word count to the same stream, so the texts are read once and never shuffled; only votes are.

Defined results: a null text has no words; documents are told apart by id and text. Votes of rows that repeat both
cannot be told apart without moving texts, so such rows give one row, with the one result they all have; different texts under one id (also a null id) give one row each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.session import materialise

WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases that count wherever their words stand consecutively, and their labels.
BASE = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
# Sentences of usual license notices, and their labels.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "released under the bsd license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "this work is licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "dedicated to the public domain under the cc0 1 0 universal public domain dedication"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "no part of this publication may be reproduced without prior written permission"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

# Whole license texts and longer notices, and their labels.
TEXTS = [
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must "
        "retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of "
        "conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and "
        "contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to "
        "procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability "
        "or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either "
        "version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied "
        "warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public "
        "license along with this program if not see",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability "
        "and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
        "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular "
        "purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
    ),
]

SLACK, COVER = 2, 0.7
#: Places of a template that one mask holds.
MASK = 63


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, whether a base phrase, words)."""
    both = [(label, True, words) for label, words in BASE] + [(label, False, words) for label, words in NOTICES + TEXTS]
    return [(n, label, base, text.split()) for n, (label, base, text) in enumerate(both)]


def _grams(spark: SparkSession) -> DataFrame:
    rows = [(-1, "", False, 0, 1, 1, "", "", None)]
    for n, label, base, words in templates():
        k = min(3, len(words))
        for t in range(len(words) - k + 1):
            rows.append((n, label, base, t, len(words), len(words) - k + 1, *words[t : t + k], *[None] * (3 - k)))
    schema = "tmpl int, label string, base boolean, place int, t_words int, t_grams int, a string, b string, c string"
    grams = spark.createDataFrame(rows, schema)
    return grams.withColumn("key", F.when(F.col("a") == "", F.lit(0).cast("long")).otherwise(F.xxhash64("a", "b")))


def words_of(text: Column) -> Column:
    """The words of a text in lower case; none for null. Letters beyond A-Z change too, which moves no word's
    border and no match, once the one that would become an ASCII letter (the Kelvin sign) is out of the way.
    Splitting between words is ten times as fast as extracting them."""
    clean = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ufffd")))
    clean = F.regexp_replace(clean, f"^{GAP}|{GAP}$", "")
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, GAP))


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, template and diagonal with the mask of template places, and one sentinel row
    (template -1) per document whose diagonal is the document's number of words."""
    words = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
        F.concat(words_of(F.col(text_col)), F.array(F.lit(""))).alias("w"),
    )
    at = words.select("id", "text_key", "w", F.posexplode("w").alias("pos", "word"))
    at = at.withColumn("key", F.when(F.col("word") == "", F.lit(0).cast("long")).otherwise(F.xxhash64("word", F.get("w", F.col("pos") + 1))))
    same = (F.col("word") == F.col("a")) & (F.col("a").eqNullSafe("") | (F.get("w", F.col("pos") + 1) == F.col("b")))
    same &= F.col("c").isNull() | (F.get("w", F.col("pos") + 2) == F.col("c"))
    hits = at.join(F.broadcast(_grams(docs.sparkSession)), "key").where(same)
    return (
        hits.select("id", "text_key", "tmpl", "label", "base", "t_words", "t_grams", "place", (F.col("pos") - F.col("place")).alias("diagonal"))
        .groupBy("id", "text_key", "tmpl", "label", "base", "t_words", "t_grams", "diagonal", F.floor(F.col("place") / MASK).cast("int").alias("part"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, place % {MASK})")).alias("mask"))
    )


def license_spans(voted: DataFrame, slack: int = SLACK, cover: float = COVER) -> DataFrame:
    """Merge neighbouring diagonals and keep the spans that verify: all of a base phrase, ``cover`` of a notice."""
    by = Window.partitionBy("id", "text_key", "tmpl").orderBy("diagonal")
    real = voted.where("tmpl >= 0")
    gap = F.col("diagonal") - F.lag("diagonal").over(by)
    real = real.withColumn("new", F.when(gap.isNull() | F.col("base") | (gap > slack), 1).otherwise(0))
    real = real.withColumn("span", F.sum("new").over(by))
    span = ["id", "text_key", "tmpl", "label", "base", "t_words", "t_grams", "span"]
    parts = real.groupBy(*span, "part").agg(F.bit_or("mask").alias("mask"), F.min("diagonal").alias("first_diagonal"), F.max("diagonal").alias("last_diagonal"))
    spans = parts.groupBy(*span).agg(F.sum(F.bit_count("mask")).alias("places"), F.min("first_diagonal").alias("first_diagonal"), F.max("last_diagonal").alias("last_diagonal"))
    spans = spans.withColumn("covered", F.col("places") / F.col("t_grams"))
    spans = spans.where(F.when(F.col("base"), F.col("covered") == 1).otherwise(F.col("covered") >= cover))
    return spans.select(
        "id", "text_key", "label", "base", "covered",
        F.greatest(F.col("first_diagonal"), F.lit(0)).cast("long").alias("start_word"),
        (F.col("last_diagonal") + F.col("t_words")).cast("long").alias("end_word"),
    )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, base phrases with their first and last place, labels and the best span's share."""
    voted = materialise(votes(docs, id_col, text_col), "votes")  # else the texts are read for the counts and for the spans
    counted = voted.where("tmpl < 0").select("id", "text_key", F.col("diagonal").alias("n"), *[F.lit(None).cast(t).alias(c) for c, t in (("label", "string"), ("base", "boolean"), ("covered", "double"), ("start_word", "long"), ("end_word", "long"))])
    spans = license_spans(voted).select("id", "text_key", F.lit(None).cast("int").alias("n"), "label", "base", "covered", "start_word", "end_word")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.col("base")
    return (
        counted.union(spans)
        .groupBy("id", "text_key")
        .agg(
            F.max("n").cast("long").alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start_word"))).alias("first_word"),
            F.max(F.when(base, F.col("start_word"))).alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined("label").alias("labels"),
            F.coalesce(F.max("covered"), F.lit(0.0)).alias("score"),
            F.count("covered").alias("n_spans"),
        )
        .drop("text_key")
        .withColumnRenamed("id", id_col)
    )


def oracle() -> str:
    """The same result as DuckDB SQL over the view ``documents``."""
    rows = []
    for n, label, base, words in templates():
        k = min(3, len(words))
        for t in range(len(words) - k + 1):
            quoted = [f"'{w}'" for w in words[t : t + k]] + ["NULL"] * (3 - k)
            rows.append(f"({n},'{label}',{str(base).lower()},{t},{len(words) - k + 1},{','.join(quoted)})")
    return rf"""
WITH g(tmpl,label,base,place,t_grams,a,b,c) AS (VALUES {",".join(rows)}),
d AS (SELECT DISTINCT doc_id, coalesce(text,'') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(translate(text,'{UPPER}','{LOWER}'), '{WORD}') AS w FROM d),
e AS (SELECT doc_id, text, w, unnest(range(len(w))) AS pos FROM w),
h AS (SELECT doc_id, text, tmpl, label, base, t_grams, place, pos - place AS diagonal FROM e JOIN g
      ON w[pos+1] = a AND w[pos+2] = b AND (c IS NULL OR w[pos+3] = c)),
v AS (SELECT DISTINCT * FROM h),
o AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, text, tmpl ORDER BY diagonal) AS gap FROM (SELECT DISTINCT doc_id, text, tmpl, base, diagonal FROM v)),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR base OR gap > {SLACK} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, text, tmpl ORDER BY diagonal) AS span FROM o),
m AS (SELECT v.doc_id, v.text, v.tmpl, any_value(label) AS label, any_value(v.base) AS base, span,
      count(DISTINCT place)::DOUBLE / any_value(t_grams) AS covered, greatest(min(v.diagonal), 0) AS start_word
      FROM v JOIN s USING (doc_id, text, tmpl, diagonal) GROUP BY v.doc_id, v.text, v.tmpl, span),
k AS (SELECT * FROM m WHERE CASE WHEN base THEN covered = 1 ELSE covered >= {COVER} END)
SELECT w.doc_id, len(any_value(w.w))::BIGINT AS n_words, count(CASE WHEN base THEN 1 END)::BIGINT AS n_base,
  min(CASE WHEN base THEN start_word END)::BIGINT AS first_word, max(CASE WHEN base THEN start_word END)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT CASE WHEN base THEN label END, ',' ORDER BY CASE WHEN base THEN label END), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  coalesce(max(covered), 0.0)::DOUBLE AS score, count(covered)::BIGINT AS n_spans
FROM w LEFT JOIN k USING (doc_id, text) GROUP BY w.doc_id, w.text"""
