"""License scans by DataFrame functions alone: all rolling word k-gram hashes are joined to template positions,
hits are aggregated by offset diagonal, neighbouring diagonals merge, and spans are verified.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as C

K_GRAM = 4
#: Share of a template's k-grams that a span must hold, and how far its diagonals may drift apart.
LEAST_COVER, DRIFT = 0.6, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The wording by which public licenses ask to be named, short licenses whole, and first conditions of
#: longer ones. Whole texts of those are a parameter: `corpus` takes any list of (label, text).
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("mit", "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-2-clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-2", "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3", "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("artistic", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble. This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed"),
    ("cc0", "has waived all copyright and related or neighboring rights"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
)
#: Template k-grams that are broadcast; more are joined by a shuffle.
BROADCAST_GRAMS = 1_000_000


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), "")


def grams_of(words: Column, k: int) -> Column:
    """Of every k words in a row their hash and what they say; null for fewer words."""
    starts = F.sequence(F.lit(0), F.size(words) - k)

    def gram(i: Column) -> Column:
        own = [F.get(words, i + j) for j in range(k)]
        return F.struct(F.xxhash64(*own).alias("gram"), F.concat_ws(" ", *own).alias("said"))

    return F.when(F.size(words) >= k, F.transform(starts, gram))


def _phrases_at(words: Column) -> Column:
    """Structs (at, label), in the order of words."""

    def label(i: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, name in PHRASES.items():
            same = F.lit(True)
            for j, word in enumerate(phrase.split()):
                same = same & (F.get(words, i + j) == word)
            found = F.when(same, F.lit(name)).otherwise(found)
        return found

    places = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.struct(i.alias("at"), label(i).alias("label")))
    return F.filter(places, lambda p: p["label"].isNotNull())


def templates(spark: SparkSession, corpus: Sequence[tuple[str, str]] = TEMPLATES, k: int = K_GRAM) -> DataFrame:
    """(template, label, grams, place, gram, said): the k-grams of each text of the corpus."""
    rows = [(t, label, text) for t, (label, text) in enumerate(corpus)]
    made = spark.createDataFrame(rows, "template int, label string, text string").withColumn("all", grams_of(words_of(F.col("text")), k))
    return made.select("template", "label", F.size("all").alias("grams"), F.posexplode("all").alias("place", "of")).select("template", "label", "grams", "place", "of.*")


def template_spans(df: DataFrame, key_cols: list[str], words_col: str, corpus: Sequence[tuple[str, str]] = TEMPLATES, k: int = K_GRAM, least_cover: float = LEAST_COVER, drift: int = DRIFT) -> DataFrame:
    """key_cols, template, label, start, end (words, end exclusive) and cover of every verified span.

    df has one array of words a row; rows of equal keys must have equal words. Hits are joined by the hashes of
    k-grams and hold only where the words are the same. Hits of a template in a row whose diagonals (word position
    less template position) lie within `drift` of the next are one span.
    """
    known = templates(df.sparkSession, corpus, k)
    if sum(len(text.split()) for _, text in corpus) <= BROADCAST_GRAMS:
        known = F.broadcast(known)
    grams = df.select(*key_cols, F.posexplode(grams_of(F.col(words_col), k)).alias("at", "of")).select(*key_cols, "at", F.col("of.gram").alias("gram"), F.col("of.said").alias("said"))
    hits = grams.join(known, ["gram", "said"]).select(*key_cols, "template", "label", "grams", "at", "place", (F.col("at") - F.col("place")).alias("diagonal"))
    votes = hits.groupBy(*key_cols, "template", "label", "grams", "diagonal").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("place").alias("places"))
    by = Window.partitionBy(*key_cols, "template").orderBy("diagonal")
    # neighbours merge only where their hits also lie near each other in the text
    far = (F.col("diagonal") - F.lag("diagonal").over(by) > drift) | (F.col("first") > F.lag("last").over(by) + F.col("grams") + k)
    runs = votes.withColumn("run", F.sum(F.when(far, 1).otherwise(0)).over(by))
    spans = runs.groupBy(*key_cols, "template", "label", "grams", "run").agg(F.min("first").alias("start"), (F.max("last") + k).alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"))
    cover = F.col("held") / F.col("grams")
    long_enough = F.col("end") - F.col("start") >= least_cover * F.col("grams")
    return spans.withColumn("cover", cover).where((cover >= least_cover) & long_enough).select(*key_cols, "template", "label", "start", "end", "cover")


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", corpus: Sequence[tuple[str, str]] = TEMPLATES, k: int = K_GRAM) -> DataFrame:
    """One row per input row: id_col, n_words, n_base (places of the phrases), first_word, last_word (their least
    and greatest start, else null), base_labels, labels (the templates' too), score and spans
    (array of structs start, end, template, label, cover).

    score is the best cover of a template, 0.5 at least where a phrase stands, else 0. A null or empty text has no words and no labels; a null id is scanned like
    any other; texts of any length are read whole; an empty table gives an empty result; other columns play no part.
    Rows find their spans by a 256-bit digest of id and text, so rows with the same id and text, and only those, share
    them. Spans that start together stand in the order of end and template.
    """
    text = C.text_or_empty(F.col(f"`{text_col}`"))
    name = F.coalesce(F.hex(F.col(f"`{id_col}`").cast("string")), F.lit("-"))
    keyed = df.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.sha2(F.concat(name, F.lit(":"), text), 256)).alias("key"), text.alias("t")).select("id", "key", "t", words_of(F.col("t")).alias("words"))
    low = F.lower("t")
    may = (F.contains(low, F.lit("license")) | F.contains(low, F.lit("cc"))) & (F.size("words") > 0)
    base = keyed.select("id", "key", F.size("words").cast("long").alias("n_words"), F.when(may, _phrases_at(F.col("words"))).alias("found"))
    spans = template_spans(keyed, ["key"], "words", corpus, k)
    per = spans.groupBy("key").agg(F.max("cover").alias("best"), F.collect_set("label").alias("more"), F.sort_array(F.collect_list(F.struct("start", "end", "template", "label", "cover"))).alias("spans"))
    # the second key makes Spark deal both sides anew, so that it can split a row that is repeated very often
    out = base.withColumn("deal", F.xxhash64("key")).join(per.withColumn("deal", F.xxhash64("key")), ["deal", "key"], "left")
    none = F.array().cast("array<string>")
    own = F.coalesce(F.array_distinct(F.transform("found", lambda p: p["label"])), none)
    count = F.coalesce(F.size("found"), F.lit(0))
    n_base = F.when(F.col("found").isNull(), 0).otherwise(count).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        n_base.alias("n_base"),
        F.when(n_base > 0, F.get("found", F.lit(0))["at"]).cast("long").alias("first_word"),
        F.when(n_base > 0, F.element_at("found", -1)["at"]).cast("long").alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("more", none))), ",").alias("labels"),
        F.greatest(F.coalesce(F.col("best"), F.lit(0.0)), F.when(n_base > 0, 0.5).otherwise(0.0)).cast("double").alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,template:int,label:string,cover:double>>")).alias("spans"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(C.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def _sql() -> str:
    import re

    values = []
    for t, (label, text) in enumerate(TEMPLATES):
        words = re.findall(r"[0-9a-z]+", text.lower())
        grams = [" ".join(words[i : i + K_GRAM]) for i in range(len(words) - K_GRAM + 1)]
        values += [f"({t}, '{label}', {len(grams)}, {i}, '{g}')" for i, g in enumerate(grams)]
    places = []
    for phrase, label in PHRASES.items():
        same = " AND ".join(f"w[i + {j}] = '{word}'" for j, word in enumerate(phrase.split(), 1))
        places.append(f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(0, len(w)), lambda i: coalesce({same}, false))) AS pos FROM d")
    return f"""WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), places AS (
  {' UNION ALL '.join(places)}
), base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM places GROUP BY doc_id
), template(template, label, grams, place, gram) AS (VALUES {', '.join(values)}
), hits AS (
  SELECT doc_id, template, label, grams, pos, place, pos - place AS diagonal FROM (
    SELECT doc_id, i AS pos, array_to_string(w[i + 1:i + {K_GRAM}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(0, len(w) - {K_GRAM - 1})) AS i FROM d)
  ) JOIN template USING (gram)
), votes AS (
  SELECT doc_id, template, label, grams, diagonal, min(pos) AS f, max(pos) AS l FROM hits GROUP BY ALL
), runs AS (
  SELECT *, sum(far) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM (
    SELECT *, CASE WHEN diagonal - lag(diagonal) OVER p > {DRIFT} OR f > lag(l) OVER p + grams + {K_GRAM} THEN 1 ELSE 0 END AS far
    FROM votes WINDOW p AS (PARTITION BY doc_id, template ORDER BY diagonal)
  )
), spans AS (
  SELECT doc_id, label, count(DISTINCT place) / grams AS cover, max(l) + {K_GRAM} - min(f) AS size, grams
  FROM runs JOIN hits USING (doc_id, template, label, grams, diagonal) GROUP BY doc_id, template, label, grams, run
), verified AS (
  SELECT doc_id, label, cover FROM spans WHERE cover >= {LEAST_COVER} AND size >= {LEAST_COVER} * grams
), best AS (
  SELECT doc_id, max(cover) AS best FROM verified GROUP BY doc_id
), own AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY doc_id
), every AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM verified) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, greatest(coalesce(best, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)"""


SQL = _sql()
