"""License scans: phrases by place, and an exact set-similarity join of text blocks with notice templates.

A block is a window of a text's words: twice as many as the longest template of its class has, beginning at every multiple
of that number, so a notice stands whole in some block however its lines are wrapped and whatever blank lines it has inside. A template is
found in a block if the block holds at least ``CONTAINED`` of the template's distinct words. Words are ordered by how
many blocks of the corpus have them, rare ones first; a block can only qualify if one of its first |B| - t + 1 words is
one of the template's first |T| - t + 1, where t is the overlap asked for. Length, prefix and position filters drop
the rest, and the overlap decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm.words import split_words

#: What lies between words: runs of letters, digits and characters beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases and their labels.
PHRASES = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))
#: Opening words of widely used license notices, by label.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
)
#: Widely used notices up to their disclaimers, by label.
NOTICES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
)
CONTAINED = 0.9
#: Templates by class: opening words are looked for in small blocks, whole notices in large ones.
CLASSES = (TEMPLATES, NOTICES)
REACH = tuple(max(len(text.split()) for _, text in templates) for templates in CLASSES)


def _sets() -> list[tuple[int, int, str, list[str], int]]:
    """(number, class, label, distinct words, overlap asked for) of each template."""
    every = [(k, label, sorted(set(text.split()))) for k, templates in enumerate(CLASSES) for label, text in templates]
    return [(i, k, label, w, math.ceil(CONTAINED * len(w))) for i, (k, label, w) in enumerate(every)]


def _lowered(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def _blocks(docs: DataFrame) -> DataFrame:
    """(key, cls, rel): for each block the words that any template has, each once."""
    vocabulary = sorted({w for *_, words, _ in _sets() for w in words})
    least = F.lit(min(t for *_, t in _sets()))
    parts = docs.select("key", split_words(F.lower("text"), GAP).alias("words"))
    # Words of no template become null in place, so blocks are plain slices.
    parts = parts.where(F.size("words") >= least).select("key", F.transform("words", lambda w: F.when(w.isin(vocabulary), w)).alias("words"))

    def windows(k: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - REACH[k] - 1, F.lit(0)), F.lit(REACH[k]))
        rel = lambda s: F.array_compact(F.array_distinct(F.slice("words", s + 1, F.lit(2 * REACH[k]))))
        return F.transform(starts, lambda s: F.struct(F.lit(k).alias("cls"), rel(s).alias("rel")))

    every = parts.select("key", F.explode(F.concat(*(windows(k) for k in range(len(CLASSES))))).alias("b"))
    return every.select("key", "b.cls", "b.rel").where(F.size("rel") >= least)


def word_order(blocks: DataFrame) -> list[str]:
    """Template words by number of blocks, rare ones first; at most the vocabulary of the templates reaches the driver."""
    counts = {r["word"]: r["n"] for r in blocks.select(F.explode("rel").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted({w for *_, words, _ in _sets() for w in words}, key=lambda w: (counts.get(w, 0), w))


def contained_templates(docs: DataFrame) -> DataFrame:
    """(key, label, share) of rows (key, text): each template found in a block of the document ``key``, with the best share."""
    spark, every = docs.sparkSession, _blocks(docs)
    order = word_order(every)
    rank = {w: i for i, w in enumerate(order)}
    prefixes = [
        (number, cls, label, rank[word], place, len(words), t, sorted(rank[w] for w in words))
        for number, cls, label, words, t in _sets()
        for place, word in enumerate(sorted(words, key=rank.get)[: len(words) - t + 1])
    ]
    # One row for each prefix word of each template, so of fixed size.
    index = spark.createDataFrame(prefixes, "template int, of_class int, label string, token int, place int, length int, needed int, tokens array<int>")
    # The prefix filter, first without ranks: a block has to hold a prefix word of some template.
    some = every.where(F.exists("rel", lambda w: w.isin(sorted({order[p[3]] for p in prefixes}))))
    ranked = some.select("key", "cls", F.array_sort(F.transform("rel", lambda w: F.array_position(F.array(*map(F.lit, order)), w).cast("int") - 1)).alias("rel"))
    least = F.element_at(F.array(*(F.lit(min(t for _, cls, *_, t in _sets() if cls == k)) for k in range(len(CLASSES)))), F.col("cls") + 1)
    ranked = ranked.where(F.size("rel") >= least)
    probes = ranked.select("key", "cls", "rel", F.posexplode(F.slice("rel", F.lit(1), F.size("rel") - least + 1)).alias("at", "token"))
    joined = probes.join(F.broadcast(index), "token").where(
        (F.col("cls") == F.col("of_class"))
        & (F.size("rel") >= F.col("needed"))
        & (F.col("at") <= F.size("rel") - F.col("needed"))
        & (F.least(F.col("length") - F.col("place"), F.size("rel") - F.col("at")) >= F.col("needed"))
    )
    overlap = F.size(F.array_intersect("rel", "tokens"))
    found = joined.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("needed"))
    return found.groupBy("key", "label").agg(F.max(F.col("overlap") / F.col("length")).alias("share"))


def _places(words: Column, phrase: tuple[str, ...]) -> Column:
    last = F.size(words) - len(phrase)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        out = F.get(words, i) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            out = out & (F.get(words, i + k) == word)
        return out

    return F.filter(starts, here)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs``.

    ``score`` is 1 where a phrase stands and else the best share of a template that a block holds, 0 without any.
    Null text is empty; without a phrase first_word and last_word are null; rows equal in id and text share their
    result; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", F.struct("id", F.xxhash64("text").alias("hash")))
    base = keyed.select("key", split_words(F.col("text"), GAP).alias("cut"), F.regexp_like("text", F.lit("(?i)license")).alias("some"))
    # Every phrase has this word, so other texts need no array of lower-cased words. The array is a column of its own:
    # inside the lambdas below it would be made anew at each place.
    words = F.when(F.col("some"), F.transform("cut", _lowered)).otherwise(F.array().cast("array<string>"))
    base = base.select("key", F.size("cut").cast("long").alias("n_words"), words.alias("words"))
    base = base.select("key", "n_words", *(_places(F.col("words"), phrase).alias(label) for label, phrase in PHRASES))
    own = F.array_sort(F.array_compact(F.array(*(F.when(F.size(label) > 0, F.lit(label)) for label, _ in PHRASES))))
    base = base.select("key", "n_words", F.concat(*(label for label, _ in PHRASES)).alias("every"), own.alias("own"))
    more = contained_templates(keyed.select("key", "text"))
    more = more.groupBy("key").agg(F.collect_set("label").alias("more"), F.max("share").alias("share")).withColumnRenamed("key", "of")
    none_more = F.coalesce("more", F.array().cast("array<string>"))
    same = F.col("key.id").eqNullSafe(F.col("of.id")) & (F.col("key.hash") == F.col("of.hash"))
    return base.join(more, same, "left").select(
        F.col("key.id").alias(id_col),
        "n_words",
        F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"),
        F.array_max("every").cast("long").alias("last_word"),
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", none_more)), ",").alias("labels"),
        F.when(F.size("every") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
