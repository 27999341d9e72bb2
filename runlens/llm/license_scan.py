"""License scans by diagonal voting.

All rolling word 2-gram hashes of the documents are joined to the positions of
the templates' 2-grams. A match votes for the diagonal on which it lies: its
position in the document less its position in the template. Votes are summed
by diagonal, neighbouring diagonals of a template are merged (words inserted or
left out), and a span counts if enough of the template's 2-grams stand in it
and it is not much longer than the template; where merged diagonals are longer,
the parts of them that are not are tried. A template may be a whole license. A template too short to miss a 2-gram
by its coverage may have one edit: up to two words inserted at one place, or
its first or last word missing or changed, unless the rest also stands in a
template of another label. The words put in must not make another license (nc,
lesser, numbers). Base phrases count only where all their words stand
consecutively.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.llm.common import WORD_GAP, word_array, word_places

# Base phrases and templates of notices, each with its label.
BASE: tuple[tuple[str, str], ...] = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
# Whole texts of short licenses, each with its label.
WHOLE_TEXTS: tuple[tuple[str, str], ...] = (
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "isc",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "bsd",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unlicense",
    ),
)
TEMPLATES += WHOLE_TEXTS
MIN_COVERAGE = 0.85
#: Words put in or left out between neighbouring diagonals of one span; a longer template's span may be longer by a share of it.
MERGE_GAP = 2
LONGER = 0.05
#: Words that make another license of a short notice, as numbers do.
CHANGING = ("affero", "lesser", "library", "nc", "nd", "non", "noncommercial", "not", "sa", "sharealike")

_GAP = re.compile(WORD_GAP)


def template_words(text: str) -> list[str]:
    return [w for w in _GAP.split(text.lower()) if w]


def _one_edit() -> Column:
    """Whether ``around``, the words from MERGE_GAP before the template's start on the diagonal to MERGE_GAP after its end, is ``short`` with one edit."""
    changing = ", ".join(f"'{w}'" for w in CHANGING)
    plain = lambda x: f"not coalesce({x} in ({changing}) or {x} rlike '^[0-9]+$', false)"
    n, gap = "size(short)", MERGE_GAP
    # words 1 to i, then k others, then words i + 1 to n; the first word alone has no 2-gram, so there the rest lies on the diagonal
    at = f"(case when i = 1 then {gap} - k else {gap} end)"
    put_in = f"slice(around, {at} + 1, i) = slice(short, 1, i) and slice(around, {at} + i + k + 1, {n} - i) = slice(short, i + 1, {n} - i) and forall(slice(around, {at} + i + 1, k), x -> {plain('x')})"
    inserted = f"exists(sequence(1, {n} - 1), i -> exists(sequence(1, {gap}), k -> {put_in}))"
    first = f"free_first and slice(around, {gap + 2}, {n} - 1) = slice(short, 2, {n} - 1) and {plain(f'around[{gap}]')}"
    last = f"free_last and slice(around, {gap + 1}, {n} - 1) = slice(short, 1, {n} - 1) and {plain(f'around[{gap} + {n} - 1]')}"
    return F.expr(f"short is not null and ({inserted} or {first} or {last})")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[tuple[str, str], ...] = BASE, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): documents has key columns doc_id, text_hash and n_words for every row of ``docs``.

    spans has doc_id, text_hash, label, is_base, start, end (words from 0, end
    excluded), coverage of every candidate, verified or not; merged diagonals
    that are too long are one candidate, by their best part. A phrase or template
    has two words or more.
    """
    spark = docs.sparkSession
    rows, sizes, reach = [], [], 0
    known = [(f" {' '.join(template_words(t))} ", label) for t, label in templates]
    for no, (text, label) in enumerate((*base, *templates)):
        words = template_words(text)
        if len(words) < 2:
            raise ValueError(f"two words or more are needed: {text}")
        sizes.append((no, label, no < len(base), len(words) - 1))
        # one missing 2-gram of these is too much for MIN_COVERAGE
        short = no >= len(base) and len(words) > 3 and len(words) - 2 < MIN_COVERAGE * (len(words) - 1)
        reach = max(reach, len(words) + MERGE_GAP if short else 0)
        free = [not any(f" {' '.join(part)} " in t for t, other in known if other != label) for part in (words[1:], words[:-1])]
        rows += [(no, at, *pair, words if short else None, *free) for at, pair in enumerate(zip(words, words[1:]))]
    grams = spark.createDataFrame(rows, "template int, at int, t1 string, t2 string, short array<string>, free_first boolean, free_last boolean").withColumn("gram", F.xxhash64(F.xxhash64("t1"), F.xxhash64("t2")))
    about = spark.createDataFrame(sizes, "template int, label string, is_base boolean, grams int")

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), word_array(F.col("text")).alias("words"))
    placed = word_places(keyed, max(reach, 1)).withColumnRenamed("at", "here").withColumn("next", F.get("near", F.col("here") + 1))
    placed = placed.where("next is not null").withColumn("gram", F.xxhash64(F.xxhash64("word"), F.xxhash64("next")))
    # the templates are a parameter, of some thousand 2-grams
    votes = placed.join(F.broadcast(grams), "gram").where("word = t1 and next = t2")
    around = F.expr(f"transform(sequence(here - at - {MERGE_GAP}, here - at + size(short) - 1 + {MERGE_GAP}), p -> get(near, p))")
    votes = votes.withColumn("around", F.when(F.col("short").isNotNull(), around)).withColumn("edited", _one_edit())
    lines = votes.groupBy("doc_id", "text_hash", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("seen"), F.min("pos").alias("start"), (F.max("pos") + 2).alias("end"), F.max("edited").alias("edited")
    )
    lines = lines.join(F.broadcast(about), "template")
    along = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    apart = F.col("is_base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > MERGE_GAP, F.lit(True))
    merged = lines.withColumn("apart", apart).withColumn("run", F.sum(F.col("apart").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    longer = F.greatest(F.lit(2 * MERGE_GAP), F.floor(F.col("grams") * LONGER)).cast("int")
    # the diagonals from one on that make no longer span than is allowed
    near = Window.partitionBy("doc_id", "text_hash", "template", "run").orderBy("diagonal").rangeBetween(0, 2 * MERGE_GAP)
    distinct = lambda lists: F.size(F.array_distinct(F.flatten(lists)))
    part = F.struct(distinct(F.collect_list("seen").over(near)).alias("n"), (-F.min("start").over(near)).alias("start"), F.max("end").over(near).alias("end"))
    spans = merged.withColumn("part", part).groupBy("doc_id", "text_hash", "template", "label", "is_base", "grams", "run").agg(
        # each place of the template once, whatever number of diagonals a long run has
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("edited").alias("edited"), F.max("part").alias("part"), F.array_distinct(F.flatten(F.collect_set("seen"))).alias("seen")
    )
    least = F.when(F.col("is_base"), F.lit(1.0)).otherwise(F.lit(MIN_COVERAGE))
    whole = F.col("end") - F.col("start") <= F.col("grams") + 1 + longer
    spans = spans.withColumn("cut", ~whole & (F.col("part.n") / F.col("grams") >= least))
    spans = spans.withColumns({"start": F.when(F.col("cut"), -F.col("part.start")).otherwise(F.col("start")), "end": F.when(F.col("cut"), F.col("part.end")).otherwise(F.col("end")), "coverage": F.when(F.col("cut"), F.col("part.n")).otherwise(F.size("seen")) / F.col("grams")})
    spans = spans.withColumn("verified", (F.col("coverage") >= least) & (whole | F.col("cut")) | F.col("edited"))
    return keyed.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words")), spans.drop("run", "seen", "template", "grams", "edited", "part", "cut")


def scan_documents(docs: DataFrame, **kwargs) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base phrases; first_word and last_word are
    their least and greatest start (null without any). labels adds those of
    verified templates. score is the largest coverage of a verified span, else
    half of the largest coverage of a candidate; 0 without one. Null and empty
    texts have no words. Rows with equal id and text get equal rows. An empty
    table gives an empty result.
    """
    rows, spans = scan(docs, **kwargs)
    base = F.col("verified") & F.col("is_base")
    found = spans.groupBy("doc_id", "text_hash").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("verified"), F.col("label")))), ",").alias("labels"),
        F.max(F.when(F.col("verified"), F.col("coverage")).otherwise(F.col("coverage") / 2)).alias("score"),
    )
    same = [rows["doc_id"].eqNullSafe(found["doc_id"]), rows["text_hash"] == found["text_hash"]]
    return rows.join(found.hint("merge"), same, "left").select(
        rows["doc_id"], "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
