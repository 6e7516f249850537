"""Licence scan: phrases in place, and an exact containment join of text blocks with templates.

Blocks are the paragraphs of a text, that is its stretches between blank lines, so that a statement wrapped over several lines is in one block. A
block carries a template's label when some window of its words, twice as long as the template has distinct ones, holds at least ``CONTAINMENT`` of
these. Blocks are joined as sets of words, which loses no window of theirs, and the windows of the pairs found decide. The join
is exact and prefix-filtered: words of the templates are ranked by their frequency over all blocks of the corpus, rarest first; a block and a
template that overlap in ``need`` words share one of the first ``size - need + 1`` of either side;
length and place bound the overlap still possible; what is left is verified by intersection, then by windows.
Words outside every template cannot overlap, so blocks are cut down to template words first.

Everything is DataFrame expressions. The templates are a parameter, statements or whole licence texts; only their words' counts, bounded
by that list, reach the driver.

Defined cases: null and empty texts give no words, no labels, score 0; repeated rows get equal
results (they share a key of doc_id and text); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label and statement of each template.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("public-domain", "This work is dedicated to the public domain"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("reserved", "All rights reserved"),
]
#: Whole licence texts.
WHOLE_TEXTS = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]
CONTAINMENT = 0.85


def _lines(text: Column) -> Column:
    """Lower-case words parted by one space, lines by \\n."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _flat(text: Column) -> Column:
    return F.btrim(F.regexp_replace(_lines(text), "[ \n]+", " "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_places(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, n_base, first_word, last_word, base`` (array of labels)."""
    flat = F.col("_flat")
    found = docs.select("*", F.explode(F.array(_flat(F.col("text")))).alias("_flat"))
    n_words = F.when(flat == "", 0).otherwise(_spaces(flat) + 1).cast("long")
    padded = F.concat(F.lit(" "), flat, F.lit(" "))
    count, first, last, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in PHRASES.items():
        there = F.contains(padded, F.lit(f" {phrase} "))
        count = count + F.when(there, F.regexp_count(padded, F.lit(f" {phrase}(?= )"))).otherwise(0)
        first.append(F.when(there, _spaces(F.substring_index(padded, f" {phrase} ", 1))))
        last.append(F.when(there, n_words - _spaces(F.substring_index(padded, f" {phrase} ", -1))
                           - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    return found.select(
        "*", n_words.alias("n_words"), count.alias("n_base"),
        F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base")).drop("_flat")


def template_words(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))))
            for label, text in templates]


def _blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, block, run, words): the paragraphs, their words in order and as a set."""
    runs = F.transform(F.split(_lines(F.col("text")), r"\n *(?:\n *)+"), lambda x: F.btrim(F.translate(x, "\n", " ")))
    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.posexplode(F.filter(runs, lambda x: x != "")).alias("block", "run"))
    return rows.select("doc_id", "digest", "block", "run", F.array_distinct(F.split("run", " +")).alias("words"))


def _best_window(run: Column, words: Column, size: Column) -> Column:
    """The most of ``words`` in a window of ``size`` words of ``run``. Only words of theirs open one."""
    return F.element_at(F.transform(F.array(F.split(run, " +")), lambda w: F.array_max(F.transform(
        F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_contains(words, F.element_at(w, i))),
        lambda i: F.size(F.array_intersect(F.slice(w, i, size), words))))), 1)


def contained_templates(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES + WHOLE_TEXTS,
                        containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, digest, block, label, score) of each block and template label it contains."""
    sets = template_words(templates)
    vocabulary = sorted({w for _, words in sets for w in words})
    known = F.array(*map(F.lit, vocabulary))
    blocks = _blocks(docs)
    counts = dict(blocks.select(F.explode(F.array_intersect("words", known)).alias("word")).groupBy("word").count().collect())
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    needs = [max(1, math.ceil(containment * len(words) - 1e-9)) for _, words in sets]
    rare = {w for (_, words), need in zip(sets, needs, strict=True)
            for w in sorted(words, key=rank.get)[:len(words) - need + 1]}

    rows = F.array(*[F.struct(
        F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(need).alias("need"),
        F.array(*[F.lit(w) for w in words]).alias("own"), F.array(*[F.lit(rank[w]) for w in sorted(words, key=rank.get)]).alias("b"))
        for i, ((label, words), need) in enumerate(zip(sets, needs, strict=True))])
    wanted = docs.sparkSession.range(1).select(F.inline(rows))
    wanted = wanted.select("*", F.posexplode(F.slice("b", F.lit(1), F.size("b") - F.col("need") + 1)).alias("j", "r"))

    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    held = blocks.where(F.arrays_overlap("words", F.array(*map(F.lit, sorted(rare))))).select(
        "doc_id", "digest", "block", "run",
        F.sort_array(F.transform(F.array_intersect("words", known), lambda w: ranks[w])).alias("a"))
    held = held.where(F.size("a") >= min(needs)).select(
        "*", F.posexplode(F.slice("a", F.lit(1), F.size("a") - (min(needs) - 1))).alias("i", "r"))
    left = F.least(F.size("a") - F.col("i"), F.size("b") - F.col("j"))
    pairs = held.join(F.broadcast(wanted), "r").where(
        (F.size("a") >= F.col("need")) & (F.col("i") <= F.size("a") - F.col("need")) & (left >= F.col("need")))
    pairs = pairs.where(F.size(F.array_intersect("a", "b")) >= F.col("need")).select(
        "doc_id", "digest", "block", "label", "need", "own", _best_window(F.col("run"), F.col("own"), 2 * F.size("own")).alias("held"))
    return pairs.where(F.col("held") >= F.col("need")).select("doc_id", "digest", "block", "label", (F.col("held") / F.size("own")).alias("score"))


def scan(docs: DataFrame, **options) -> DataFrame:
    """One row per document: the phrase measures, ``base_labels``, ``labels`` and ``score``."""
    hits = contained_templates(docs, **options).groupBy("doc_id", "digest").agg(
        F.collect_set("label").alias("more"), F.max("score").alias("best"))
    hits = hits.withColumnRenamed("doc_id", "_doc").withColumnRenamed("digest", "_digest")
    base = phrase_places(docs.select("doc_id", "text")).select(
        "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"),
        "n_words", "n_base", "first_word", "last_word", "base")
    out = base.join(hits, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
