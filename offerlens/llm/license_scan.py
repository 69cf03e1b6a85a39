"""License scans in DataFrame functions only: phrases that name a license, and notices found by a set-similarity join.

Each template is cut into its set of words, each text into blocks of twice the template's words, beginning at
every multiple of these, so that a passage as long as the template is whole in one of them. A block meets a
template if it holds at least the threshold's share of the template's words. Words are ordered by the number of
documents that hold them, rarest first. A block that meets a template shares a word of its prefix with one of
the template's (prefix filter), has as many words as must be shared (length filter), and has as many left from the
first shared word on (positional filter); what passes all three is counted. Only words that some template has
are kept of a text, and cut into stretches of bounded length, so no text is shuffled or compared whole.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

GAP, WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Phrases and the labels that they give.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Words of all templates together that the plan carries at most.
MOST_WORDS = 20_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str

    @property
    def words(self) -> list[str]:
        return words_in(self.text)


def words_in(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(ascii_uppercase, ascii_lowercase)))


#: The notices by which these licenses ask to be named.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("public-domain", "This is free and unencumbered software released into the public domain"),
)


def needed(template: Template, threshold: float) -> int:
    """How many different words of a template a block must hold."""
    return max(1, math.ceil(threshold * len(set(template.words)) - 1e-9))


def hits_of(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n_words and hits (place p and word w of every word of the vocabulary, in order) of every row."""
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), ascii_uppercase, ascii_lowercase)
    cut = docs.select("doc_id", F.filter(F.split(lower, GAP), lambda w: w != "").alias("words"))
    placed = F.transform("words", lambda w, i: F.struct(i.alias("p"), w.alias("w")))
    return cut.select("doc_id", F.size("words").cast("long").alias("n_words"), F.filter(placed, lambda x: x["w"].isin(vocabulary)).alias("hits"))


def places_of(phrase: list[str]) -> Column:
    """Where the words of a phrase stand consecutively: neighbours in hits, and neighbours in the text."""
    follows = lambda h, j, k: (F.get("hits", j + k)["w"] == phrase[k]) & (F.get("hits", j + k)["p"] == h["p"] + k)

    def place(h: Column, j: Column) -> Column:
        hit = h["w"] == phrase[0]
        for k in range(1, len(phrase)):
            hit = hit & follows(h, j, k)
        return F.when(hit, h["p"])

    found = F.filter(F.transform("hits", place), lambda p: p.isNotNull())
    # Texts without the last word are not walked through again.
    return F.when(F.exists("hits", lambda h: h["w"] == phrase[-1]), found).otherwise(F.array().cast("array<int>"))


def word_order(scanned: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by number of documents, rarest first. As many rows come to the driver as it has words."""
    each = scanned.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w"))
    counts = {r.w: r.n for r in each.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def matches_in(scanned: DataFrame, templates: tuple[Template, ...], threshold: float, ordered: list[str]) -> DataFrame:
    """key, template (its number), block (its number), shared: every block that meets a template, from rows with key and hits."""
    spark = scanned.sparkSession
    rank = {w: i for i, w in enumerate(ordered)}
    sets = [sorted({rank[w] for w in t.words}) for t in templates]
    least = [needed(t, threshold) for t in templates]
    long = [len(t.words) for t in templates]
    prefixes = [s[: len(s) - a + 1] for s, a in zip(sets, least)]
    rare = sorted({r for p in prefixes for r in p})
    # A stretch begins at every multiple of the hits that the longest block can have, and is twice as long.
    step = 2 * max(long)
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size("hits") - 1) / step).cast("int")), lambda g: F.slice("hits", g * step + 1, 2 * step))
    cut = scanned.where(F.exists("hits", lambda h: h["w"].isin([ordered[r] for r in rare]))).select("key", F.explode(stretches).alias("hits"))
    number = lambda w: (F.array_position(F.array(*map(F.lit, ordered)), w) - 1).cast("int")
    cut = cut.where(F.exists("hits", lambda h: h["w"].isin([ordered[r] for r in rare])))
    cut = cut.select("key", F.transform("hits", lambda h: F.struct(h["p"].alias("p"), number(h["w"]).alias("r"))).alias("hits"))
    index = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(t).alias("t"), F.lit(long[t]).alias("m")) for t, p in enumerate(prefixes) for r in p))

    def blocks(h: Column, e: Column) -> Column:
        last = F.floor(h["p"] / e["m"]).cast("int")
        return F.array(*(F.struct(e["t"].alias("template"), b.cast("int").alias("block")) for b in (last, last - 1)))

    met = F.flatten(F.transform(F.filter("hits", lambda h: h["r"].isin(rare)), lambda h: F.flatten(F.transform(F.filter(index, lambda e: e["r"] == h["r"]), lambda e: blocks(h, e)))))
    pairs = cut.select("key", "hits", F.explode(F.array_distinct(met)).alias("c")).select("key", "hits", "c.template", "c.block").where("block >= 0")
    known = spark.createDataFrame([(t, long[t], least[t], sets[t]) for t in range(len(templates))], "template int, m int, least int, theirs array<int>")
    pairs = pairs.join(F.broadcast(known), "template")
    inside = F.filter("hits", lambda h: (h["p"] >= F.col("block") * F.col("m")) & (h["p"] < (F.col("block") + 2) * F.col("m")))
    sized = pairs.select("key", "template", "block", "least", "theirs", F.array_sort(F.array_distinct(F.transform(inside, lambda h: h["r"]))).alias("ours")).where(F.size("ours") >= F.col("least"))
    # Spark may work this out before the length filter.
    prefix = lambda c: F.slice(c, 1, F.greatest(F.lit(0), F.size(c) - F.col("least") + 1))
    first = sized.withColumn("first", F.get(F.array_intersect(prefix("ours"), prefix("theirs")), F.lit(0))).where("first is not null")
    left = lambda c: F.size(c) - F.array_position(c, F.col("first"))
    near = first.where(1 + F.least(left("ours"), left("theirs")) >= F.col("least"))
    shared = near.select("key", "template", "block", "least", F.size(F.array_intersect("ours", "theirs")).alias("shared")).where("shared >= least")
    # A block that two stretches hold is whole in one of them.
    return shared.groupBy("key", "template", "block").agg(F.max("shared").alias("shared"))


def prepared(docs: DataFrame, templates: tuple[Template, ...], phrases: tuple[tuple[str, str], ...], id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """The rows with a key, their counts and hits, written; and all words of templates and phrases."""
    vocabulary = sorted({w for t in templates for w in t.words} | {w for p, _ in phrases for w in words_in(p)})
    if len(vocabulary) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} different words")
    if not all(t.words for t in templates) or not all(words_in(p) for p, _ in phrases):
        raise ValueError("a template or phrase has no word")
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(hits_of(rows, vocabulary).withColumn("key", F.monotonically_increasing_id())), vocabulary


def matching_blocks(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, template (its number), label, first_word, last_word and containment of every block that meets a template.

    first_word and last_word bound the block. Null texts have no words; repeated rows give repeated results.
    """
    scanned, vocabulary = prepared(docs, templates, (), id_col, text_col)
    found = matches_in(scanned, templates, threshold, word_order(scanned, vocabulary))
    known = scanned.sparkSession.createDataFrame([(i, t.label, len(t.words), len(set(t.words))) for i, t in enumerate(templates)], "template int, label string, m int, size int")
    ends = F.least((F.col("block") + 2) * F.col("m"), F.col("n_words")) - 1
    joined = found.join(F.broadcast(known), "template").join(scanned.select("key", "doc_id", "n_words"), "key")
    return joined.select("doc_id", "template", "label", (F.col("block") * F.col("m")).cast("long").alias("first_word"), ends.cast("long").alias("last_word"), (F.col("shared") / F.col("size")).alias("containment"))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    Words are runs of digits, letters a to z (A-Z are lower-cased) and characters beyond ASCII. n_base counts the
    places of all phrases, first_word and last_word are the smallest and largest of them (else null), base_labels
    names their labels. labels adds those of templates that a block meets. score is 1 where a phrase stands, else the
    largest share of a template's words in one block, 0 where no block meets any. A null text counts as empty: no
    words, empty labels, score 0. Repeated rows give repeated results, null ids stay null, an empty table gives
    no rows, other columns are not read.
    """
    scanned, vocabulary = prepared(docs, templates, phrases, id_col, text_col)
    found = matches_in(scanned, templates, threshold, word_order(scanned, vocabulary))
    known = scanned.sparkSession.createDataFrame([(i, t.label, len(set(t.words))) for i, t in enumerate(templates)], "template int, label string, size int")
    best = found.join(F.broadcast(known), "template").groupBy("key").agg(F.collect_set("label").alias("more"), F.max(F.col("shared") / F.col("size")).alias("share"))
    placed = scanned.select("key", "doc_id", "n_words", *(places_of(words_in(p)).alias(f"at{i}") for i, (p, _) in enumerate(phrases)))
    at = F.concat(F.array().cast("array<int>"), *(F.col(f"at{i}") for i in range(len(phrases))))
    named = F.array_distinct(F.filter(F.array(F.lit(None).cast("string"), *(F.when(F.size(f"at{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases))), lambda x: x.isNotNull()))
    counted = placed.select("key", "doc_id", "n_words", at.alias("at"), named.alias("named")).join(best, "key", "left")
    listed = lambda labels: F.concat_ws(",", F.array_sort(labels))
    return counted.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        listed(F.col("named")).alias("base_labels"),
        listed(F.array_union("named", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("at") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
