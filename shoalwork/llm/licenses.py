"""License scan: exact set-similarity join of text blocks with license templates.

Blocks (the sentences of every line) match a template when they hold at least `threshold` of its
distinct words. So do windows of consecutive words, whatever lines and stops part them, that are as long as
the template and as many words more as may be missing. Words are ordered by how many documents of the corpus hold them, rarest first. A
block or window can only match if it holds one of a template's first |T| - o + 1 words in that order, where o is
the least overlap (prefix filter), and if it has o words at all (length filter). Windows are tried around the places of such words alone (positional filter). For blocks, that enough words of the
template remain from the place of its hit on is asked too, but any place in the prefix leaves o. What passes is counted
out, so no match is lost and none is estimated.

Templates are a fixed list, so they and their words (under a thousand) are all that is broadcast, and
all that reaches the driver is one count per template word. Everything runs in Spark SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import doc_texts

# Phrases whose words standing consecutively name a license, and its label.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Sentences by which texts declare their license, and its label.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("this project is licensed under the terms of the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
)

BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BLOCK_END = "\n|[.!?]+(?=[\\s]|$)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced_words(lowered: Column) -> Column:
    """The words of a lower-cased text between single spaces, with one at either end; a space if none."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(lowered, F.lit(" ")), BREAKS, " ")))


def template_index(templates, threshold: float, frequency: dict[str, int]) -> list[dict]:
    """Each template's words in global order, least overlap, prefix and length of a window."""
    out = []
    for number, (text, label) in enumerate(templates):
        words = sorted(set(text.split()), key=lambda w: (frequency.get(w, 0), w))
        least = max(1, math.ceil(threshold * len(words) - 1e-9))
        span = len(text.split()) + len(words) - least
        out.append({"template": number, "label": label, "words": words, "least": least, "span": span, "prefix": words[: len(words) - least + 1]})
    return out


def word_frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many documents each of the given words stands: at most len(words) rows."""
    held = F.array_intersect(F.split(spaced_words(lower_ascii(F.col("text"))), " "), F.array(*map(F.lit, words)))
    rows = doc_texts(docs).select(F.explode(held).alias("word")).groupBy("word").count().collect()
    return {r["word"]: r["count"] for r in rows}


def match_blocks(docs: DataFrame, index: list[dict]) -> DataFrame:
    """_row, label and containment of every block that matches a template.

    docs has _row (a key), lowered (lower-cased text) and spaced (its words).
    """
    spark = docs.sparkSession
    first = sorted({w for t in index for w in t["prefix"]})
    known = F.array(*map(F.lit, first))
    blocks = (
        docs.filter(F.arrays_overlap(F.split("spaced", " "), known))
        .select("_row", F.explode(F.split("lowered", BLOCK_END)).alias("block"))
        .select("_row", F.array_distinct(F.split(F.trim(spaced_words(F.col("block"))), " ")).alias("tokens"))
    )
    hits = blocks.select("*", F.explode(F.array_intersect("tokens", known)).alias("token"))
    prefixes = spark.createDataFrame(
        [(w, t["template"], i, len(t["words"]), t["least"], t["words"], t["label"]) for t in index for i, w in enumerate(t["prefix"])],
        "token string, template int, place int, n_template int, least int, words array<string>, label string",
    )
    long_enough = F.size("tokens") >= F.col("least")
    enough_left = F.col("n_template") - F.col("place") >= F.col("least")
    overlap = F.size(F.array_intersect("tokens", "words"))
    return (
        hits.join(F.broadcast(prefixes), "token")
        .filter(long_enough & enough_left)
        .withColumn("overlap", overlap)
        .filter(F.col("overlap") >= F.col("least"))
        .select("_row", "label", (F.col("overlap") / F.col("n_template")).alias("containment"))
    )


def match_windows(docs: DataFrame, index: list[dict]) -> DataFrame:
    """_row, label and containment of every window of words that matches a template; docs as for match_blocks.

    A window that matches holds a word of the template's prefix, and lies whole among the words up to a window before and after it. So the words
    around each place of a prefix word are held against the templates that have that word in their prefix, found by the word; a text without such a word is passed over.
    """
    spark = docs.sparkSession
    step = max(t["span"] for t in index)
    known = F.array(*(F.lit(w) for w in sorted({w for t in index for w in t["prefix"]})))
    words = F.split(F.trim("spaced"), " ")

    def around(w: Column) -> Column:
        places = F.filter(F.transform(w, lambda token, i: F.when(F.array_contains(known, token), F.struct(token.alias("token"), i.alias("i")))), lambda h: h.isNotNull())
        return F.array_distinct(F.transform(places, lambda h: F.struct(h["token"].alias("token"), F.slice(w, F.greatest(h["i"] + 2 - step, F.lit(1)), 2 * step - 1).alias("tokens"))))

    # as a lambda variable, the words of a text are taken once and not anew for every use
    hits = docs.filter(F.arrays_overlap(F.split("spaced", " "), known)).select("_row", F.explode(F.transform(F.array(words), around)[0]).alias("_h")).select("_row", "_h.*")
    templates = spark.createDataFrame([(w, t["words"], t["least"], t["span"], t["label"]) for t in index for w in t["prefix"]], "token string, words array<string>, least int, span int, label string")
    last = F.greatest(F.size("tokens") - F.col("span") + 1, F.lit(1))
    overlaps = F.transform(F.sequence(F.lit(1), last), lambda i: F.size(F.array_intersect(F.slice("tokens", i, F.col("span")), F.col("words"))))
    return (
        hits.join(F.broadcast(templates), "token")  # a few rows for each template
        .filter(F.size(F.array_intersect("tokens", "words")) >= F.col("least"))
        .withColumn("overlap", F.array_max(overlaps))
        .filter(F.col("overlap") >= F.col("least"))
        .select("_row", "label", (F.col("overlap") / F.size("words")).alias("containment"))
    )


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.9) -> DataFrame:
    """Labels every document with the licenses it names.

    Returns doc_id, n_words, n_base (places of the phrases), first_word and last_word (where the first and
    last of them begin; null without), base_labels, labels (sorted, comma-joined; empty without) and
    score (1 for a phrase, else the largest containment of a template that matches, else 0).
    Null texts count as empty; a row that repeats another gets the same result; columns other than
    doc_id and text are not read.
    """
    words = sorted({w for text, _ in templates for w in text.split()})
    index = template_index(templates, threshold, word_frequencies(docs, words))
    key = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).cast("long"), F.xxhash64("text"))
    lowered = doc_texts(docs).select("doc_id", key.alias("_row"), lower_ascii(F.col("text")).alias("lowered"))
    spaced = lowered.withColumn("spaced", spaced_words(F.col("lowered")))

    def count_spaces(c: Column) -> Column:
        return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")

    counts, firsts, lasts, found = [], [], [], []
    for text, label in phrases:
        there = F.contains("spaced", F.lit(f" {text} "))
        pattern = f"(?<= ){text}(?= )"
        counts.append(F.when(there, F.regexp_count("spaced", F.lit(pattern)).cast("long")).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(there, count_spaces(F.split("spaced", pattern, 2)[0]) - 1))
        lasts.append(F.when(there, count_spaces(F.regexp_extract("spaced", f"(?s)^(.*){pattern}", 1)) - 1))
        found.append(F.when(there, F.lit(label)))
    base = spaced.select(
        "doc_id", "_row",
        (count_spaces(F.col("spaced")) - 1).alias("n_words"),
        sum(counts[1:], counts[0]).alias("n_base"),
        F.array_min(F.array(*firsts)).alias("first_word"),
        F.array_max(F.array(*lasts)).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))).alias("base"),
    )
    matched = match_blocks(spaced, index).unionByName(match_windows(spaced, index)).groupBy("_row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return base.join(matched, "_row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
