"""License scans: an exact set-similarity join of text blocks with notice templates, in DataFrame operations only.

A text's blocks are windows of words of two sizes, SIZES, that overlap so that any run of up to 9, or 33, words is whole in
one of them.  A template is held against blocks of the least size that it fits in, so that words from
all over a text do not add up to a short one.  A block holds a template if it has at least the share THRESHOLD of
the template's distinct words (containment).  The join finds every such pair:

1. global order: the templates' words are numbered from the rarest up, by the number of documents that
   hold them.  Other words take no part in any overlap, so a block is the sorted set of
   the numbers of its template words;
2. length filter: a block with fewer of them than the least overlap that any template needs is left at
   once, and a pair needs a block of at least the template's own least overlap;
3. prefix filter: two sets with an overlap of ``need`` share one of the first ``size - need + 1`` words of
   either, so blocks and templates meet by the words of these prefixes;
4. positional filter: the first common word stands at place i of the template and j of the block, so the
   overlap is at most 1 + min(words after i, words after j); pairs below ``need`` are left;
5. what remains is confirmed by the whole intersection, and kept where its first word is the one
   that the pair met by: each pair comes once, without a distinct.

The templates are a parameter of bounded size (MAX_WORDS); they alone are broadcast.  Texts are read once: their
words become numbers where they are template words, and are kept as such.  The order is counted over all of
them, and then blocks are made, joined and confirmed in one stage, of those texts that hold a word of some
prefix; one shuffle of a short row a document follows, after sums on the map side.

Phrases are counted beside it: places where their words stand consecutively.

Defined cases: a null or empty text has no words, no labels and score 0; texts of any length are scanned
whole; repeated rows give repeated rows; an empty table gives an empty table; further columns
are left out, so names cannot clash.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialise, read_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZES = ((16, 8), (64, 32))  # words of a block, and between the starts of two
THRESHOLD = 0.9
MAX_WORDS = 20_000  # of all templates together
BITS = 63  # labels of one mask

#: Phrases and their labels (fixed values).
PHRASES: dict[str, str] = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices by label: sentences of well-known public licenses (fixed values).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsl-1.0", "boost software license version 1 0"),
    ("cc-by", "licensed under a creative commons attribution international license"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("cc0", "waived all copyright and related or neighboring rights to this work"),
    ("epl", "the accompanying materials are made available under the terms of the eclipse public license"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "no part of this publication may be reproduced distributed or transmitted in any form without prior written permission of the publisher"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
)


def need(n_words: int, threshold: float) -> int:
    """The least overlap with a template of so many distinct words."""
    return max(1, math.ceil(round(threshold * n_words, 9)))


class Template(NamedTuple):
    """A notice: its label, its distinct words, and which size of blocks it is held against."""

    label: str
    words: list[str]
    size: int


def template_sets(templates: tuple[tuple[str, str], ...]) -> list[Template]:
    """The templates' words; refuses more of them than can be broadcast, and longer runs than blocks hold whole."""
    cut = [(label, text.split()) for label, text in templates]
    if any(not words for _, words in cut) or sum(len(words) for _, words in cut) > MAX_WORDS:
        raise ValueError(f"templates need words, and have at most {MAX_WORDS} together")
    fits = lambda n: [k for k, (block, step) in enumerate(SIZES) if n <= block - step + 1]
    long = [label for label, words in cut if not fits(len(words))]
    if long:
        raise ValueError(f"templates are sentences of at most {SIZES[-1][0] - SIZES[-1][1] + 1} words: {', '.join(long)}")
    return [Template(label, sorted(set(words)), fits(len(words))[0]) for label, words in cut]


def lowered(text: Column) -> Column:
    """The text with A-Z lower-cased; other letters may be too, but none becomes ASCII: of those that would, one is put aside."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))


def vocabulary_of(sets: list[Template]) -> list[str]:
    """The templates' words; short ones, which are frequent, are found first."""
    return sorted({w for t in sets for w in t.words}, key=lambda w: (len(w), w))


def numbered(docs: DataFrame, vocabulary: list[str], phrases: dict[str, str], id_col: str, text_col: str) -> DataFrame:
    """Written once: (row, doc_id, n_words, numbers, seen, __p0, __p1, ...).

    row tells repeated rows apart; numbers: each word's place in the vocabulary or NULL; seen: the distinct ones;
    __p0, ...: where each phrase stands.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), lowered(F.col(text_col)).alias("low"))
    rows = rows.select("row", "doc_id", "low", F.regexp_extract_all("low", F.lit(WORD), F.lit(0)).alias("words"))
    every = F.array(*map(F.lit, vocabulary))
    number = lambda w: F.when(w.isin(vocabulary), F.array_position(every, w).cast("int") - 1)
    cut = [p.split() for p in phrases]
    longest = [max(p, key=len) for p in cut]  # a text without these has no phrase
    any_of = reduce(Column.__or__, [F.contains("low", F.lit(w)) for w in longest])
    firsts = F.filter(F.transform("words", lambda w, i: F.when(w.isin(sorted({p[0] for p in cut})), i)), lambda i: i.isNotNull())
    rows = rows.select("row", "doc_id", "words", F.transform("words", number).alias("numbers"), F.when(any_of, firsts).otherwise(F.array().cast("array<int>")).alias("starts"))

    def stands(phrase: list[str]) -> Column:
        return F.filter("starts", lambda i: F.slice("words", i + 1, F.lit(len(phrase))) == F.array(*map(F.lit, phrase)))

    seen = F.array_distinct(_present(F.col("numbers")))
    rows = rows.select("row", "doc_id", F.size("words").alias("n_words"), "numbers", seen.alias("seen"), *[stands(p).alias(f"__p{k}") for k, p in enumerate(cut)])
    return materialise(rows, "words")


def word_ranks(rows: DataFrame, vocabulary: list[str]) -> list[int]:
    """Each vocabulary word's rank from the rarest up, by the rows that hold it; ties by place."""
    found = rows.select(F.explode("seen").alias("k")).groupBy("k").count().collect()  # as many as the vocabulary has at most
    counts = {r["k"]: r["count"] for r in found}
    order = sorted(range(len(vocabulary)), key=lambda k: (counts.get(k, 0), k))
    return [rank for _, rank in sorted((k, rank) for rank, k in enumerate(order))]


def _present(column: Column) -> Column:
    return F.filter(column, lambda x: x.isNotNull())


def block_sets(ranks: list[int], least: dict[int, int], prefixes: list[int]) -> Column:
    """(size, block, own) of each window of ``numbers``: own is the sorted set of its words' ranks; sizes go by ``least``.

    Windows with fewer than ``least`` words of templates are left out, and so are all windows of a text that
    holds no word of a template's prefix.
    """
    of = F.array(*map(F.lit, ranks))

    def windows(size: int) -> Column:
        block, step = SIZES[size]
        last = F.greatest(F.lit(0), F.ceil((F.col("n_words") - block) / step).cast("int"))
        numbers = lambda b: F.array_distinct(_present(F.slice("numbers", b * step + 1, F.lit(block))))
        one = lambda b: F.struct(F.lit(size).alias("size"), b.alias("block"), F.sort_array(F.transform(numbers(b), lambda k: F.get(of, k))).alias("own"))
        return F.filter(F.transform(F.sequence(F.lit(0), last), one), lambda x: F.size(x["own"]) >= least[size])

    rare = F.array(*[F.lit(k) for k, rank in enumerate(ranks) if rank in prefixes])
    return F.when((F.size("seen") >= min(least.values())) & F.arrays_overlap(F.col("seen"), rare), F.concat(*map(windows, least)))


def _prefixes(sets: list[Template], vocabulary: list[str], ranks: list[int], threshold: float) -> list[tuple[int, int, int, int, list[int], int]]:
    """(size, rank, place, template, ranks of the template, need) for each word of each template's prefix."""
    of, out = dict(zip(vocabulary, ranks)), []
    for t, template in enumerate(sets):
        tokens, least = sorted(of[w] for w in template.words), need(len(template.words), threshold)
        out += [(template.size, rank, i, t, tokens, least) for i, rank in enumerate(tokens[: len(tokens) - least + 1])]
    return out


def _index(spark: SparkSession, prefixes: list[tuple[int, int, int, int, list[int], int]]) -> DataFrame:
    """The prefixes as a table: __of, __rank, __i, template, __tokens, __need."""
    rows = [
        F.struct(F.lit(size).alias("__of"), F.lit(rank).alias("__rank"), F.lit(i).alias("__i"), F.lit(t).alias("template"), F.array(*map(F.lit, tokens)).alias("__tokens"), F.lit(least).alias("__need"))
        for size, rank, i, t, tokens, least in prefixes
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def block_matches(rows: DataFrame, keep: list[str], sets: list[Template], vocabulary: list[str], threshold: float) -> DataFrame:
    """All pairs of blocks of ``numbered`` rows and templates: the columns ``keep``, size, block, template (its place), overlap, containment.

    A text without any pair has a row (or several) whose template is NULL.
    """
    ranks = word_ranks(rows, vocabulary)
    least = {size: min(need(len(t.words), threshold) for t in sets if t.size == size) for size in sorted({t.size for t in sets})}
    prefixes = _prefixes(sets, vocabulary, ranks, threshold)
    blocks = block_sets(ranks, least, sorted({p[1] for p in prefixes}))
    rows = rows.select(*keep, F.explode_outer(blocks).alias("__b")).select(*keep, "__b.size", "__b.block", F.col("__b.own").alias("__own"))
    at_least = F.get(F.array(*[F.lit(least.get(k, 1)) for k in range(len(SIZES))]), F.col("size"))
    prefix = F.slice("__own", F.lit(1), F.size("__own") - (at_least - 1))
    rows = rows.select(*keep, "size", "block", "__own", F.posexplode_outer(prefix).alias("__j", "__number"))
    index = F.broadcast(_index(rows.sparkSession, prefixes))  # its size is checked in template_sets
    common = F.array_intersect(F.col("__own"), F.col("__tokens"))
    reach = F.least(F.size("__tokens") - F.col("__i"), F.size("__own") - F.col("__j"))  # the overlap is no more than this
    meets = (F.col("size") == F.col("__of")) & (F.col("__number") == F.col("__rank")) & (F.size("__own") >= F.col("__need")) & (reach >= F.col("__need"))
    found = rows.join(index, meets & (F.size(common) >= F.col("__need")) & (F.get(common, F.lit(0)) == F.col("__rank")), "left")
    overlap = F.when(F.col("template").isNotNull(), F.size(common))
    return found.select(*keep, "size", "block", "template", overlap.alias("overlap"), (overlap / F.size("__tokens")).alias("containment"))


def _checked(templates: tuple[tuple[str, str], ...], threshold: float) -> tuple[list[Template], list[str]]:
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a share above 0")
    sets = template_sets(templates)
    return sets, vocabulary_of(sets)


def license_blocks(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first_word, n_words, label, template, overlap, containment) of every block that holds a template; words count from 0."""
    sets, vocabulary = _checked(templates, threshold)
    pairs = block_matches(numbered(docs, vocabulary, PHRASES, id_col, text_col), ["doc_id"], sets, vocabulary, threshold).where("template is not null")
    label = F.get(F.array(*[F.lit(name) for name, _ in templates]), F.col("template"))
    block, step = (F.get(F.array(*[F.lit(size[k]) for size in SIZES]), F.col("size")) for k in (0, 1))
    return pairs.select("doc_id", (F.col("block") * step).alias("first_word"), block.alias("n_words"), label.alias("label"), "template", "overlap", "containment")


def license_labels(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 where a phrase stands, else the greatest containment of a template that was found, else 0.
    """
    sets, vocabulary = _checked(templates, threshold)
    rows = numbered(docs, vocabulary, phrases, id_col, text_col)
    places = F.flatten(F.array(*[F.col(f"__p{k}") for k in range(len(phrases))]))
    base = F.array(*[F.when(F.size(f"__p{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())])
    rows = rows.withColumn("places", places)
    rows = rows.select(
        "row", "doc_id", "numbers", "seen", F.col("n_words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(_present(base))), ",").alias("base_labels"),
    )
    keys = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    pairs = block_matches(rows, keys, sets, vocabulary, threshold)
    names = sorted({label for label, _ in templates})
    of_template = [names.index(label) for label, _ in templates]
    bits = lambda k: F.array(*[F.lit(1 << n - k if k <= n < k + BITS else 0).cast("long") for n in of_template])
    masks = [F.bit_or(F.get(bits(k), F.col("template"))).alias(f"mask{k}") for k in range(0, len(names), BITS)]
    # a text's rows are in one task, so partial sums leave one of them to shuffle
    found = pairs.groupBy(*keys).agg(F.max("containment").alias("best"), *masks)
    bit = lambda k: F.coalesce(F.col(f"mask{k // BITS * BITS}").bitwiseAND(F.lit(1 << k % BITS).cast("long")), F.lit(0).cast("long")) != 0
    own = _present(F.array(*[F.when(bit(k), F.lit(label)) for k, label in enumerate(names)]))
    every = F.array_sort(F.array_distinct(F.concat(F.filter(F.split("base_labels", ","), lambda x: x != ""), own)))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join(every, ",").alias("labels"), score.alias("score"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base phrases and license labels."""
    return license_labels(read_columns(spark, sf_dir, "documents", "doc_id", "text"))
