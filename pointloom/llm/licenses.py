"""License scan: base phrases by position, and an exact containment join of text blocks with license templates.

A block is a sentence or line, or a sentence wrapped over lines; the latter meet only templates of WRAPPED words or more, as unrelated
lines may hold a few words by chance. A block contains a template if it has at least PERCENT of the template's distinct words. Words are
ordered by their frequency over the whole corpus, rarest first, so a block that qualifies has one of a template's first
m - ceil(PERCENT m) + 1 words. Those prefix words of all templates are a table, which blocks are joined with word by word; length (enough
template words in the block) and position (enough words after the common one on both sides) are tested, and what passes is verified by
the size of the intersection. The prefix table is broadcast while it is small, else shuffled like any other. Documents' texts stay where
they are: what is shuffled are word counts of the templates' vocabulary, and a short row for each document with its findings.

All steps are column expressions and joins. Null text: empty. Repeated rows and null doc_id: each row is scanned by itself. Equal scores
give the same score, whatever the template; labels are distinct and sorted. An empty table gives no rows; other columns aren't looked at.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of the base labels.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
# Sentences that licenses are known by.
TEMPLATES = [
    ("agpl-3", "GNU Affero General Public License version 3"),
    ("all-rights-reserved", "All rights reserved"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-3", "GNU Lesser General Public License version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
PERCENT = 80
#: Words of a template that wrapped blocks may meet, at least; rows of the prefix table that are broadcast, at most.
WRAPPED, BROADCAST_ROWS = 8, 20_000
LETTER = "0-9A-Za-z\\x{80}-\\x{10FFFF}"
BLOCK_END, WRAPPED_END = "[.!?][ \\t\\n]|\\n", "[.!?][ \\t\\n]|\\n[ \\t]*\\n"


def tokens(text: str) -> list[str]:
    """Distinct words of a template."""
    import re

    return sorted(set(re.findall("[0-9a-z]+", text.lower())))


def _lower(text) -> Column:
    """With A-Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_counts(docs: DataFrame, vocabulary: list[str], text_column: str = "text") -> dict[str, int]:
    """How often each word of the vocabulary stands in the corpus; partial sums before the shuffle."""
    words = docs.select(F.explode(F.regexp_extract_all(_lower(docs[text_column].cast("string")), F.lit(f"[{LETTER}]+"), F.lit(0))).alias("w"))
    counts = words.where(F.col("w").isin(vocabulary)).groupBy("w").agg(F.count("*").alias("n")).collect()
    return {r.w: r.n for r in counts}


class Plan:
    """Templates in global order with what each filter needs."""

    def __init__(self, counts: dict[str, int], templates=TEMPLATES, percent: int = PERCENT):
        sets = [(label, tokens(text)) for label, text in templates]
        self.order = sorted({w for _, t in sets for w in t}, key=lambda w: (counts.get(w, 0), w))
        rank = {w: i for i, w in enumerate(self.order)}
        self.templates = []
        for label, t in sets:
            need = -(-percent * len(t) // 100)
            own = sorted(t, key=rank.__getitem__)
            self.templates.append({"label": label, "words": own, "need": need, "prefix": own[: len(own) - need + 1]})
        self.rare = sorted({w for t in self.templates for w in t["prefix"]})

    def index(self, spark) -> DataFrame:
        """(token, place, template, label, words, need): a row for each prefix word of each template."""
        rows = [(w, i, k, t["label"], t["words"], t["need"]) for k, t in enumerate(self.templates) for i, w in enumerate(t["prefix"])]
        table = spark.createDataFrame(rows, "token string, place int, template int, label string, template_words array<string>, need int")
        return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def _strings(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _phrase_places(label: str, phrase: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(words))
    return f"transform(filter(sequence(0, size(words) - {len(words)}), i -> {same}), i -> named_struct('place', bigint(i), 'label', '{label}'))"


def scan(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, the greatest containment of a template."""
    plan = Plan(word_counts(docs, sorted({w for _, t in templates for w in tokens(t)}), text_column), templates, percent)
    df = docs.select(docs[id_column].alias("doc_id"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("words", F.regexp_extract_all("text", F.lit(f"[{LETTER}]+"), F.lit(0)))

    gap = f"[^{LETTER}]++"
    hints = "|".join(gap.join(p.split()) for p in BASE.values())
    phrase_hint = f"(?i)(?<![{LETTER}])(?:{hints})(?![{LETTER}])"
    none = "cast(array() AS array<struct<place:bigint,label:string>>)"
    lower = F.transform("words", lambda w: F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    df = df.withColumn("n_words", F.size("words").cast("bigint"))
    df = df.withColumn("words", F.when(F.col("text").rlike(phrase_hint), lower))
    places = [f"IF(size(words) >= {len(p.split())}, {_phrase_places(label, p)}, {none})" for label, p in BASE.items()]
    df = df.withColumn("base", F.expr(f"IF(words IS NULL, {none}, concat({', '.join(places)}))"))

    prefix_hint = f"(?i)(?<![{LETTER}])(?:{'|'.join(plan.rare)})(?![{LETTER}])"

    def blocks(end: str, wrapped: bool) -> Column:
        hinted = F.filter(F.split("text", end), lambda b: b.rlike(prefix_hint))
        words = lambda b: F.array_intersect(F.expr(_strings(plan.order)), F.regexp_extract_all(_lower(b), F.lit(f"[{LETTER}]+"), F.lit(0)))
        return F.transform(hinted, lambda b: F.struct(words(b).alias("block"), F.lit(wrapped).alias("wrapped")))

    kind = "array<struct<block:array<string>,wrapped:boolean>>"
    both = F.array_distinct(F.concat(blocks(BLOCK_END, False), blocks(WRAPPED_END, True)))
    df = df.withColumn("blocks", F.when(F.col("text").rlike(prefix_hint), both).otherwise(F.expr(f"cast(array() AS {kind})")))
    found = df.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "n_words",
        F.expr("bigint(size(base))").alias("n_base"),
        F.expr("array_min(transform(base, x -> x.place))").alias("first_word"),
        F.expr("array_max(transform(base, x -> x.place))").alias("last_word"),
        F.expr("array_distinct(transform(base, x -> x.label))").alias("phrases"),
        "blocks",
    )
    # The join: a row for each word of each block (one without, where there is none) meets the prefix words of templates.
    tokens_ = found.withColumn("b", F.explode_outer("blocks")).select("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "phrases", "b.block", "b.wrapped", F.posexplode_outer("b.block").alias("i", "token"))
    met = tokens_.join(plan.index(docs.sparkSession), "token", "left")
    size = "size(template_words)"
    may = f"size(block) >= need AND 1 + least({size} - place - 1, size(block) - i - 1) >= need AND (NOT wrapped OR {size} >= {WRAPPED})"
    met = met.withColumn("overlap", F.expr(f"IF({may}, size(array_intersect(template_words, block)), NULL)"))
    verified = F.expr("overlap >= need")
    out = met.groupBy("row").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "phrases")),
        F.max(F.when(verified, F.col("overlap") / F.expr(size))).alias("score"),
        F.collect_set(F.when(verified, F.col("label"))).alias("found"),
    )
    return out.select(
        F.col("doc_id").alias(id_column),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        _joined("phrases").alias("base_labels"),
        _joined("concat(phrases, found)").alias("labels"),
        F.expr("coalesce(score, 0D)").alias("score"),
    )


def _joined(labels: str) -> Column:
    return F.expr(f"array_join(array_sort(array_distinct({labels})), ',')")
