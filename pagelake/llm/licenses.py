"""License scan: phrases at their places, and an exact set-similarity join with license templates.

A text block (a paragraph, between blank lines) and a template are sets of words.  A block
meets a template when it holds at least ``share`` of the template's words.  Words are ordered
by how many documents hold them, the rarest first.  With ``need`` the least number of common
words, the first ``|T| - need + 1`` words of the template and the first ``|B| - need + 1`` of
the block must share one (prefix filter); blocks with fewer than ``need`` words are out
(length filter), and a common word at places i and j leaves at most
``min(|T| - i, |B| - j)`` common words (positional filter).  What is left is verified.  Words
of no template cannot be common to both and are dropped from blocks first, which keeps the
order.

Words are lower-cased runs of ASCII letters and digits and of characters beyond ASCII; null
texts count as empty.  Every row gives one row; repeated rows and null ids are treated like
others (documents are told apart by id and text together).
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.columns import let, plain_words, words
from pagelake.llm.common import text_column

# Phrases of the base scan and the labels they give.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Opening passages of public licenses and their notices.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files to deal in the software without restriction including without limitation the rights to use"
    " copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance"
    " with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that"
    " the following conditions are met",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
    " public license as published by the free software foundation",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser"
    " general public license as published by the free software foundation",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was"
    " not distributed with this file you can obtain one at",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify"
    " publish use compile sell or distribute this software",
}
PARAGRAPHS = r"\n[ \t\r]*\n\s*"


def template_sets(templates: Mapping[str, str], share: float) -> list[tuple[str, list[str], int]]:
    """(label, distinct words, least number in common)."""
    out = []
    for label, text in templates.items():
        own = list(dict.fromkeys(text.split()))
        out.append((label, own, math.ceil(round(len(own) * share, 9))))
    return out


def by_frequency(joined: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words by how many documents hold them, the rarest first.

    The result has as many rows as the templates have words.
    """
    own = F.array(*[F.lit(w) for w in vocabulary])
    held = joined.select(F.explode(F.array_intersect(own, words(F.col("joined")))).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in held.collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def matched_blocks(docs: DataFrame, order: list[str], sets: list[tuple[str, list[str], int]], share: float) -> DataFrame:
    """(doc_id, key, label, share) for each block that meets a template; docs has doc_id, key, text."""
    spark = docs.sparkSession
    rank = {w: i for i, w in enumerate(order)}
    index = [
        (label, sorted(own, key=rank.__getitem__), len(own), need, i, word)
        for label, own, need in sets
        for i, word in enumerate(sorted(own, key=rank.__getitem__)[: len(own) - need + 1])
    ]
    templates = spark.createDataFrame(index, "label string, template array<string>, t int, need int, i int, word string")
    least = min(need for _, _, need in sets)
    block = F.explode(F.split("text", PARAGRAPHS, -1)).alias("block")
    held = F.array_intersect(F.array(*[F.lit(w) for w in order]), words(plain_words(F.col("block"))))
    blocks = docs.select("doc_id", "key", block).select("doc_id", "key", held.alias("held")).where(F.size("held") >= least)
    prefix = F.posexplode(F.slice("held", F.lit(1), F.size("held") - least + 1)).alias("j", "word")
    return (
        blocks.select("doc_id", "key", "held", F.size("held").alias("b"), prefix)
        .join(templates, "word")
        .where("b >= need and j <= b - need and least(t - i, b - j) >= need")
        .select("doc_id", "key", "label", (F.size(F.array_intersect("template", "held")) / F.col("t")).alias("share"), "need", "t")
        .where(F.col("share") * F.col("t") >= F.col("need") - 1e-6)
        .select("doc_id", "key", "label", "share")
    )


def places(joined: Column, phrase: str) -> Column:
    """Word positions where a phrase starts."""
    own = phrase.split(" ")

    def starts(w: Column) -> Column:
        def same(i: Column) -> Column:
            hit = F.get(w, i) == own[0]
            for k, x in enumerate(own[1:], 1):
                hit = hit & F.coalesce(F.get(w, i + k) == x, F.lit(False))
            return hit

        return F.filter(F.sequence(F.lit(0), F.size(w) - 1), same)

    held = F.contains(F.concat(F.lit(" "), joined, F.lit(" ")), F.lit(f" {phrase} "))
    return F.when(held, let(F.split(joined, " "), starts)).otherwise(F.array().cast("array<int>"))


def scan(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    share: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: words, places of phrases, labels of both kinds, and a score.

    The score is 1 where a phrase stands, else the best share of a template met, else 0.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), text_column(docs, text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    joined = texts.select("doc_id", "key", plain_words(F.col("text")).alias("joined"))
    base = joined.select(
        "doc_id", "key",
        F.when(F.col("joined") == "", 0).otherwise(F.length("joined") - F.length(F.replace("joined", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        *[places(F.col("joined"), p).alias(f"p{i}") for i, p in enumerate(phrases)],
    )
    names = [f"p{i}" for i in range(len(phrases))]
    every = F.concat(*names)
    labels = F.array(*[F.when(F.size(n) > 0, F.lit(label)) for n, label in zip(names, phrases.values(), strict=True)])
    base = base.select(
        "doc_id", "key", "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(labels))).alias("base"),
    )
    sets = template_sets(templates, share)
    order = by_frequency(joined, sorted({w for _, own, _ in sets for w in own}))
    met = matched_blocks(texts, order, sets, share).groupBy("doc_id", "key").agg(F.collect_set("label").alias("met"), F.max("share").alias("best"))
    left, right = base.alias("l"), met.alias("r")
    both = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.key") == F.col("r.key")), "left")
    added = F.coalesce("r.met", F.array().cast("array<string>"))
    return both.select(
        "l.doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", added)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("r.best", F.lit(0.0))).alias("score"),
    )
