"""Licence scans: phrases in word order, and an exact set-similarity join of text blocks with licence notices. DataFrame functions only.

Blocks are windows of ``window`` words at every word of the whole text. A block matches a notice if it holds at least ``share`` of the notice's distinct words; only
blocks that begin with a word of a notice are tried, as any other can move on to the next such word and lose none. All words are put
in one order, rarest first by the number of documents that hold them. Of a notice with m words
that needs c, a match must share one of the first m - c + 1 (prefix filter); the block must hold c words
of the notices at all (length filter); and behind the shared word enough must be left on both sides
(positional filter). Pairs that pass are checked word by word. Notices are a small fixed table; what a block
has of their words is all that leaves the row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import let, stored

#: Words of the text before A-Z are lowered; the same places as in the lowered text.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Sentences by which well-known licences announce themselves, in lower case without punctuation.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("creative-commons", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words(text: Column) -> Column:
    """The words of a text, with A-Z in lower case.

    ``lower`` does more than that, but only for words with letters beyond ASCII, which no phrase or
    notice has. The one such letter that it makes an ASCII one, the Kelvin sign, is swapped first.
    """
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Ω")))
    return F.regexp_extract_all(plain, F.lit(WORD), 0)


def texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def places(found: Column, present: Column, phrase: str) -> Column:
    """Starts of the phrase's words in a row of words; rows that lack one of them are not searched."""
    parts = phrase.split(" ")
    here = [F.array_contains(present, p) for p in dict.fromkeys(parts)]
    starts = F.sequence(F.lit(0), F.size(found) - len(parts))
    search = F.filter(starts, lambda i: reduce(Column.__and__, [F.get(found, i + n) == p for n, p in enumerate(parts)]))
    enough = reduce(Column.__and__, here, F.size(found) >= len(parts))
    return F.when(enough, search).otherwise(F.array().cast("array<int>"))


def scan(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    phrases: tuple = PHRASES,
    notices: tuple = NOTICES,
    share: float = 0.8,
    window: int = 64,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    The score is 1 where a phrase stands, else the largest share of a notice that a block holds if that is
    enough for a match, else 0. Labels are distinct, sorted and joined by commas, empty if there are none. A null text has no words.
    Repeated rows give a row each. An empty table gives no rows; other columns are not read.
    """
    longest = max(len(n.split(" ")) for _, n in notices)
    if longest > window:
        raise ValueError(f"a notice of {longest} words needs a window of as many")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    vocabulary = sorted({w for _, n in notices for w in n.split(" ")})
    counted = rows.select(F.explode(F.array_intersect(texts(vocabulary), words(F.col("text")))).alias("word")).groupBy("word").count()
    seen = {r["word"]: r["count"] for r in counted.collect()}  # one row per word of the notices at most
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index, table = [], []
    for number, (label, notice) in enumerate(notices):
        own = sorted(set(notice.split(" ")), key=rank.get)
        need = -(-round(share * 1000) * len(own) // 1000)
        table.append((number, label, own, need))
        index += [(word, number, place, len(own), need) for place, word in enumerate(own[: len(own) - need + 1])]
    prefixes = sorted({word for word, *_ in index}, key=rank.get)
    index = spark.createDataFrame(index, "word string, notice int, place int, length int, need int")
    table = spark.createDataFrame(table, "notice int, label string, own array<string>, need int")
    known = sorted({*vocabulary, *(w for p, _ in phrases for w in p.split(" "))})

    def read(found: Column) -> Column:
        def use(present: Column) -> Column:
            near = F.arrays_overlap(present, texts(prefixes))
            held = lambda i: F.slice(found, i + 1, F.lit(window))
            worth = lambda i: F.array_contains(texts(vocabulary), F.get(found, i)) & F.arrays_overlap(held(i), texts(prefixes))
            starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0))), worth)
            blocks = F.array_distinct(F.transform(starts, lambda i: F.array_intersect(texts(order), held(i))))
            return F.struct(
                F.size(found).cast("long").alias("n_words"),
                *[places(found, present, p).alias(f"phrase{n}") for n, (p, _) in enumerate(phrases)],
                F.when(near, blocks).otherwise(F.array().cast("array<array<string>>")).alias("blocks"),
            )

        return let(F.array_intersect(texts(known), found), use)

    found = rows.select("doc_id", let(words(F.col("text")), read).alias("found")).select("doc_id", "found.*")
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "licence-rows")

    block = found.select("row", F.posexplode("blocks").alias("block", "words"))
    pairs = block.select("row", "block", "words", F.posexplode("words").alias("at", "word")).join(F.broadcast(index), "word")
    left = 1 + F.least(F.col("length") - F.col("place") - 1, F.size("words") - F.col("at") - 1)
    pairs = pairs.where((F.size("words") >= F.col("need")) & (left >= F.col("need"))).select("row", "block", "words", "notice").distinct()
    held = F.size(F.array_intersect("words", "own"))
    matches = pairs.join(F.broadcast(table), "notice").where(held >= F.col("need"))
    matches = matches.groupBy("row").agg(F.collect_set("label").alias("more"), F.max(held / F.size("own")).alias("held"))

    n_base = reduce(Column.__add__, [F.size(f"phrase{n}") for n in range(len(phrases))])
    every = F.concat(*[F.col(f"phrase{n}") for n in range(len(phrases))])
    base = F.filter(F.array(*[F.when(F.size(f"phrase{n}") > 0, F.lit(label)) for n, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull())
    return found.join(matches, "row", "left").select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("held", F.lit(0.0))).alias("score"),
    )
