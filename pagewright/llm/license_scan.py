"""License scans: an exact set-similarity join of text blocks with license templates.

A template is a set of words. Every text is split into words once; what is written of it
is its number of words and its hits, the places of words that any template has. All
further steps read that table.

Words of all templates are ordered by their counts over the whole corpus, rarest first. A
block that holds the fraction ``threshold`` of a template's words must hold one of its
first n - needed + 1 words (the prefix), so hits join the templates on their prefixes
only. A candidate stands for the blocks whose rarest word of the template is the joined one.
It is kept if enough words are left in the text about it (length filter), and if the words
of the template that come after the joined one in the order and stand near enough to it make
up the rest (positional filter); then every block that covers the place is counted
exactly. A block is a run of 1.5 times the template's words, or the whole text if that
is shorter.

Base phrases are templates with threshold 1 whose words must stand consecutively; the
same join finds them, with one prefix word. Templates are a parameter; they are broadcast
while they are small, else shuffled by word.

Null and empty texts have no words and no labels, score 0. Repeated rows get equal
results; texts of any length are scanned whole. Columns beyond doc_id and text are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import common

THRESHOLD = 0.8
SHORT = 8
BROADCAST_ROWS = 10_000
#: Phrases whose consecutive words count as base places.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Opening sentences of public licenses.
TEMPLATES = (
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)


def templates(spark: SparkSession, base=BASE, texts=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, label, base, phrase, needed, span) of each template; phrase holds its words in order."""
    rows = []
    for is_base, group in ((True, base), (False, texts)):
        for text, label in group:
            words = text.split()
            n = len(set(words))
            # Short templates differ by a word from each other: they must be held whole.
            needed = n if is_base or n < SHORT else -(-round(threshold * 1000) * n // 1000)
            rows.append((len(rows), label, is_base, words, needed, len(words) if is_base else -(-3 * len(words) // 2)))
    return spark.createDataFrame(rows, "id int, label string, base boolean, phrase array<string>, needed int, span int")


def hits(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n_words, hits) of each row; hits: array<struct<pos, token>> of template words, words from 0."""
    known = {w for r in patterns.select("phrase").distinct().toLocalIterator() for w in r.phrase}
    words = docs.select("doc_id", *common.row_key(F.col("doc_id"), F.col("text")), common.alnum_words(F.col("text")).alias("w"))
    places = F.transform("w", lambda token, pos: F.struct(pos.alias("pos"), token.alias("token")))
    held = F.filter(places, lambda h: h["token"].isin(known)) if known else F.slice(places, 1, 0)
    return words.select("doc_id", "k1", "k2", F.size("w").cast("long").alias("n_words"), held.alias("hits"))


def index(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """Templates under each word of their prefix: token, place (in the phrase), later (the words after it in the order)."""
    each = patterns.select("*", F.posexplode("phrase").alias("place", "token"))
    each = each.groupBy("id", "label", "base", "phrase", "needed", "span", "token").agg(F.min("place").alias("place"))
    counts = found.select(F.explode("hits.token").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ranked = each.join(counts, "token", "left").groupBy("id", "label", "base", "phrase", "needed", "span").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place"))).alias("order"))
    prefix = F.slice("order", 1, F.size("order") - F.col("needed") + 1)
    out = ranked.select("id", "label", "base", "phrase", "needed", "span", F.col("order.token").alias("words"), F.posexplode(prefix).alias("rank", "x"))
    return common.materialize(out.select("id", "label", "base", "phrase", "needed", "span", "words", F.slice("words", F.col("rank") + 2, F.size("words")).alias("later"), "x.token", "x.place"), "license-index")


def _inside(about: Column, low: Column, high: Column) -> Column:
    """The different words of the hits from place ``low`` to before ``high``."""
    return F.array_distinct(F.transform(F.filter(about, lambda h: (h["pos"] >= low) & (h["pos"] < high)), lambda h: h["token"]))


def matched(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """(k1, k2, label, base, start, share) of each base place and of each block that meets its threshold, from ``hits``."""
    listed = index(found, patterns)
    # Templates are few, so their prefix words and the longest span are parameters here.
    prefix = [r.token for r in listed.select("token").distinct().collect()]
    reach = listed.agg(F.max("span")).first()[0] or 0

    def candidates(hits: Column) -> Column:
        # As hits ascend, none beyond ``reach`` hits from this one is within ``reach`` words of it: rows stay short however long the text is.
        about = lambda x: F.slice(hits, F.greatest(x["at"] - reach, F.lit(0)) + 1, F.least(x["at"], F.lit(reach)) + reach)
        places = F.filter(F.transform(hits, lambda h, at: F.struct(at.alias("at"), h["pos"].alias("pos"), h["token"].alias("token"))), lambda x: x["token"].isin(prefix))
        return F.transform(places, lambda x: F.struct(x["pos"].alias("pos"), x["token"].alias("token"), about(x).alias("about")))

    near = found.where(F.size("hits") > 0).select("k1", "k2", "n_words", F.inline(common.let(F.col("hits"), candidates)))
    near = near.join(common.broadcast_if(listed, common.small(listed, BROADCAST_ROWS)), "token")
    pos, span = F.col("pos"), F.col("span")
    # Base: the phrase lies at one place only.
    start = pos - F.col("place")
    run = F.filter("about", lambda h: (h["pos"] >= start) & (h["pos"] < start + span))
    exact = F.col("base") & (F.transform(run, lambda h: h["token"]) == F.col("phrase"))
    # Others: the first and last block that cover the place.
    low, high = F.greatest(pos - span + 1, F.lit(0)), F.least(pos, F.greatest(F.col("n_words").cast("int") - span, F.lit(0)))
    high = F.greatest(low, high)
    long_enough = F.least(F.col("n_words"), high + span) - low >= F.col("needed")
    rest = F.array_intersect(_inside(F.col("about"), low, high + span), F.col("later"))
    may = ~F.col("base") & long_enough & (F.size(rest) + 1 >= F.col("needed"))
    kept = near.where(exact | may).select("k1", "k2", "label", "base", "needed", "words", "span", F.when(F.col("base"), start).otherwise(low).alias("low"), (high - low).alias("more"), "about")
    base_block = F.array(F.struct(F.lit(0).alias("s"), F.col("needed").alias("n")))
    shared = F.transform(F.sequence(F.lit(0), F.col("more")), lambda s: F.struct(s.alias("s"), F.size(F.array_intersect(_inside(F.col("about"), F.col("low") + s, F.col("low") + s + F.col("span")), F.col("words"))).alias("n")))
    each = kept.select("k1", "k2", "label", "base", "needed", "low", F.size("words").alias("size"), F.inline(F.when(F.col("base"), base_block).otherwise(shared)).alias("s", "n"))
    return each.where(F.col("n") >= F.col("needed")).select("k1", "k2", "label", "base", (F.col("low") + F.col("s")).cast("long").alias("start"), (F.col("n") / F.col("size")).alias("share"))


def blocks(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``matched`` of rows (doc_id, text)."""
    return matched(common.materialize(hits(docs, patterns), "license-hits"), patterns)


def scan(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Each row of ``docs`` (doc_id, text): doc_id, n_words, places, labels and the greatest share (null: 0)."""
    base = F.col("base")
    found = common.materialize(hits(docs, patterns), "license-hits")
    per = matched(found, patterns).groupBy(*common.KEY).agg(
        F.collect_set(F.when(base, F.struct("label", "start"))).alias("places"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_set"),
        F.collect_set("label").alias("label_set"),
        F.max("share").alias("score"),
    )
    names = lambda c: F.array_join(F.array_sort(c), ",")
    per = per.select(*common.KEY, F.size("places").cast("long").alias("n_base"), "first_word", "last_word", names("base_set").alias("base_labels"), names("label_set").alias("labels"), "score")
    return found.select("doc_id", "k1", "k2", "n_words").join(per, common.KEY, "left").drop(*common.KEY)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"), templates(spark))
    empty = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return out.select("doc_id", "n_words", *[F.coalesce(c, empty[c]).alias(c) if c in empty else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])
