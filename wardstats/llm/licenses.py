"""License scan by diagonal voting, in Spark expressions only.

Every rolling word k-gram of a text (three words; two for two-word phrases)
is joined to the positions at which templates hold it. A hit votes for the
offset diagonal (word in the text minus word in the template). Votes are
counted per (text, template, diagonal), neighbouring diagonals are merged (a
word put in or left out moves the rest by one) up to ``DRIFT`` on either side
of each, and a merged span is kept if it covers enough of the template.
Phrases and names must be covered whole on one diagonal; license notices to
``COVERAGE``. Notices share wordings: of those found at one place (middles at
most ``REACH`` words apart) the best covered stays, by share and then by
words, and ties stay together.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z as a-z.
The joined rows compare the words themselves, so a hit is never a hash
collision. Nulls, ties and edge cases: a null or empty text has no words and
the score 0; repeated rows and null ids give a row each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases whose places are counted (fixed values: phrase, label).
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: More names, found like phrases.
NAMES = (
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "bsl"),
    ("bsd license", "bsd"),
    ("isc license", "isc"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("creative commons attribution", "cc-by"),
    ("public domain dedication", "cc0"),
)
#: Openings of the usual notices, found by votes.
NOTICES = (
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Share of a notice's words that a merged span must cover.
COVERAGE = 0.7
#: A diagonal takes in others up to this far off, as a share of the notice's words.
DRIFT = 0.1
#: Notices whose middles are at most this many words apart compete.
REACH = 8
#: The drift in whole numbers.
STEP = 1_000_000

_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_grams(base=BASE, names=NAMES, notices=NOTICES) -> list[tuple]:
    """(template, label, kind, words in it, position, first, second and third
    word; the third is null in a two-word template)."""
    out = []
    for number, (text, label, kind) in enumerate([(t, x, k) for k, group in (("base", base), ("name", names), ("notice", notices)) for t, x in group]):
        w = text.split()
        k = min(3, len(w))
        for i in range(len(w) - k + 1):
            out.append((number, label, kind, len(w), i, w[i], w[i + 1], w[i + 2] if k == 3 else None))
    return out


def _lower(word: Column) -> Column:
    return F.translate(word, _UPPER, _LOWER)


def scan_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, names=NAMES,
               notices=NOTICES, coverage: float = COVERAGE, drift: float = DRIFT, reach: int = REACH) -> DataFrame:
    """One row per found span and one marker row (template null) per text:
    row (number of the text's row), doc_id, n_words, template, label, kind,
    first_word, last_word, score (share of the template's words)."""
    spark = docs.sparkSession
    templates = spark.createDataFrame(
        template_grams(base, names, notices),
        "template int, label string, kind string, size int, at int, a string, b string, c string")
    words = F.expr(rf"array_remove(split(t, '{_SEPARATOR}'), '')".replace("\\", "\\\\"))
    rows = (docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
            .select("row", "doc_id", words.alias("w")).select("row", "doc_id", "w", F.size("w").alias("n_words")))
    # the marker is place -1; place i has words i, i + 1 and i + 2
    shifted = [F.concat(F.array(F.lit(None).cast("string")), F.expr(x)) for x in ("w", "slice(w, 2, greatest(n_words - 1, 0))", "slice(w, 3, greatest(n_words - 2, 0))")]
    places = rows.select("row", "doc_id", "n_words", F.inline(F.arrays_zip(
        F.sequence(F.lit(-1), F.col("n_words") - 1).alias("i"), *[s.alias(x) for s, x in zip(shifted, ("x", "y", "z"))])))
    places = places.withColumn("key", F.when(F.col("y").isNotNull(), F.xxhash64(F.lower("x"), F.lower("y"))))
    hits = places.join(
        F.broadcast(templates.withColumn("key", F.xxhash64("a", "b"))),  # a fixed table of a few hundred rows
        "key", "left").where("i < 0 OR at IS NOT NULL").where(
        (F.col("i") < 0) | ((_lower(F.col("x")) == F.col("a")) & (_lower(F.col("y")) == F.col("b")) & (F.col("c").isNull() | (_lower(F.col("z")) == F.col("c")))))
    votes = (hits.withColumn("diagonal", F.col("i") - F.col("at"))
             .groupBy("row", "template", "diagonal")
             .agg(*[F.first(c).alias(c) for c in ("doc_id", "n_words", "label", "kind", "size")],
                  F.when(F.first("c").isNull(), 2).otherwise(3).alias("k"),
                  F.collect_set("at").alias("ats"), F.min("i").alias("i0"), F.max("i").alias("i1")))
    # each diagonal takes in those within the drift on both sides (none for phrases), so a
    # span is at most twice the drift longer than its template; orders are whole numbers
    # in which the drift is STEP, as a range frame takes one width for all templates
    gap = F.when(F.col("kind") == "notice", F.floor(F.col("size") * drift)).otherwise(0)
    at = F.col("diagonal").cast("long")
    order = F.when(gap > 0, F.floor(at * STEP / gap)).otherwise(at * (2 * STEP)).cast("long")
    near = Window.partitionBy("row", "template").orderBy("order").rangeBetween(-STEP, STEP)
    merged = votes.withColumn("order", order).select(
        "row", "template", "doc_id", "n_words", "label", "kind", "size", "k", "diagonal", F.flatten(F.collect_list("ats").over(near)).alias("ats"),
        F.min("i0").over(near).alias("i0"), F.max("i1").over(near).alias("i1"))
    covered = F.expr("size(array_distinct(flatten(transform(ats, x -> sequence(x, x + k - 1)))))")
    found = (merged.withColumn("covered", covered).withColumn("score", F.when(F.col("template").isNotNull(), F.col("covered") / F.col("size")))
             .where(F.col("template").isNull() | F.when(F.col("kind") == "notice", F.col("score") >= coverage).otherwise(F.col("score") == 1)))
    # of notices with their middles at one place the best covered stays, once
    found = found.withColumn("middle", F.floor((F.col("i0") + F.col("i1") + F.col("k")) / 2)).withColumn("worth", F.col("score") + F.col("covered") / 1e6)
    place = Window.partitionBy("row", "kind").orderBy("middle").rangeBetween(-reach, reach)
    notice = F.coalesce(F.col("kind") == "notice", F.lit(False))
    best = found.withColumn("best", F.max("worth").over(place)).where(~notice | (F.col("worth") == F.col("best")))
    last = F.lag("middle").over(Window.partitionBy("row", "template").orderBy("middle", "diagonal"))
    return (best.withColumn("last", last).where(~notice | F.col("last").isNull() | (F.col("middle") - F.col("last") > reach))
            .select("row", "doc_id", "n_words", "template", "label", "kind",
                    F.when(F.col("template").isNotNull(), F.col("i0")).alias("first_word"),
                    F.when(F.col("template").isNotNull(), F.col("i1") + F.col("k") - 1).alias("last_word"), "score"))


def scan(docs: DataFrame, **options) -> DataFrame:
    """One row per text: doc_id, n_words, n_base, first_word and last_word
    (smallest and largest start of a base phrase), base_labels, labels, score
    (best share of a template; 0 without a span)."""
    spans = scan_spans(docs, **options)
    is_base = F.col("kind") == "base"
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").cast("long").alias("n_words"),
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("first_word"))).cast("long").alias("last_word"),
        joined(F.when(is_base, F.col("label"))).alias("base_labels"), joined("label").alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score")).drop("row")
