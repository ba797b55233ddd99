"""License scans by diagonal voting, in DataFrame operations only.

Templates are licence phrases and notices, cut into rolling word pairs (``K`` words each). All rolling pairs of a text are
joined to the template positions on a hash, and on the pair itself. A hit at word i of the text and position p of the
template votes for the diagonal i - p. A diagonal that holds every pair of a template is a place where its words stand
consecutively. For notices, each diagonal is merged with its neighbours up to a shift that keeps the span within ``STRETCH``
times the template's length, so that inserted or dropped words do not break a passage; of diagonals that near each other the
one whose hits cover most pairs stands for the span, and counts if they cover ``COVER`` of them. So stray hits around a
passage cannot stretch it. Where spans of several notices share more than half of the shorter one, the best share counts.

Only the templates, a fixed list, are broadcast. A null text counts as empty; texts without words give no place, and still
a row. Rows are told apart by their place in the input, so repeated rows give the same result each. Ties of score do not
matter: only the best counts. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K, COVER, STRETCH = 2, 0.6, 1.5
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases and the labels they give.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Standard notices, as published with each licence.
NOTICES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
             "public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
               "license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the rights "
            "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met redistributions of source code must retain the above copyright notice this list of "
            "conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
            "distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
                  "compile sell or distribute this software"),
    ("reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
]


def templates(spark, phrases: dict[str, str], notices: list[tuple[str, str]]) -> DataFrame:
    """(template, label, phrase, pairs, pos, t_gram): a row for each rolling pair of each template; a bounded list."""
    rows = [(label, True, text) for text, label in phrases.items()] + [(label, False, text) for label, text in notices]
    if any(len(text.split()) < K for _, _, text in rows):
        raise ValueError(f"a template needs {K} words at least")
    positions = [(number, label, phrase, len(w) - K + 1, p, " ".join(w[p: p + K]))
                 for number, (label, phrase, text) in enumerate(rows) for w in [text.split()] for p in range(len(w) - K + 1)]
    return spark.createDataFrame(positions, "template int, label string, phrase boolean, pairs int, pos int, t_gram string")


def words(text: Column) -> Column:
    """Words of a text with A to Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _SMALL), F.lit(WORD), F.lit(0))


def spans(df: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """Spans of all templates, with the columns of ``df`` but the text: ``row`` (number of the input row), ``n_words``,
    ``template``, ``label``, ``phrase``, ``first_word`` and ``last_word`` (of the span, from 0), ``share`` (pairs of the template
    that were hit). A row whose ``template`` is null stands for the text itself, so that every text has one."""
    grams = F.transform("_words", lambda w, i: F.when(i < F.size("_words") - (K - 1), F.concat_ws(
        " ", w, *[F.get("_words", i + k) for k in range(1, K)])))
    kept = [F.col(f"`{c}`") for c in df.columns if c != text]
    rows = (df.select(F.struct(*kept, F.lit(0).alias("_")).alias("_kept"), words(F.col(text)).alias("_words"))
            .select(F.struct("_kept", F.size("_words").cast("long").alias("n_words")).alias("_row"), "_words")
            .withColumn("row", F.monotonically_increasing_id()))
    head = F.array(F.lit("").alias("g"))  # no pair is empty: this one carries the row itself
    places = rows.select("_row", "row", F.posexplode(F.concat(head, grams)).alias("i", "gram"))
    table = F.broadcast(templates(df.sparkSession, phrases, notices).withColumn("_h", F.xxhash64("t_gram")))
    hits = (places.withColumn("_g", F.xxhash64("gram"))
            .join(table, (F.col("_g") == F.col("_h")) & (F.col("gram") == F.col("t_gram")), "left")
            .where(F.col("template").isNotNull() | (F.col("i") == 0)))
    votes = (hits.withColumn("diagonal", F.when(F.col("template").isNotNull(), F.col("i") - 1 - F.col("pos")))
             .groupBy("row", "template", "label", "phrase", "pairs", "diagonal")
             .agg(F.max(F.when(F.col("i") == 0, F.col("_row"))).alias("_row"),
                  F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_set("pos").alias("at")))
    # One unit is the shift that a notice may have; the diagonals of a phrase are two units apart, so each is alone.
    shift = F.greatest(F.lit(1.0), F.floor((STRETCH - 1) * (F.col("pairs") + K - 1)).cast("double"))
    votes = votes.withColumn("_at", F.when(F.col("phrase"), F.col("diagonal") * 2.0).otherwise(F.col("diagonal") / shift))
    order = Window.partitionBy("row", "template").orderBy("_at")
    ahead, around = order.rangeBetween(0, 1), order.rangeBetween(-1, 1)
    spanned = votes.select(
        "*", F.size(F.array_distinct(F.flatten(F.collect_list("at").over(ahead)))).alias("hit"),
        F.min(F.col("diagonal") + F.col("low")).over(ahead).alias("first_word"),
        F.max(F.col("diagonal") + F.col("high") + K - 1).over(ahead).alias("last_word"))
    own = F.struct("hit", (-F.col("diagonal")).alias("d"))
    best = (spanned.withColumn("_best", F.max(own).over(around))
            .where(F.col("template").isNull() | (F.col("_best.d") == -F.col("diagonal")))
            .withColumns({"share": F.col("hit") / F.col("pairs"), "verified": F.when(
                F.col("phrase"), F.col("hit") == F.col("pairs")).otherwise(F.col("hit") >= COVER * F.col("pairs"))}))
    # Notices that claim the same words: spans near enough to overlap are few, since each has its own place.
    longest = int(STRETCH * max([len(t.split()) for _, t in notices], default=1)) + 1
    close = Window.partitionBy("row").orderBy("first_word").rangeBetween(-longest, longest)
    claims = F.collect_list(F.when(F.col("verified") & ~F.col("phrase"), F.struct(
        "first_word", "last_word", "share", "hit", (-F.col("template")).alias("t")))).over(close)

    def stronger(o: Column) -> Column:
        shared = F.least(o["last_word"], F.col("last_word")) - F.greatest(o["first_word"], F.col("first_word")) + 1
        shorter = F.least(o["last_word"] - o["first_word"], F.col("last_word") - F.col("first_word")) + 1
        rank = F.struct(F.col("share"), F.col("hit"), (-F.col("template")).alias("t"))
        return (o["t"] != -F.col("template")) & (2 * shared > shorter) & (F.struct(o["share"], o["hit"], o["t"]) > rank)

    claimed = F.col("verified") & (F.col("phrase") | ~F.exists("_claims", stronger))
    return best.withColumn("_claims", claims).select(
        "row", "_row", "template", "label", "phrase", "first_word", "last_word", "share", claimed.alias("verified"))


def scan(df: DataFrame, text: str = "text", **lists) -> DataFrame:
    """One row per document, without the text: ``n_words``, ``n_base`` (places of phrases), ``first_word`` and ``last_word``
    (smallest and largest start of these), ``base_labels`` (of the phrases), ``labels`` (of notices too), ``score`` (largest
    share of a template's pairs in one span). Columns of these names are replaced."""
    out = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    found = spans(df.drop(*out), text, **lists)
    base = F.col("verified") & F.col("phrase")
    per_row = found.groupBy("row").agg(
        F.max("_row").alias("_row"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("verified"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"))
    kept = [c for c in df.columns if c != text and c not in out]
    return per_row.select(*[F.col(f"_row._kept.`{c}`").alias(c) for c in kept], F.col("_row.n_words").alias("n_words"), *out[1:])
