"""Licence scan by diagonal voting, in DataFrame operations only.

Every word 2-gram of a document is hashed and joined to the positions at which
the same 2-gram stands in a licence template.  A match at document word ``p``
and template word ``t`` votes for diagonal ``p - t``.  Votes are summed per
diagonal, neighbouring diagonals of one template are merged (words inserted or
left out move a match to the next diagonal), and a merged span is verified:

* an *exact* template stands at a place when one diagonal holds all its grams,
  each compared as words and not only as hashes;
* a *loose* template is found when the merged span covers at least
  ``MIN_COVER`` of its grams within ``MAX_STRETCH`` times its length.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values: (label, exact phrase).  Templates are written as their words.
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
#: Fixed values: (label, opening words of a public licence notice).
LOOSE = (
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
)
MIN_COVER, MAX_STRETCH, NEAR = 0.75, 1.5, 2
#: What is not a word character after lower-casing.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates() -> list[tuple[str, bool, list[str]]]:
    return [(label, True, text.split()) for label, text in BASE] + [(label, False, text.split()) for label, text in LOOSE]


def gram_rows() -> list[tuple]:
    """(template, label, exact, grams, template word, first word, second word) of every template gram."""
    rows = []
    for k, (label, exact, words) in enumerate(templates()):
        if not 2 <= len(words) <= 64:
            raise ValueError("a template has 2 to 64 words: its grams are the bits of one long")
        rows += [(k, label, exact, len(words) - 1, t, a, b) for t, (a, b) in enumerate(zip(words, words[1:]))]
    return rows


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words, no places and score 0; repeated rows and
    null ids keep a row each, very long texts are scanned whole, and an empty table gives no rows.  Only ``id_col`` and ``text_col`` are
    read, so further columns of any name do no harm.  ``score`` is the largest
    share of a template's grams found together.  The broadcast side is the
    template table, whose size is fixed by this module.
    """
    spark = docs.sparkSession
    grams = spark.createDataFrame(gram_rows(), "t int, label string, exact boolean, grams int, at int, w0 string, w1 string")
    grams = F.broadcast(grams.withColumn("h", F.xxhash64("w0", "w1")))
    # A-Z only: lower() would make ASCII letters of a few others
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.array_remove(F.split(lower, GAP), "")
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), words.alias("ws"))
    pairs = F.arrays_zip(F.col("ws").alias("a"), F.slice("ws", F.lit(2), F.greatest(F.size("ws") - 1, F.lit(0))).alias("b"))
    rows = base.select("rid", "doc_id", F.size("ws").cast("long").alias("n_words"), F.posexplode_outer(pairs).alias("p", "g"))
    rows = rows.select("rid", "doc_id", "n_words", "p", F.col("g.a").alias("a"), F.col("g.b").alias("b"))
    hits = rows.join(grams, (F.xxhash64("a", "b") == F.col("h")) & (F.col("a") == F.col("w0")) & (F.col("b") == F.col("w1")), "left")
    hits = hits.where(F.col("t").isNotNull() | F.coalesce(F.col("p") == 0, F.lit(True)))
    doc = ["rid", "doc_id", "n_words"]
    votes = (
        hits.select(*doc, "t", "label", "exact", "grams", "at", (F.col("p") - F.col("at")).cast("long").alias("d"))
        .repartition("rid")
        .groupBy(*doc, "t", "label", "exact", "grams", F.when(F.col("t").isNotNull(), F.col("d")).alias("d"))
        .agg(F.expr("bit_or(shiftleft(1L, at))").alias("bits"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    )
    line = Window.partitionBy("rid", "t").orderBy("d")
    merged = votes.withColumn("new", F.when(F.col("d") - F.lag("d").over(line) <= NEAR, 0).otherwise(1))
    merged = merged.withColumn("span", F.sum("new").over(line))
    full = F.bit_count("bits") == F.col("grams")
    spans = merged.groupBy(*doc, "t", "label", "exact", "grams", "span").agg(
        F.count_if(full).alias("places"),
        F.min(F.when(full, F.col("d"))).alias("first"),
        F.max(F.when(full, F.col("d"))).alias("last"),
        F.expr("bit_or(bits)").alias("bits"),
        F.min(F.col("d") + F.col("lo")).alias("from"),
        F.max(F.col("d") + F.col("hi")).alias("to"),
    )
    cover = F.bit_count("bits") / F.col("grams")
    short = F.col("to") - F.col("from") + 1 <= MAX_STRETCH * F.col("grams")
    found = F.when(F.col("exact"), F.col("places") > 0).otherwise((cover >= MIN_COVER) & short)
    is_base = F.col("exact") & (F.col("places") > 0)
    labels = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("label")))), ",")
    return (
        spans.withColumns({"found": F.coalesce(found, F.lit(False)), "based": F.coalesce(is_base, F.lit(False)), "cover": F.when(F.col("exact"), F.when(F.col("places") > 0, 1.0)).otherwise(F.when(short, cover))})
        .groupBy(*doc)
        .agg(
            F.sum(F.when(F.col("based"), F.col("places")).otherwise(0)).cast("long").alias("n_base"),
            F.min(F.when(F.col("based"), F.col("first"))).alias("first_word"),
            F.max(F.when(F.col("based"), F.col("last"))).alias("last_word"),
            labels(F.col("based")).alias("base_labels"),
            labels(F.col("found")).alias("labels"),
            F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        )
        .drop("rid")
    )


def oracle() -> str:
    """The same result in DuckDB's SQL, with strings where the plan uses hashes."""
    values = ", ".join(f"({t}, '{label}', {exact}, {grams}, {at}, '{a}', '{b}')" for t, label, exact, grams, at, a, b in gram_rows())
    return f"""
    WITH tpl(t, label, exact, grams, tpos, w0, w1) AS (VALUES {values}),
    w AS (SELECT row_number() OVER () AS rid, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
    g AS (SELECT rid, i - 1 AS p, ws[i] AS a, ws[i + 1] AS b FROM (SELECT rid, ws, unnest(range(1, len(ws))) AS i FROM w)),
    v AS (SELECT rid, t, label, exact, grams, p - tpos AS d, bit_or(1::BIGINT << tpos) AS bits, min(tpos) AS lo, max(tpos) AS hi
          FROM g JOIN tpl ON a = w0 AND b = w1 GROUP BY ALL),
    n AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY rid, t ORDER BY d) <= {NEAR} THEN 0 ELSE 1 END AS fresh FROM v),
    m AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, t ORDER BY d) AS span FROM n),
    s AS (SELECT rid, t, label, exact, grams, span, count(*) FILTER (bit_count(bits) = grams) AS places,
                 min(d) FILTER (bit_count(bits) = grams) AS f, max(d) FILTER (bit_count(bits) = grams) AS l,
                 bit_or(bits) AS bits, min(d + lo) AS a, max(d + hi) AS z FROM m GROUP BY ALL),
    c AS (SELECT *, exact AND places > 0 AS based, z - a + 1 <= {MAX_STRETCH}::DOUBLE * grams AS short, bit_count(bits)::DOUBLE / grams AS cover FROM s),
    r AS (SELECT rid, coalesce(sum(places) FILTER (based), 0) AS n_base, min(f) FILTER (based) AS first_word, max(l) FILTER (based) AS last_word,
                 list_sort(list_distinct(list(label) FILTER (based))) AS bl,
                 list_sort(list_distinct(list(label) FILTER (CASE WHEN exact THEN places > 0 ELSE cover >= {MIN_COVER}::DOUBLE AND short END))) AS al,
                 max(CASE WHEN exact THEN CASE WHEN places > 0 THEN 1.0::DOUBLE END WHEN short THEN cover END) AS score FROM c GROUP BY rid)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
           coalesce(array_to_string(bl, ','), '') AS base_labels, coalesce(array_to_string(al, ','), '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
    FROM w LEFT JOIN r USING (rid)"""
