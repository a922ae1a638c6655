"""License scan by diagonal voting, with DataFrame operations only.

Every rolling word pair of every text is hashed and joined to the places of that pair in the
templates (a fixed table of a few hundred rows). A match votes for the diagonal ``place in the text
- place in the template``; one diagonal is one way of laying the template over the text. Votes are
gathered by (text, template, diagonal) as the set of template places that voted, diagonals that lie at most ``slack`` apart (words put in or
left out) are merged, and a merged span is verified: of the template's pairs at least
``coverage`` must be there (a place that votes on several diagonals counts once), inside a span not much longer than the template. On a single diagonal all votes
mean that all words stand there consecutively, as 64-bit hashes of pairs agree.

A scan and two sums move counts only; texts are never shuffled. The sums are keyed by the row, so a
phrase in a third of all texts makes no hot key, and a text that repeats one is summed before the shuffle.

Null or empty text: no words, no labels (the empty string), score 0. Very long texts become many narrow rows, not a large one.
Spans of one template that touch are merged into one. Repeated rows are separate rows; an empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The phrases of the base, each with its label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Opening words of public licence notices, each with its label.
TEMPLATES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
]

SEPARATE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def patterns() -> list[tuple[int, bool, str, list[str]]]:
    """(number, base or not, label, words) of all phrases and templates."""
    out = [(True, label, phrase) for phrase, label in BASE.items()] + [(False, *t) for t in TEMPLATES]
    return [(i, base, label, text.split()) for i, (base, label, text) in enumerate(out)]


def template_pairs(spark: SparkSession) -> DataFrame:
    """Pairs of the templates, fewer than 64 each, so that a set of their places is one long."""
    rows = [(i, base, label, len(w) - 1, at, w[at], w[at + 1]) for i, base, label, w in patterns() for at in range(len(w) - 1)]
    d = spark.createDataFrame(rows, "template int, base boolean, label string, pairs int, at int, first string, second string")
    return d.select("template", "base", "label", "pairs", "at", F.xxhash64("first", "second").alias("pair"))


def license_scan(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", slack: int = 2, coverage: float = 0.8) -> DataFrame:
    """Of each row: key, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``,
    ``score`` (the best coverage of a verified span, else 0) and ``spans``: of each verified span its label,
    first and last word, and coverage."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"),
                    F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER).alias("t"))
    d = d.select("row", "k", F.expr(f"filter(split(t, r'{SEPARATE}'), w -> w <> '')").alias("words"))
    # words is read three times, so the optimiser doesn't put the split into the lambda
    d = d.select("row", "k", F.size("words").alias("n_words"), F.expr(
        "case when size(words) < 2 then array() else transform(sequence(0, size(words) - 2), i -> xxhash64(words[i], words[i + 1])) end").alias("hashes"))
    d = d.select("row", "k", "n_words", F.posexplode_outer("hashes").alias("place", "pair"))
    hits = d.join(F.broadcast(template_pairs(spark)), "pair", "left")  # a fixed table
    hits = hits.withColumn("diagonal", F.col("place") - F.col("at"))
    # rows of a text without a match all fall on the one null diagonal, already before the shuffle
    votes = hits.groupBy("row", "k", "n_words", "template", "base", "label", "pairs", "diagonal").agg(
        F.expr("bit_or(shiftleft(1L, at))").alias("places"), F.min(F.when(F.col("at").isNotNull(), F.col("place"))).alias("first"),
        F.max(F.when(F.col("at").isNotNull(), F.col("place") + 1)).alias("last"))
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > slack
    votes = votes.withColumn("apart", F.when(F.col("base") | far, 1).otherwise(0))
    votes = votes.withColumn("band", F.sum("apart").over(by_diagonal))
    spans = votes.groupBy("row", "k", "n_words", "template", "base", "label", "pairs", "band").agg(
        F.bit_count(F.bit_or("places")).alias("found"), F.min("first").alias("first"), F.max("last").alias("last"))
    spans = spans.withColumn("part", F.col("found") / F.col("pairs"))
    verified = (F.when(F.col("base"), F.col("found") == F.col("pairs"))
                .otherwise((F.col("part") >= coverage) & (F.col("last") - F.col("first") <= F.col("pairs") + F.greatest(F.lit(slack), (F.col("pairs") / 4).cast("int")))))
    spans = spans.withColumn("ok", F.coalesce(verified, F.lit(False)))
    base = F.col("ok") & F.col("base")
    span = F.struct("label", "first", "last", "part")
    out = spans.groupBy("row", "k", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_labels"), F.collect_set(F.when(F.col("ok"), F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("ok"), F.col("part"))), F.lit(0.0)).alias("score"), F.collect_list(F.when(F.col("ok"), span)).alias("spans"))
    joined = [F.array_join(F.array_sort(c), ",").alias(c) for c in ("base_labels", "labels")]
    return out.select(F.col("k").alias(key), F.col("n_words").cast("long").alias("n_words"), "n_base", F.col("first_word").cast("long").alias("first_word"),
                      F.col("last_word").cast("long").alias("last_word"), *joined, "score", F.array_sort("spans").alias("spans"))


def oracle_sql(slack: int = 2, coverage: float = 0.8) -> str:
    """The same in DuckDB's SQL, with the words themselves in place of hashes."""
    values = ", ".join(f"({i}, {base}, '{label}', {len(w) - 1}, {at}, '{w[at]}', '{w[at + 1]}')" for i, base, label, w in patterns() for at in range(len(w) - 1))
    return rf"""
    with tp(template, base, label, pairs, pos, a, b) as (values {values}),
    d as (select row_number() over () as r, doc_id,
          list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATE}'), lambda x: x <> '') as words from documents),
    g as (select r, i - 1 as place, words[i] as a, words[i + 1] as b from (select r, words, unnest(range(1, len(words))) as i from d)),
    v as (select r, template, base, label, pairs, place - pos as diagonal, bit_or(1::bigint << pos) as places, min(place) as first, max(place) + 1 as last
          from g join tp using (a, b) group by all),
    m as (select *, case when base or diagonal - lag(diagonal) over (partition by r, template order by diagonal) > {slack} then 1 else 0 end as apart from v),
    n as (select *, sum(apart) over (partition by r, template order by diagonal) as band from m),
    s as (select r, template, base, label, pairs, band, bit_count(bit_or(places)) as found, min(first) as first, max(last) as last from n group by r, template, base, label, pairs, band),
    o as (select *, found::double / pairs as part, case when base then found = pairs
          else found::double / pairs >= {coverage} and last - first <= pairs + greatest({slack}, pairs // 4) end as ok from s),
    x as (select r, count(*) filter (where base) as n_base, min(first) filter (where base) as first_word, max(first) filter (where base) as last_word,
          string_agg(distinct label, ',' order by label) filter (where base) as base_labels, string_agg(distinct label, ',' order by label) as labels,
          max(part) as score from o where ok group by r)
    select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
      coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score from d left join x using (r)"""
