"""License scans: exact set-similarity join of text blocks with license templates.

The tokens of all templates are ordered by their document frequency over the whole corpus, rarest
first. A block that holds at least ``alpha = ceil(threshold * |T|)`` of a template's tokens must hold
one of the template's first ``|T| - alpha + 1``; blocks and templates meet on those prefix tokens, the
length and positional filters drop what can no longer reach ``alpha``, the rest is counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.tables import joined, only
from packetloom.session import materialise

# Phrases and labels of the base scan.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices of well-known licenses, one block each.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD_PERCENT = 90


def template_tokens(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    import re

    return [(label, sorted({w for w in re.split(GAP, text.lower()) if w})) for label, text in templates]


def lowered(text: Column) -> Column:
    """A-Z in lower case. Two capitals beyond ASCII would turn into ASCII letters: they are replaced
    by others that stay word characters."""
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å")), F.lit("İ"), F.lit("ı"))
    return F.lower(safe)


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    index = F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0)))
    return F.filter(index, lambda i: _all([F.get(words, i + k) == w for k, w in enumerate(parts)]))


def _all(conditions: list[Column]) -> Column:
    met = F.lit(True)
    for c in conditions:
        met = met & F.coalesce(c, F.lit(False))
    return met


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = tuple(TEMPLATES), percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text); columns as in the query.

    Blocks are the lines of a text and, where it has blank lines, the paragraphs between them. score is
    the largest share of a template found in one block that reaches the threshold, 1 where a base phrase
    stands, else 0. Null and empty texts have no words and no labels; repeated rows are scanned each;
    a null doc_id is kept; extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = only(docs, "doc_id", "text").withColumn("words", F.split(lowered(F.col("text")), GAP))
    tokens = template_tokens(list(templates))
    universe = sorted({w for _, ws in tokens for w in ws})
    array = lambda items: F.array(*[F.lit(x) for x in items])
    # document frequency of the template tokens: as many rows as the templates have tokens
    seen = rows.select(F.explode(F.array_intersect("words", array(universe))).alias("token")).groupBy("token").count()
    frequency = {r["token"]: r["count"] for r in seen.collect()}
    rank = {w: i for i, w in enumerate(sorted(universe, key=lambda w: (frequency.get(w, 0), w)))}

    index = []
    for number, (label, words) in enumerate(tokens):
        ordered = sorted(rank[w] for w in words)
        need = -(-percent * len(ordered) // 100)
        for at, r in enumerate(ordered[:len(ordered) - need + 1]):
            index.append((number, label, r, at, len(ordered), need, ordered))
    index_df = spark.createDataFrame(index, "template int, label string, rank int, t_at int, t_size int, need int, t_ranks array<int>")
    prefix = sorted({universe_word for universe_word, r in rank.items() if r in {x[2] for x in index}})

    bases = sorted({p.split()[-1] for p in PHRASES})
    n_words = F.size("words") - (F.element_at("words", 1) == "").cast("int") - ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")
    told = F.arrays_overlap("words", array(sorted({*prefix, *bases})))
    held = materialise(rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", n_words.cast("long").alias("n_words"), F.when(told, F.col("text")).alias("text")), "license-rows")

    some = held.where("text is not null").withColumn("low", lowered(F.col("text")))
    some = some.withColumn("words", F.filter(F.split("low", GAP), lambda w: w != ""))
    for k, phrase in enumerate(PHRASES):
        some = some.withColumn(f"p{k}", _places(F.col("words"), phrase))
    places = F.concat(*[f"p{k}" for k in range(len(PHRASES))])
    base = some.select("row", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
                       F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())])).alias("base"))

    blank = r"\n[\x09-\x0D\x20]*\n"
    paragraphs = F.when(F.col("low").rlike(blank), F.split("low", blank)).otherwise(F.array().cast("array<string>"))
    blocks = some.select("row", F.posexplode(F.concat(F.split("low", "\n"), paragraphs)).alias("block", "part"))
    ranks = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))])
    found = F.array_intersect(F.split("part", GAP), array(universe))
    blocks = blocks.select("row", "block", found.alias("found")).where(F.size("found") > 0).select(
        "row", "block", F.sort_array(F.transform("found", lambda w: F.element_at(ranks, w))).alias("ranks"))
    met = blocks.select("row", "block", "ranks", F.posexplode("ranks").alias("b_at", "rank")).join(F.broadcast(index_df), "rank")
    room = F.least(F.size("ranks") - F.col("b_at"), F.col("t_size") - F.col("t_at"))
    first = met.where(F.size("ranks") >= F.col("need")).groupBy("row", "block", "template").agg(
        F.min_by(F.struct("label", "ranks", "t_ranks", "t_size", "need", room.alias("room")), "t_at").alias("m")).select("row", "m.*")
    first = first.where("room >= need").withColumn("both", F.size(F.array_intersect("ranks", "t_ranks"))).where("both >= need")
    hits = first.groupBy("row").agg(F.collect_set("label").alias("more"), F.max(F.col("both") / F.col("t_size")).alias("share"))

    none = F.array().cast("array<string>")
    done = held.join(base, "row", "left").join(hits, "row", "left")
    n_base = F.coalesce("n_base", F.lit(0).cast("long"))
    own, more = F.coalesce("base", none), F.coalesce("more", none)
    return done.select(
        "doc_id", "n_words", n_base.alias("n_base"), "first_word", "last_word", joined(F.sort_array(own)).alias("base_labels"),
        joined(F.sort_array(F.array_union(own, more))).alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(n_base > 0, 1.0).otherwise(0.0)).alias("score"))


def oracle_sql(templates: list[tuple[str, str]] = tuple(TEMPLATES), percent: int = THRESHOLD_PERCENT) -> str:
    """The same result as DuckDB SQL, every block against every template."""
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    values = ", ".join(f"({k}, '{label}', '{w}', {len(ws)}, {-(-percent * len(ws) // 100)})" for k, (label, ws) in enumerate(template_tokens(list(templates))) for w in ws)
    starts = ", ".join(
        "list_filter(range(len(words)), lambda i: " + " AND ".join(f"words[i + {j + 1}] = '{w}'" for j, w in enumerate(p.split())) + f") AS p{k}"
        for k, p in enumerate(PHRASES))
    labels = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(PHRASES.values()))
    places = " || ".join(f"p{k}" for k in range(len(PHRASES)))
    return rf"""
WITH t(template, label, token, size, need) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT r, doc_id, low, list_filter(string_split_regex(low, '{gap}'), lambda x: x <> '') AS words FROM d),
p AS (SELECT r, doc_id, words, {starts} FROM w),
b AS (SELECT r, doc_id, len(words) AS n_words, {places} AS places, list_filter([{labels}], lambda x: x IS NOT NULL) AS base FROM p),
lines AS (SELECT r, unnest(string_split(low, chr(10)) || CASE WHEN regexp_matches(low, '\n[\x09-\x0D\x20]*\n') THEN string_split_regex(low, '\n[\x09-\x0D\x20]*\n') ELSE [] END) AS part FROM d),
k AS (SELECT row_number() OVER () AS block, r, part FROM lines),
e AS (SELECT DISTINCT r, block, unnest(string_split_regex(part, '{gap}')) AS token FROM k),
h AS (SELECT r, block, template, any_value(label) AS label, count(*) / any_value(size) AS share FROM e JOIN t USING (token) GROUP BY r, block, template HAVING count(*) >= any_value(need)),
m AS (SELECT r, list(DISTINCT label) AS more, max(share) AS share FROM h GROUP BY r)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels,
  greatest(coalesce(share, 0.0), CASE WHEN len(places) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM b LEFT JOIN m USING (r)"""
