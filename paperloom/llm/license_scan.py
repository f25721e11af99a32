"""License scan by an exact set-similarity join.

Documents are cut into blocks of words that overlap by half, so every stretch
of words as long as a template lies whole in one block. Blocks and templates
are sets of tokens in one order, that of rising document frequency over the
corpus. A block contains a template if it holds at least a given share of the
template's tokens. Three filters leave few blocks to be compared:

* prefix: a block that holds enough of a template holds one of the first tokens
  of the template's order, the rarest, so blocks meet templates in an equality
  join on those;
* length: the block has at least as many tokens as are needed;
* position: the tokens after the first common one, in both, have to suffice.

Only tokens of the templates take part, for no other can be common.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Table, ascii_lower, text_or_empty

LEAST_SHARE = 0.9
BLOCK_WORDS = 64

# The phrases of the base scan, and sentences of public licenses and their notices.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work to the extent possible under law"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

_PLACES = "array<struct<first:bigint,last:bigint,n:bigint,label:string>>"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of digits, letters and all that is beyond ASCII; A-Z in lower case."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(_WORD), F.lit(0))


def _listed(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def needed(size: int, least: float) -> int:
    """Tokens of a template that a block has to hold."""
    return max(1, math.ceil(size * least - 1e-9))


def _checked(templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], stride: int) -> list[tuple[str, frozenset[str]]]:
    for _, text in templates:
        if not 1 <= len(text.split()) <= stride + 1:
            raise ValueError(f"a template has 1 to {stride + 1} words: {text!r}")
    for _, text in phrases:
        words = text.split()
        if not words or any(words[:n] == words[-n:] for n in range(1, len(words))):
            raise ValueError(f"places of a phrase must not overlap: {text!r}")
    return [(label, frozenset(text.split())) for label, text in templates]


def _base(words: Column, phrases: Sequence[tuple[str, str]]) -> tuple[list[Column], Column]:
    """([places of each phrase, null if there are none], joined text)."""
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))

    def of(label: str, phrase: str) -> Column:
        t, length = F.col("_joined"), len(phrase.split())
        # the space before a place is cut away with it, the one after stays: it may open the next
        parts = F.split(t, f" {phrase}(?= )", -1)
        last = F.col("n_words") - (spaces(F.element_at(parts, -1)) - 1) - length
        place = F.struct(spaces(F.element_at(parts, 1)).cast("long").alias("first"), last.cast("long").alias("last"), (F.size(parts) - 1).cast("long").alias("n"), F.lit(label).alias("label"))
        return F.when(F.contains(t, F.lit(f" {phrase} ")), place)

    return [of(label, phrase) for label, phrase in phrases], joined


def _index(df: DataFrame, templates: list[tuple[str, frozenset[str]]], order: dict[str, int], least: float) -> DataFrame:
    """A row for each token of a template's prefix; no more than the templates have tokens."""
    rows = []
    for label, tokens in templates:
        ranked, need = sorted(tokens, key=order.__getitem__), needed(len(tokens), least)
        for i in range(len(ranked) - need + 1):
            rows.append(F.struct(F.lit(ranked[i]).alias("token"), F.lit(label).alias("label"), F.lit(i).alias("i"), F.lit(need).alias("need"), _listed(ranked[:i]).alias("before"), _listed(ranked).alias("template")))
    kind = "array<struct<token:string,label:string,i:int,need:int,before:array<string>,template:array<string>>>"
    return df.sparkSession.range(1).select(F.inline(F.array(*rows).cast(kind)))


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    least: float = LEAST_SHARE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_base, first_word,
    last_word, base_labels, labels, score.

    templates and phrases: (label, words in lower case). labels adds to the base
    labels those of templates of whose distinct words some block holds the share
    `least`; the words of one notice may hold another's, which is then found as
    well. score is 1 with a base phrase, else the highest share found, else 0.

    Null text counts as empty and gives no words, no labels and score 0. Repeated
    rows get equal rows. Whole texts of any length are cut into blocks. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    stride = block_words // 2
    sets = _checked(templates, phrases, stride)
    words = docs.select(words_of(text_or_empty(text_col)).alias("words"))
    vocabulary = sorted({t for _, tokens in sets for t in tokens})
    # document frequencies of the templates' tokens only: no more rows than those
    seen = words.select(F.explode(F.array_intersect(_listed(vocabulary), F.col("words"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["token"]: r["n"] for r in seen.collect()} if vocabulary else {}
    ranked = sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))
    order = {t: i for i, t in enumerate(ranked)}
    prefix = sorted({t for _, tokens in sets for t in sorted(tokens, key=order.__getitem__)[: len(tokens) - needed(len(tokens), least) + 1]}, key=order.__getitem__)
    shortest = min((needed(len(tokens), least) for _, tokens in sets), default=0)

    row = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), words_of(text_or_empty(text_col)).alias("words"))
    n = F.size("words")
    last = F.greatest(F.lit(0), F.ceil(n / stride).cast("int") - 2)
    block = lambda i: F.array_intersect(_listed(ranked), F.slice(F.col("words"), i * stride + 1, F.lit(block_words)))
    alike = lambda b: (F.size(b) >= shortest) & F.arrays_overlap(b, _listed(prefix))
    blocks = F.when(F.arrays_overlap("words", _listed(prefix)), F.filter(F.transform(F.sequence(F.lit(0), last), block), alike))
    places, joined = _base(F.col("words"), phrases)
    scanned = row.select("rid", "doc_id", n.cast("long").alias("n_words"), joined.alias("_joined"), blocks.alias("blocks"))
    scanned = scanned.select("rid", "doc_id", "n_words", F.array_compact(F.array(*places).cast(_PLACES)).alias("base"), F.coalesce("blocks", F.array()).alias("blocks"))
    scanned = Table(scanned, "scanned").df  # read twice below, with the same row numbers

    b, t = F.col("block"), F.col("template")
    met = scanned.filter(F.size("blocks") > 0).select("rid", F.explode("blocks").alias("block"))
    met = met.select("rid", "block", F.explode(F.array_intersect(_listed(prefix), b)).alias("token")).join(F.broadcast(_index(docs, sets, order, least)), "token")
    # one row for a block and a template: that of their first common token
    first = met.filter(~F.arrays_overlap("before", b))
    after = F.least(F.size(t) - F.col("i"), F.size(b) - F.array_position(b, F.col("token")).cast("int") + 1)
    able = first.filter((F.size(b) >= F.col("need")) & (after >= F.col("need")))
    held = able.select("rid", "label", "need", F.size(F.array_intersect(t, b)).alias("held"), F.size(t).alias("size")).filter("held >= need")
    found = held.groupBy("rid").agg(F.collect_set("label").alias("more"), F.max(F.col("held") / F.col("size")).alias("share"))

    base = F.transform("base", lambda x: x["label"])
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scanned.join(found, "rid", "left").select(
        F.col("doc_id").alias(id_col),
        "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["last"])).alias("last_word"),
        text(base).alias("base_labels"),
        text(F.concat(base, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
