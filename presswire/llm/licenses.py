"""License notices in whole texts, by DataFrame functions alone.

Two things are looked for. Fixed phrases, as places where their words stand one after another. And notices like a template: an
exact set-similarity join of text blocks with templates on containment. Templates are few and fixed, so their side of the join
is a literal index in the plan:

- Tokens are ordered by how many documents have them, rarest first, counted over all documents.
- A block that holds at least ``need = ceil(threshold * n)`` of a template's n tokens holds one of its n - need + 1 rarest (prefix).
- It has ``need`` tokens or more itself (length), and where the first token shared is the template's i-th, at most n - i + 1 can be
  shared (position).
- What is left is verified on the whole sets.

A block is a line, or a sentence of it, or any stretch of words of the whole text, whatever lines and sentences it crosses, that is as
long as the template and as many words more as the template may lack. A stretch that holds enough also holds a word of the prefix, so
only those around such words are tried, and of them only those that begin with a word of the template. A null text is an empty one.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswire.llm.quality_rules import let

#: What parts words, whatever the case of A-Z.
_PARTS = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"

#: Phrases and their labels; fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Openings of public notices and the labels they stand for.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)
THRESHOLD = 0.9


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def spaced(text: Column) -> Column:
    """The words of a text in lower case, each with a space of its own on either side, so that a phrase never takes its neighbour's."""
    return F.lower(F.concat(F.lit("  "), F.trim(F.regexp_replace(text, _PARTS, "  ")), F.lit("  ")))


def _count(s: Column, part: str) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("long")


def _tokens(text: str) -> list[str]:
    return sorted(set(re.findall(r"[0-9a-z]+", text.lower())))


def token_counts(docs: DataFrame, tokens: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each of ``tokens`` stands, over all of them."""
    wanted = F.array(*map(F.lit, tokens))
    own = F.array_intersect(F.split(spaced(_text(text_col)), "  "), wanted)
    counts = docs.select(F.explode(own).alias("token")).groupBy("token").count().collect()
    return dict.fromkeys(tokens, 0) | {r["token"]: r["count"] for r in counts}


def _matches(block: Column, templates: list[dict], index: dict[str, list[int]]) -> Column:
    """(label, containment) of each template that the tokens of a block contain."""
    prefix = F.array(*map(F.lit, index))
    rows = F.array(*(F.struct(F.lit(t["label"]).alias("label"), F.lit(t["need"]).alias("need"), F.array(*map(F.lit, t["tokens"])).alias("tokens")) for t in templates))
    lists = F.create_map(*(x for k, v in index.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))

    def verify(i: Column) -> Column:
        t = F.element_at(rows, i + 1)
        first = F.array_position(F.transform(t["tokens"], lambda x: F.array_contains(block, x)), True)
        room = (F.size(block) >= t["need"]) & (F.size(t["tokens"]) - first + 1 >= t["need"])
        shared = F.when(room, F.size(F.array_intersect(t["tokens"], block))).otherwise(0)
        return F.struct(t["label"].alias("label"), F.when(shared >= t["need"], shared / F.size(t["tokens"])).alias("share"))

    def candidates(met: Column) -> Column:
        ids = F.array_distinct(F.flatten(F.transform(met, lambda x: F.element_at(lists, x))))
        return F.filter(F.transform(ids, verify), lambda m: m["share"].isNotNull())

    return let(F.array_intersect(block, prefix), candidates)


def _stretches(words: Column, templates: list[dict], index: dict[str, list[int]]) -> Column:
    """(label, containment) of each template that a stretch of the words of a text contains."""
    rows = F.array(*(F.struct(F.lit(t["label"]).alias("label"), F.lit(t["need"]).alias("need"), F.lit(t["room"]).alias("room"), F.array(*map(F.lit, t["tokens"])).alias("tokens")) for t in templates))
    lists = F.create_map(*(x for k, v in index.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))

    def verify(i: Column, t: Column) -> Column:
        start = F.greatest(i - t["room"] + 1, F.lit(0))
        holds = lambda part: F.size(F.array_intersect(t["tokens"], part))

        def most(around: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(1), i - start + 1), lambda k: F.array_contains(t["tokens"], F.element_at(around, k)))
            return F.when(holds(around) >= t["need"], F.array_max(F.transform(starts, lambda k: holds(F.slice(around, k, t["room"])))))

        found = let(F.slice(words, start + 1, i - start + t["room"]), most)
        return let(found, lambda n: F.struct(t["label"].alias("label"), F.when(n >= t["need"], n / F.size(t["tokens"])).alias("share")))

    met = F.array_compact(F.transform(words, lambda x, i: F.when(x.isin(*index), F.struct(x.alias("word"), i.alias("i")))))
    found = F.flatten(F.transform(met, lambda m: F.transform(F.element_at(lists, m["word"]), lambda k: let(F.element_at(rows, k + 1), lambda t: verify(m["i"], t)))))
    return F.filter(found, lambda m: m["share"].isNotNull())


def license_scan(docs: DataFrame, text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(row, n_words, places, matches) per row of ``docs``.

    ``row``: the row as a struct, so that no column can clash. ``places``: per phrase found (label, n, first, last), places counted in
    words from 0. ``matches``: the distinct (label, share) of blocks that hold at least ``threshold`` of a template. Both are empty for
    texts without words. With an empty table the result is empty.
    """
    sets = [(label, _tokens(t), len(re.findall(r"[0-9a-z]+", t.lower()))) for label, t in templates]
    counts = token_counts(docs, sorted({x for _, t, _ in sets for x in t}), text_col)
    built, index = [], {}
    for label, tokens, n in sets:
        tokens = sorted(tokens, key=lambda x: (counts[x], x))
        need = math.ceil(threshold * len(tokens) - 1e-9)
        for x in tokens[: len(tokens) - need + 1]:
            index.setdefault(x, []).append(len(built))
        built.append({"label": label, "tokens": tokens, "need": need, "room": n + len(tokens) - need})

    base = docs.select(F.struct("*").alias("row"), _text(text_col).alias("text"))
    base = base.select("row", "text", F.explode(F.array(spaced(F.col("text")))).alias("s"))
    n_words = F.when(F.length("s") > 4, (_count(F.col("s"), " ") / 2).cast("long") - 1).otherwise(0)

    def place(phrase: str, label: str) -> Column:
        size, part = len(phrase.split()), " " + phrase.replace(" ", "  ") + " "
        first = (_count(F.substring_index("s", part, 1), " ") - 1) / 2
        last = n_words - size - (_count(F.substring_index("s", part, -1), " ") - 1) / 2
        found = F.struct(F.lit(label).alias("label"), _count(F.col("s"), part).alias("n"), first.cast("long").alias("first"), last.cast("long").alias("last"))
        return F.when(F.col("s").contains(part), found)

    places = F.array_compact(F.array(*(place(p, label) for p, label in PHRASES.items())))
    some = F.exists(F.array(*(F.lit(f"  {x}  ") for x in index)), lambda x: F.col("s").contains(x))
    blocks = F.split("text", r"\n|(?<=[.;:!?])\x20")
    matched = F.flatten(F.transform(blocks, lambda b: let(F.array_distinct(F.array_remove(F.split(spaced(b), "  "), "")), lambda t: _matches(t, built, index))))
    across = let(F.array_remove(F.split("s", "  "), ""), lambda w: _stretches(w, built, index))
    matched = F.array_union(matched, across)
    none = F.array().cast("array<struct<label:string,share:double>>")
    return base.select("row", n_words.cast("long").alias("n_words"), places.alias("places"), F.when(some, matched).otherwise(none).alias("matches"))
