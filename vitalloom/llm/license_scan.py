"""Licence notices by a positional index of rare words.

Every licence template is a list of words with a mandatory key phrase. The words' document frequencies over the
whole corpus pick each template's rarest words. In a text, the places of those words minus their places in the
template must meet; the key phrase is then verified there, and the share of template words that stand at their place,
weighted by rarity, is the score. One row of input gives one row of output without any shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontamination import words

# Base phrases and their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
# Further notices: label, words of the notice, mandatory key phrase in it.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
)
#: Rare words of a template that are looked up and must meet.
RARE = 3


def templates() -> list[tuple[str, list[str], int, int, bool]]:
    """(label, words, start of the key phrase, end of the key phrase, is a base phrase)."""
    made = [(label, phrase.split(), 0, len(phrase.split()), True) for label, phrase in BASE]
    for label, notice, phrase in NOTICES:
        w, p = notice.split(), phrase.split()
        at = next(i for i in range(len(w)) if w[i:i + len(p)] == p)
        made.append((label, w, at, at + len(p), False))
    return made


def rarity(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every template word over all rows of ``docs``; as many numbers as there are words."""
    vocabulary = sorted({w for t in templates() for w in t[1]})
    held = F.array_intersect(words(F.col("text")), F.array(*[F.lit(w) for w in vocabulary]))
    found = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()
    counts = {r[0]: r[1] for r in found}
    total = docs.count()
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 1e-6 for w in vocabulary}


def _places(template: tuple, weights: dict[str, float]) -> Column:
    """Structs (start of the key phrase, score) wherever the template's key phrase stands."""
    _, tokens, first, last, _ = template
    key = tokens[first:last]
    rare = sorted(range(len(key)), key=lambda i: (-weights[key[i]], i))[:RARE]

    def starts(i: int) -> Column:
        here = F.filter("postings", lambda p: p["w"] == key[i])
        return F.transform(here, lambda p: p["i"] - i)

    met = starts(rare[0])
    for i in rare[1:]:
        met = F.array_intersect(met, starts(i))
    verified = F.filter(met, lambda s: (s >= 0) & (F.slice("w", s + 1, len(key)) == F.array(*[F.lit(x) for x in key])))
    total = sum(weights[t] for t in tokens)

    def score(s: Column) -> Column:
        parts = [F.when(F.coalesce(F.get(F.col("w"), s - first + k) == t, F.lit(False)), weights[t]).otherwise(0.0) for k, t in enumerate(tokens)]
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return F.least(F.lit(1.0), out / total)

    return F.transform(verified, lambda s: F.struct(s.alias("start"), score(s).alias("score")))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places) of every row of ``docs``.

    ``places`` lists label, start and score of each notice found. Null and empty texts have no words and no places;
    repeated rows and null ids are reported like any other; other columns are not read.
    """
    weights, made = rarity(docs), templates()
    known = sorted({t for x in made for t in x[1][x[2]:x[3]]})
    anchors = sorted({max(x[1][x[2]:x[3]], key=lambda t: weights[t]) for x in made})
    texts = docs.select("doc_id", words(F.col("text")).alias("w"))
    held = F.arrays_overlap("w", F.array(*[F.lit(a) for a in anchors]))
    posted = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda p: p["w"].isin(known))
    texts = texts.withColumn("postings", F.when(held, posted).otherwise(F.array().cast("array<struct<w:string,i:int>>")))

    def found_of(template: tuple) -> Column:
        return F.transform(_places(template, weights), lambda p: F.struct(
            F.lit(template[0]).alias("label"), F.lit(template[4]).alias("base"), p["start"].alias("start"), p["score"].alias("score")))

    found = F.concat(*[found_of(t) for t in made])
    nothing = F.array().cast("array<struct<label:string,base:boolean,start:int,score:double>>")
    out = texts.select("doc_id", F.size("w").cast("long").alias("n_words"), F.when(F.size("postings") > 0, found).otherwise(nothing).alias("places"))
    base = F.filter("places", lambda p: p["base"])

    def joined(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    starts = F.transform(base, lambda p: p["start"])
    return out.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
                      joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"),
                      F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"), "places")
