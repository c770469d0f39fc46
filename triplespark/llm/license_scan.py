"""Licence scans with a positional index of rare words.

Templates of licences and notices are indexed by their rarest words (highest inverse document
frequency among the templates) and where these stand. A text's occurrences of such words vote
for a template and the place where it would begin; of the places with enough votes those stay
at which the template's key phrases stand word for word. All of it is done within a row by
array functions; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: A word: digits, a-z after lower-casing A-Z, and everything beyond ASCII.
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Rare words indexed for each template, and the share of their weight that a place needs.
INDEXED = 6
ENOUGH = 0.6

#: Fixed phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Template:
    """A notice's words; `keys` are phrases of it that must stand where the notice has them."""

    label: str
    text: str
    keys: tuple[str, ...]


#: Opening words of common notices, as they are published (fixed values).
TEMPLATES = (
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software", "redistribute it and or modify it")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "without restriction")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("you may not use this file except in compliance with the license",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("unencumbered software released into the public domain",)),
    Template("cc-by-nc", "cc by nc", ("cc by nc",)),
    Template("cc-by-sa", "cc by sa", ("cc by sa",)),
    Template("cc-by-nd", "cc by nd", ("cc by nd",)),
    Template("cc-by", "creative commons attribution", ("creative commons attribution",)),
    Template("cc0", "creative commons zero", ("creative commons zero",)),
    Template("cc0", "cc0 1 0", ("cc0",)),
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)


@dataclass(frozen=True)
class Posting:
    template: int
    place: int
    weight: float


def _find(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase)


def index(templates: tuple[Template, ...]) -> tuple[dict[str, list[Posting]], list[float]]:
    """Postings of each template's rarest words by word, and the templates' weights in all."""
    texts = [t.text.split() for t in templates]
    idf = {w: math.log(1 + len(texts) / sum(w in t for t in texts)) for t in texts for w in t}
    postings: dict[str, list[Posting]] = {}
    weights = []
    for n, words in enumerate(texts):
        rare = sorted(dict.fromkeys(words), key=lambda w: (-idf[w], -len(w), w))[:INDEXED]
        found = [(w, Posting(n, i, idf[w])) for i, w in enumerate(words) if w in rare]
        weights.append(sum(p.weight for _, p in found))
        for w, p in found:
            postings.setdefault(w, []).append(p)
    return postings, weights


def license_scan(docs: DataFrame, text: str = "text", base: dict[str, str] = BASE, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base counts all places where a base phrase's words stand consecutively; first_word and
    last_word are the smallest and largest place (null if there is none). base_labels and
    labels (those and the templates found) are distinct, sorted and joined by commas; score is
    the share of the rare words' weight at the best place, 1 for a whole base phrase. Null and
    empty texts have no words, no label and score 0. Columns of `docs` named like the added
    ones are replaced; repeated rows are scanned each.
    """
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    docs = docs.drop(*[c for c in (*added, "_w", "_h", "_v", "_c", "_b", "_m") if c != text])
    every = tuple(Template(label, phrase, (phrase,)) for phrase, label in base.items()) + templates
    postings, weights = index(every)
    struct = lambda p, place: F.struct(F.lit(p.template).alias("t"), (place - p.place).alias("at"), F.lit(p.weight).alias("weight"))

    def votes(hit: Column) -> Column:
        out = F.array().cast("array<struct<t:int,at:int,weight:double>>")
        for word, own in postings.items():
            out = F.when(hit["w"] == word, F.array(*[struct(p, hit["i"]) for p in own])).otherwise(out)
        return out

    words = F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), NO_WORD, -1), "")
    rare = lambda w: w.isin(*postings)
    hits = F.filter(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: rare(h["w"]))
    none = F.array().cast("array<struct<w:string,i:int>>")
    # Equal votes lie together when sorted, each place at most as often as its template has postings; the last one gets the sum.
    ballots = F.sort_array(F.flatten(F.transform("_h", votes)))
    most = max((sum(p.template == n for own in postings.values() for p in own) for n in range(len(every))), default=1)
    same = lambda a, b: (a["t"] == b["t"]) & (a["at"] == b["at"])

    def total(v: Column, j: Column) -> Column:
        near = F.slice("_v", F.greatest(j + 2 - most, F.lit(1)), F.least(F.lit(most), j + 1))
        weight = F.aggregate(near, F.lit(0.0), lambda acc, x: acc + F.when(same(x, v), x["weight"]).otherwise(F.lit(0.0)))
        return F.struct(v["t"].alias("t"), v["at"].alias("at"), weight.alias("weight"), F.coalesce(same(F.get("_v", j + 1), v), F.lit(False)).alias("more"))

    summed = F.filter(F.transform("_v", total), lambda c: ~c["more"])

    def stands(c: Column) -> Column:
        """Whether the key phrases of the candidate's template stand where it has them."""
        out = F.lit(False)
        for n, t in enumerate(every):
            good = F.lit(True)
            for phrase in t.keys:
                p = phrase.split()
                start = _find(t.text.split(), p)
                for k, w in enumerate(p):
                    good = good & F.coalesce(F.get(F.col("_w"), c["at"] + start + k) == w, F.lit(False))
            out = F.when(c["t"] == n, good & (c["weight"] >= ENOUGH * weights[n])).otherwise(out)
        return out

    name = lambda c: F.get(F.array(*[F.lit(t.label) for t in every]), c["t"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, name))), ",")
    of = F.array(*[F.lit(w) for w in weights])
    out = docs.withColumn("_w", words)
    out = out.withColumn("_h", F.when(F.exists("_w", rare), hits).otherwise(none)).withColumn("_v", ballots).withColumn("_c", summed)
    out = out.withColumn("_m", F.filter("_c", stands)).withColumn("_b", F.filter("_m", lambda c: c["t"] < len(base)))
    return out.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.size("_b").cast("long").alias("n_base"),
        F.array_min(F.transform("_b", lambda c: c["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_b", lambda c: c["at"])).cast("long").alias("last_word"),
        joined("_b").alias("base_labels"),
        joined("_m").alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("_m", lambda c: c["weight"] / F.get(of, c["t"]))), F.lit(0.0))).alias("score"),
    )
