"""License scans by a positional rare-token index, in DataFrame expressions only.

Every template is a short word sequence. Its rarest words (highest IDF over the
template collection) are kept with their positions. For each file the positions
of those words are looked up, each hit votes for the template start that it
implies, and a template is reported when enough IDF mass agrees on one start and
every mandatory phrase of the template stands in the text.

Null and empty texts have no words, no labels and score 0. Repeated rows give
repeated results. Other columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_map import make_room
from .common import ALNUM_RUN, ALNUM_WORD, ascii_lower, let, words_of

#: Phrases whose places are counted, with their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, wording as lower-cased words, mandatory phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        ("permission is hereby granted", "free of charge"),
    ),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ("in compliance with the license", "limitations under the license"),
    ),
    ("gpl", "licensed under the gnu general public license", ("general public license",)),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty",
        ("general public license", "redistribute it and or modify it"),
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ("redistributions of source code", "list of conditions"),
    ),
    (
        "bsd",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("endorse or promote products", "prior written permission"),
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("cc-by", "this work is licensed under a creative commons attribution license", ("creative commons attribution",)),
)
RARE_WORDS = 4
MIN_AGREEMENT = 0.5


def rare_index(templates=TEMPLATES, rare_words: int = RARE_WORDS) -> list[tuple[str, tuple[str, ...], list[tuple[str, int, float]]]]:
    """For each template: label, phrases, and its rarest words as (word, position, idf)."""
    split = [(label, text.split(), phrases) for label, text, phrases in templates]
    frequency: dict[str, int] = {}
    for _, words, _ in split:
        for word in set(words):
            frequency[word] = frequency.get(word, 0) + 1
    idf = {word: math.log((1 + len(split)) / n) for word, n in frequency.items()}
    index = []
    for label, words, phrases in split:
        ranked = sorted(set(words), key=lambda w: (-idf[w], words.index(w)))[:rare_words]
        index.append((label, phrases, [(w, words.index(w), round(idf[w], 6)) for w in ranked]))
    return index


def gate_words(index, phrases: list[str]) -> list[str]:
    """Words of which every file with a base phrase or all mandatory phrases of a template holds one, rare ones."""
    common = {"a", "an", "and", "any", "are", "be", "by", "for", "free", "in", "is", "it", "of", "or", "program", "software", "the", "this", "to", "use", "with", "without", "you", "general", "public", "source", "work"}
    pick = lambda words: max(words, key=lambda w: (w not in common, len(w), w))
    sets = [phrase.split() for phrase in phrases] + [" ".join(ps).split() for _, ps, _ in index]
    found: list[str] = []
    for words in sorted(sets, key=len):
        if not set(words) & set(found):
            found.append(pick(words))
    return sorted(found)


def _stands(norm: Column, phrase: str) -> Column:
    return norm.contains(f" {phrase} ")


def _starts(words: Column, phrase: str) -> Column:
    """Positions, from 0, at which the words of ``phrase`` stand one after another."""
    parts = phrase.split()

    def stands_at(words: Column, i: Column) -> Column:
        same = F.lit(True)
        for k, part in enumerate(parts):
            same = same & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return same

    return let(words, lambda ws: F.filter(F.transform(ws, lambda w, i: F.when(stands_at(ws, i), i)), lambda i: i.isNotNull()))


def scan_licenses(docs: DataFrame, text: str = "text", base=BASE_PHRASES, templates=TEMPLATES) -> DataFrame:
    """``docs`` with ls_* columns: n_words, starts (of base phrases), base_labels, labels, score."""
    docs = make_room(docs, ["ls_n_words", "ls_starts", "ls_base", "ls_labels", "ls_score"])
    index = rare_index(templates)
    lowered = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    # Any base phrase or template needs one of these words; texts without them stop here.
    needed = gate_words(index, [phrase for phrase, _ in base])
    longest = [w for w in needed if len(w) > 3]
    short = [w for w in needed if len(w) <= 3]
    gate = F.lit(False)
    for w in longest:
        gate = gate | F.col("ls_low").contains(w)
    if short:
        gate = gate | F.col("ls_low").rlike("(?<![0-9a-z\\x{80}-\\x{10FFFF}])(" + "|".join(short) + ")(?![0-9a-z\\x{80}-\\x{10FFFF}])")
    empty = F.array().cast("array<string>")
    out = docs.withColumn("ls_low", lowered)
    out = out.withColumn("ls_n_words", F.regexp_count("ls_low", F.lit(ALNUM_WORD)).cast("long"))
    out = out.withColumn("ls_words", F.when(gate, words_of(F.col("ls_low"), ALNUM_RUN)).otherwise(empty))
    out = out.withColumn("ls_norm", F.concat(F.lit(" "), F.array_join("ls_words", " "), F.lit(" ")))
    found = [F.when(_stands(F.col("ls_norm"), phrase), _starts(F.col("ls_words"), phrase)).otherwise(F.array().cast("array<int>")) for phrase, _ in base]
    out = out.withColumn("ls_starts", F.concat(*found))
    out = out.withColumn("ls_base", F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(_stands(F.col("ls_norm"), phrase), F.lit(label)) for phrase, label in base]), lambda x: x.isNotNull()))))
    rare = sorted({w for _, _, words in index for w, _, _ in words})
    hits = F.filter(F.transform("ls_words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(rare))
    out = out.withColumn("ls_hits", F.when(F.size("ls_words") > 0, hits))
    shares = []
    for label, phrases, words in index:
        total = sum(idf for _, _, idf in words)
        best = _best_start(F.filter(F.transform("ls_hits", _voter(words)), lambda v: v["s"].isNotNull()))
        ready = F.lit(True)
        for phrase in phrases:
            ready = ready & _stands(F.col("ls_norm"), phrase)
        share = F.least(F.lit(1.0), F.coalesce(F.when(ready, best), F.lit(0.0)) / total)
        shares.append(F.struct(F.lit(label).alias("label"), F.round(share, 6).alias("share")))
    out = out.withColumn("ls_shares", F.when(F.size("ls_words") > 0, F.array(*shares)))
    out = out.withColumn("ls_score", F.greatest(F.coalesce(F.array_max(F.transform("ls_shares", lambda x: x["share"])), F.lit(0.0)), F.when(F.size("ls_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0))))
    method = F.coalesce(F.transform(F.filter("ls_shares", lambda x: x["share"] >= MIN_AGREEMENT), lambda x: x["label"]), empty)
    out = out.withColumn("ls_labels", F.array_sort(F.array_distinct(F.concat("ls_base", method))))
    return out.drop("ls_low", "ls_words", "ls_norm", "ls_hits", "ls_shares")


def _best_start(votes: Column) -> Column:
    """Largest sum of weights on one start: the votes are sorted and folded once."""
    state = "struct<s:int,x:double,best:double>"
    zero = F.struct(F.lit(None).cast("int").alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("best")).cast(state)

    def fold(held: Column, vote: Column) -> Column:
        x = F.when(vote["s"].eqNullSafe(held["s"]), held["x"] + vote["x"]).otherwise(vote["x"])
        return F.struct(vote["s"].alias("s"), x.alias("x"), F.greatest(held["best"], x).alias("best")).cast(state)

    return F.aggregate(F.array_sort(votes), zero, fold, lambda held: held["best"])


def _voter(words: list[tuple[str, int, float]]):
    """Maps a hit to the start that it implies for a template, with the word's IDF."""

    def vote(hit: Column) -> Column:
        start, weight = F.lit(None).cast("int"), F.lit(None).cast("double")
        for word, position, idf in words:
            start = F.when(hit["w"] == word, hit["i"] - position).otherwise(start)
            weight = F.when(hit["w"] == word, F.lit(float(idf))).otherwise(weight)
        return F.struct(start.alias("s"), weight.alias("x"))

    return vote


def license_table(docs: DataFrame) -> DataFrame:
    """One row per document in the digest form."""
    out = scan_licenses(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("ls_n_words").alias("n_words"),
        F.size("ls_starts").cast("long").alias("n_base"),
        F.array_min("ls_starts").cast("long").alias("first_word"),
        F.array_max("ls_starts").cast("long").alias("last_word"),
        F.array_join("ls_base", ",").alias("base_labels"),
        F.array_join("ls_labels", ",").alias("labels"),
        F.col("ls_score").alias("score"),
    )
