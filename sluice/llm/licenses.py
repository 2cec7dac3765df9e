r"""Licence detection by a positional rare-token index, with DataFrame functions only.

Templates are word sequences with a mandatory key phrase. A first pass counts
in how many documents each template word occurs; the rarest words of a template
(highest IDF) become its index words. A second pass looks those words up in
each file, turns every position into the place where the template would start,
intersects the places of the index words and verifies the key phrase there.
A place where all words of a template stand passes whatever the IDF values are,
so they decide the cost and not the result.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: What separates words, after lower-casing A-Z.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    phrase: str  # words with a space between them; all must stand consecutively
    base: bool = False


#: Fixed phrases of well-known licences; the three base ones come first.
TEMPLATES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("agpl", "gnu affero general public license"),
    Template("apache", "licensed under the apache license"),
    Template("apache", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms"),
    Template("cc-by", "creative commons attribution"),
    Template("cc0", "cc0 1 0 universal"),
    Template("gpl", "gnu general public license"),
    Template("isc", "permission to use copy modify and or distribute this software"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    Template("mpl", "mozilla public license"),
    Template("unlicense", "free and unencumbered software released into the public domain"),
)


def words_of(c: Column) -> Column:
    return F.array_remove(F.split(C.ascii_lower(c), SEPARATOR, -1), "")


def word_idf(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF over all rows of ``words`` (column ``words``) for a fixed vocabulary:
    at most one row per vocabulary word reaches the driver."""
    vocab = F.array(*[F.lit(w) for w in vocabulary])
    count = words.select(F.explode(F.array_intersect(vocab, F.col("words"))).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in count.collect()}
    n = max([1, *df.values()])
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) for w in vocabulary}


def _places(t: Template, idf: dict[str, float]) -> tuple[Column, set[str]]:
    """Starts of a template in ``words``, and the index words used."""
    words = t.phrase.split(" ")
    # the offset of a word's first occurrence in the template; the two rarest words that differ
    ranked = sorted(dict.fromkeys(words), key=lambda w: (-idf[w], words.index(w)))[:2]

    def starts(w: str) -> Column:
        at = words.index(w)
        return F.transform(F.filter("_rare", lambda x: x["w"] == w), lambda x: x["i"] - at)

    found = starts(ranked[0])
    if len(ranked) > 1:
        found = F.array_intersect(found, starts(ranked[1]))
    key = F.array(*[F.lit(w) for w in words])
    return F.filter(found, lambda p: (p >= 0) & (F.slice(F.col("words"), F.greatest(p, F.lit(0)) + 1, len(words)) == key)), set(ranked)


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``places``, and the digest columns.

    ``places`` lists (label, start, length, base) by start; ``n_base``,
    ``first_word``, ``last_word`` and ``base_labels`` describe the base
    templates, ``labels`` all. ``score`` is 1 - 1 / (1 + words covered), 0 without a
    place. Null texts count as empty: no words, no labels, score 0. Repeated
    rows and null ids are reported each; an empty table gives an empty result;
    other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(C.whole_text(text_col)).alias("words"))
    vocabulary = sorted({w for t in templates for w in t.phrase.split(" ")})
    idf = word_idf(rows, vocabulary)
    built = [_places(t, idf) for t in templates]
    rare = sorted(set().union(*[r for _, r in built]))
    listed = F.array(*[F.lit(w) for w in rare])
    hit = F.arrays_overlap(F.col("words"), listed)
    none = F.array().cast("array<struct<w:string,i:int>>")
    at = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(rare))
    rows = rows.select("doc_id", "words", F.size("words").cast("bigint").alias("n_words"), F.when(hit, at).otherwise(none).alias("_rare"))
    some = F.size("_rare") > 0
    nowhere = F.array().cast("array<int>")
    rows = rows.select("doc_id", "n_words", *[F.when(some, p).otherwise(nowhere).alias(f"_p{i}") for i, (p, _) in enumerate(built)])

    def placed(i: int, t: Template) -> Column:
        n = len(t.phrase.split(" "))
        return F.transform(f"_p{i}", lambda p: F.struct(p.cast("bigint").alias("start"), F.lit(n).alias("length"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base")))

    every = F.array_sort(F.concat(*[placed(i, t) for i, t in enumerate(templates)]))
    rows = rows.select("doc_id", "n_words", every.alias("places"))
    base = F.filter("places", lambda x: x["base"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    covered = F.aggregate("places", F.lit(0), lambda a, x: a + x["length"])
    starts = F.transform(base, lambda x: x["start"])
    return rows.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
        (F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + covered)).alias("score"), "places",
    )
