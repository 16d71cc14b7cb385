"""License scans: phrases where their words stand in a row, and an exact set-similarity join with license templates.

The join finds every block of text, a line or two neighbouring lines, that holds at least a share of a template's distinct
words; two lines count where neither does alone, as where a sentence is wrapped. Words are ordered
by their frequency in the whole corpus, rarest first; a block can only reach the threshold if it holds one of a
template's first |T| - need + 1 words (prefix filter), if it has `need` words at all (length filter), and if the words
left after the matched ones suffice (positional filter). Candidates are then verified on whole word sets.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochfold.llm import common as C

# Phrases and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Templates of the set-similarity join: label and text. At most 1,000, so they travel in the plan.
TEMPLATES = [
    ("agpl-3", "this program is licensed under the gnu affero general public license version 3"),
    ("apache-2", "licensed under the apache license version 2.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("proprietary", "all rights reserved no part may be reproduced without permission"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
]
CONTAINMENT = 0.8
MOST_TEMPLATES = 1000


def _spaced(text: Column) -> Column:
    """Lower-cased words with one space before, between and after; a single space where there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), C.ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")), C.ALNUM_GAP, " ")


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()


def phrase_places(w: Column, phrase: str) -> Column:
    """Numbers of the words at which the phrase's words stand in a row; overlaps count. w: a column, not an expression."""
    own = phrase.split()
    here = lambda i: functools.reduce(operator.and_, [F.get(w, i + k) == x for k, x in enumerate(own)])
    return F.when(F.size(w) >= len(own), F.filter(F.sequence(F.lit(0), F.size(w) - len(own)), here))


def word_frequencies(words: DataFrame, column: str, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the vocabulary stands in the corpus; a row for each word, whatever the corpus."""
    hits = words.select(F.explode_outer(column).alias("w")).where(F.col("w").isin(vocabulary))
    return {r["w"]: r["count"] for r in hits.groupBy("w").count().collect()}


def order_templates(templates: list[tuple[str, str]], frequency: dict[str, int], share: float) -> list[tuple[str, list[str], int]]:
    """(label, distinct words, rarest in the corpus first, words needed) of each template."""
    out = []
    for label, text in templates:
        order = sorted(set(_words(text)), key=lambda w: (frequency.get(w, 0), w))
        out.append((label, order, math.ceil(share * len(order) - 1e-9)))
    return out


def _hits(lines: Column, template: int, label: str, order: list[str], need: int) -> Column:
    """The blocks that hold at least `need` of a template's words, by its prefix, length and positional filters."""
    whole = F.array(*[F.lit(w) for w in order])

    def candidate(s: Column) -> Column:
        # the first of the template's words, rarest first, that the line has: those from there on must suffice
        first = F.array_position(F.transform(whole, lambda w: F.array_contains(s["words"], w)), True)
        return (F.size(s["words"]) >= need) & (first > 0) & (len(order) - first + 1 >= need)

    def verified(s: Column) -> Column:
        return F.struct(s["line"].alias("line"), s["n_lines"].alias("n_lines"), F.lit(template).alias("template"), F.lit(label).alias("label"), (F.size(F.array_intersect(whole, s["words"])) / len(order)).alias("containment"))

    prefix = F.array(*[F.lit(w) for w in order[: len(order) - need + 1]])
    cand = F.filter(lines, lambda s: F.arrays_overlap(s["words"], prefix))
    return F.filter(F.transform(F.filter(cand, candidate), verified), lambda h: h["containment"] * len(order) >= need - 1e-6)


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, share: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    blocks lists the lines, and pairs of lines, that hold a template (line from 0, n_lines, template, label, containment); score is the largest
    containment, and 1 where a phrase stands. Work is by row: no row is shuffled, so copies and hot words cost nothing.

    Defined cases: a null or empty text has no words, no places and score 0; repeated rows and null ids get a row each;
    an empty table gives an empty result; other columns of docs are not read.
    """
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates; split the list")
    vocabulary = sorted({w for _, t in templates for w in _words(t)})
    spaced = docs.select(F.col(id_col), F.col(text_col).alias("_text"), _spaced(F.col(text_col)).alias("_t"))
    frequency = word_frequencies(spaced.select(F.split("_t", " ").alias("_w")), "_w", vocabulary)
    ordered = order_templates(templates, frequency, share)
    rare = F.array(*[F.lit(w) for w in sorted({w for _, order, need in ordered for w in order[: len(order) - need + 1]})])

    # each step in a projection of its own, so that nothing is worked out twice
    t = spaced.select(id_col, "_text", F.split(F.trim("_t"), " ").alias("_w"), *[F.contains(F.col("_t"), F.lit(f" {p} ")).alias(f"_has{k}") for k, (p, _) in enumerate(phrases)])
    none = F.array().cast("array<int>")
    places = F.array_sort(F.flatten(F.array(*[F.when(F.col(f"_has{k}"), F.coalesce(phrase_places(F.col("_w"), p), none)).otherwise(none) for k, (p, _) in enumerate(phrases)])))
    own = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.col(f"_has{k}"), F.lit(label)) for k, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull())))
    n_words = F.when((F.size("_w") == 1) & (F.get("_w", F.lit(0)) == ""), 0).otherwise(F.size("_w"))
    t = t.select(id_col, "_text", n_words.cast("long").alias("n_words"), places.alias("_places"), own.alias("_own"), F.arrays_overlap("_w", rare).alias("_maybe"))

    def of_line(line: Column) -> Column:
        return F.array_distinct(F.split(F.trim(_spaced(line)), " "))

    single = F.transform(F.split("_text", "\n"), lambda x, i: F.struct(i.alias("line"), F.lit(1).alias("n_lines"), of_line(x).alias("words")))
    t = t.withColumn("_single", F.when(F.col("_maybe"), single))
    double = F.transform(F.slice("_single", F.lit(1), F.greatest(F.size("_single") - 1, F.lit(0))), lambda s, i: F.struct(i.alias("line"), F.lit(2).alias("n_lines"), F.array_distinct(F.concat(s["words"], F.get("_single", i + 1)["words"])).alias("words")))
    with_rare = lambda blocks: F.filter(blocks, lambda s: F.arrays_overlap(s["words"], rare))
    t = t.withColumn("_lines", F.concat(with_rare(F.col("_single")), with_rare(double)))
    # lines meet templates inside their row, so no row leaves its place
    found = F.flatten(F.array(*[_hits(F.col("_lines"), k, label, order, need) for k, (label, order, need) in enumerate(ordered)]))
    t = t.withColumn("_hits", F.coalesce(F.when(F.size("_lines") > 0, found), F.array().cast("array<struct<line:int,n_lines:int,template:int,label:string,containment:double>>")))
    alone = lambda h: F.exists("_hits", lambda o: (o["n_lines"] == 1) & (o["template"] == h["template"]) & ((o["line"] == h["line"]) | (o["line"] == h["line"] + 1)))
    t = t.withColumn("blocks", F.filter("_hits", lambda h: (h["n_lines"] == 1) | ~alone(h)))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    all_labels = F.array_sort(F.array_distinct(F.concat("_own", F.transform("blocks", lambda b: b["label"]))))
    return t.select(
        id_col, "n_words", F.size("_places").cast("long").alias("n_base"),
        F.when(F.size("_places") > 0, F.array_min("_places")).cast("long").alias("first_word"),
        F.when(F.size("_places") > 0, F.array_max("_places")).cast("long").alias("last_word"),
        F.array_join("_own", ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"),
        F.when(F.size("_own") > 0, F.lit(1.0)).otherwise(best).alias("score"), "blocks",
    )
