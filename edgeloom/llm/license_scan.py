"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words, floor(n / containment) of them for a template of n words; line
ends do not count, so notices may be wrapped. A template is found in a block that holds at least
``containment`` of its distinct words and all of its naming words, without which the rest is common
wording. The join is exact and uses DataFrame functions only:

- words are ordered by how often the corpus has them, rarest first, over all documents;
- prefix filter: a block with ``need`` of a template's n distinct words holds one of its n - need + 1
  rarest, so only places of these meet the templates, in an equi-join on the word;
- length filter: the words within a block's reach of the place hold ``need`` of the template's at all,
  and its naming words;
- positional filter: a place answers for the blocks whose rarest common word it is, so only words from
  there on in the order count, and ``need`` of them have to be in reach;
- the blocks around what passes are compared word by word.

Templates come from a parameter, so their table is small by construction and the only thing that is
broadcast. Texts are read twice, for the counts and for the phrases, and never shuffled; the words of
documents that hold a prefix word at all are checkpointed beside the phrases, at most once the input.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import cut, lower_ascii

CONTAINMENT = 0.8
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Opening sentences of the public license texts and their usual notices, each with its naming words.
TEMPLATES = (
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "obtaining associated"),
    ("apache-2", "licensed under the apache license version 2 0", "apache 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial license", "creative commons noncommercial"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general 3"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation", "gnu lesser"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary"),
    ("all-rights-reserved", "all rights reserved", "rights reserved"),
)


def _plain(text: Column) -> Column:
    """The words of a text, lower-cased (A-Z), one space between them."""
    return F.trim(F.regexp_replace(lower_ascii(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def phrase_places(docs: DataFrame, text_col: str = "text", phrases=PHRASES, plain_col: str = "plain") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, found (an array of base labels) and the plain words."""
    out = docs.withColumn("__plain", F.concat(F.lit(" "), _plain(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(" ")))
    plain = F.col("__plain")
    counts, firsts, lasts, found = [], [], [], []
    for phrase, label in phrases:
        has = F.contains(plain, F.lit(f" {phrase} "))
        counts.append(F.when(has, F.regexp_count(plain, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0).cast("long"))
        firsts.append(F.when(has, _spaces(F.substring(plain, F.lit(1), F.locate(f" {phrase} ", plain) - 1))))
        lasts.append(F.when(has, _spaces(F.regexp_extract(plain, f"(?s)^(.*) {phrase} ", 1))))
        found.append(F.when(has, F.lit(label)))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    pick = lambda f, xs: f(*xs) if len(xs) > 1 else xs[0]
    return out.withColumns(
        {
            "n_words": F.when(F.length(plain) > 2, _spaces(plain) - 1).otherwise(0).cast("long"),
            "n_base": total,
            "first_word": pick(F.least, firsts),
            "last_word": pick(F.greatest, lasts),
            "found": F.array_compact(F.array(*found)),
            plain_col: F.trim(plain),
        }
    ).drop("__plain")


def block_length(n_words: int, containment: float) -> int:
    """Words of a block that is compared with a template of so many words."""
    return max(n_words, int(n_words / containment + 1e-9))


def _template_index(docs: DataFrame, text_col: str, templates, containment: float) -> list[tuple]:
    """(word, label, own, needed, need, length): each prefix word with the template's words from it on, rarest first."""
    vocabulary = sorted({w for _, text, _ in templates for w in text.split()})
    words = docs.select(F.explode(F.split(_plain(F.col(text_col).cast("string")), " ")).alias("word"))
    counted = {r.word: r["count"] for r in words.where(F.col("word").isin(vocabulary)).groupBy("word").count().collect()}  # a row per word of the templates
    index = []
    for label, text, names in templates:
        own = sorted(set(text.split()), key=lambda w: (counted.get(w, 0), w))
        need = max(1, ceil(containment * len(own) - 1e-9))
        length = block_length(len(text.split()), containment)
        index += [(own[k], label, own[k:], names.split(), need, length, len(own)) for k in range(len(own) - need + 1)]
    return index


def template_matches(places: DataFrame, index: list[tuple]) -> DataFrame:
    """(row, label, score): the templates found around each place of rows(row, words), score being the share of their words."""
    wide = max(e[5] for e in index)
    table = places.sparkSession.createDataFrame(index, "word string, label string, own array<string>, names array<string>, need int, length int, size int")
    at = F.posexplode("words").alias("at", "word")
    met = places.select("row", "words", at).where(F.col("word").isin([e[0] for e in index]))
    first = F.greatest(F.lit(1), F.col("at") - wide + 2)
    met = met.select("row", "word", F.slice("words", first, F.lit(2 * wide - 1)).alias("near"), (F.col("at") + 2 - first).alias("here"))
    met = met.join(F.broadcast(table), "word")
    low = F.greatest(F.lit(1), F.col("here") - F.col("length") + 1)
    met = met.withColumn("near", F.slice("near", low, F.col("here") + F.col("length") - low))
    holds = lambda block: (F.size(F.array_intersect(block, F.col("own"))) >= F.col("need")) & (F.size(F.array_except("names", block)) == 0)
    met = met.where(holds(F.col("near")))
    blocks = F.transform(F.sequence(F.lit(1), F.size("near")), lambda i: F.slice("near", i, F.col("length")))
    common = F.array_max(F.transform(F.filter(blocks, holds), lambda block: F.size(F.array_intersect(block, F.col("own")))))
    return met.withColumn("common", common).where("common IS NOT NULL").select("row", "label", (F.col("common") / F.col("size")).alias("score"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document row: (id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    n_base counts all places where a phrase's words stand consecutively, first_word and last_word are
    the smallest and largest word they start at (from 0; null without any). labels adds those of the
    templates found in any block; both lists are distinct, sorted and comma-joined. score is the largest
    share of a template found, 1 where a phrase stands, else 0. Null and empty texts have no words and
    no labels, long ones are looked at whole. Repeated rows are answered alike, rows that repeat an id
    each for itself, null included. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    index = _template_index(rows, "text", templates, containment)
    words = F.split("plain", " ")
    some = F.coalesce(F.arrays_overlap(words, F.array(*[F.lit(w) for w in sorted({e[0] for e in index})])), F.lit(False))
    base = phrase_places(rows, "text", phrases).withColumn("some", some)
    # a row without any prefix word joins with nothing; its key is a number of its own, so that no value gathers such rows
    key = F.when(F.col("some"), F.xxhash64("text")).otherwise(F.monotonically_increasing_id())
    base = cut(base.withColumns({"key": key, "plain": F.when(F.col("some"), F.col("plain"))}).drop("text"))
    more = template_matches(base.where("some").select(F.struct("id", F.col("key").alias("h")).alias("row"), words.alias("words")), index)
    more = cut(more.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("most")))
    more = more.select(F.col("row.id").alias("other"), F.col("row.h").alias("key"), F.lit(True).alias("some"), "more", "most")
    base = base.drop("plain")
    both = base.join(more, (base["key"] == more["key"]) & (base["some"] == more["some"]) & base["id"].eqNullSafe(more["other"]), "left")
    every = F.array_sort(F.array_distinct(F.concat("found", F.coalesce("more", F.array().cast("array<string>")))))
    return both.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.greatest(F.coalesce("most", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )
