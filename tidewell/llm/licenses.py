"""License scan by diagonal voting, in DataFrame functions only."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import joinable, let, own_names, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Template:
    """A notice, its label, and words that a match must hold, as they tell it from its relatives."""

    label: str
    text: str
    needs: str = ""

    def words(self) -> list[str]:
        return [w for w in re.split(_MARKS, self.text.translate(str.maketrans(_UPPER, _LOWER))) if w]

    def needed(self) -> list[int]:
        """Places in the template of the words that a match must hold."""
        return [i for i, w in enumerate(self.words()) if w in self.needs.split()]


# Customary notices and characteristic sentences of public licenses.
TEMPLATES = (
    Template("mit", "Released under the MIT License", "mit"),
    Template("mit", "Licensed under the MIT License", "mit"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    Template("apache", "Licensed under the Apache License", "apache"),
    Template("apache", "Released under the Apache License", "apache"),
    Template("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("bsd", "Licensed under the BSD License", "bsd"),
    Template("gpl", "Licensed under the GNU General Public License", "general public"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "general public"),
    Template("lgpl", "Licensed under the GNU Lesser General Public License", "lesser"),
    Template("agpl", "Licensed under the GNU Affero General Public License", "affero"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", "mozilla"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("cc-by-nc", "Licensed under CC BY-NC", "nc"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial License", "noncommercial"),
    Template("cc-by-sa", "Licensed under CC BY-SA", "sa"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike License", "sharealike"),
    Template("cc-by-nd", "Licensed under CC BY-ND", "nd"),
)

#: Words of a gram, share of a template's words that a span must hold (percent), words of the template for each word of drift.
GRAM, HOLDS, DRIFT = 3, 85, 5
#: Grams of all templates that are broadcast; more meet the texts in a shuffled join.
MOST = 1 << 17


def words(text: Column) -> Column:
    """Words of a text, A to Z lower-cased; none of null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _MARKS), lambda w: w != "")


def base_places(text: Column) -> Column:
    """struct<n_words, places array<struct<at, label>>>: where the words of a base phrase stand, in order."""

    def at(ws: Column):
        def phrase(w: Column, i: Column) -> Column:
            stands = lambda p: functools.reduce(lambda a, b: a & b, (F.get(ws, i + j) == x for j, x in enumerate(p) if j), w == p[0])
            found = F.when(F.lit(False), F.lit(""))
            for p, label in BASE:
                found = found.when(stands(p.split(" ")), F.lit(label))
            return F.struct(i.cast("long").alias("at"), found.alias("label"))

        return F.struct(F.size(ws).cast("long").alias("n_words"), F.filter(F.transform(ws, phrase), lambda x: x["label"].isNotNull()).alias("places"))

    return let(words(text), at)


def template_grams(spark: SparkSession, given: Sequence[Template], k: int) -> DataFrame:
    """A row for each k-gram of each template: h, its words, template number and place; broadcast up to MOST rows, some 100 bytes each."""
    rows = []
    for t, template in enumerate(given):
        ws = template.words()
        if len(ws) < k:
            raise ValueError(f"template {template.text!r} has fewer than {k} words")
        rows += [(" ".join(ws[i : i + k]), t, i) for i in range(len(ws) - k + 1)]
    grams = spark.createDataFrame(rows, "gram string, template int, place int")
    grams = grams.select(F.xxhash64(*(F.split("gram", " ")[j] for j in range(k))).alias("h"), "gram", "template", "place")
    return F.broadcast(grams) if len(rows) <= MOST else grams


def votes(docs: DataFrame, given: Sequence[Template], k: int = GRAM) -> DataFrame:
    """(id, digest, template, diagonal, places): for each text and template, the places of the text's grams that stand in the template, by offset.

    All rolling gram hashes of the texts are joined with the template's; grams of equal hash
    are compared word by word.  Places of one diagonal are at most as many as a template has
    grams, so no group grows with the table, and equal rows add nothing.
    """
    grams = template_grams(docs.sparkSession, given, k)
    rolling = let(F.col("ws"), lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: F.xxhash64(*(F.get(ws, i + j) for j in range(k)))))
    cut = docs.select("id", F.md5("text").alias("digest"), words(F.col("text")).alias("ws")).where(F.size("ws") >= k)
    own = cut.select("id", "digest", "ws", F.posexplode(rolling).alias("at", "h"))
    met = own.join(grams, "h").where(F.array_join(F.slice("ws", F.col("at") + 1, k), " ") == F.col("gram"))
    return met.groupBy("id", "digest", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("at").alias("places"))


def spans(voted: DataFrame, given: Sequence[Template], k: int = GRAM) -> DataFrame:
    """(id, digest, label, start, end, share): diagonals merged with their neighbours, then verified.

    Diagonals of a text and template that differ by at most a DRIFT-th of its words belong
    together, as words are added or left out within a notice.  A span holds if its grams cover
    HOLDS percent of the template's words and all that it needs, within half as many words
    again as the template has.
    """
    sizes = F.array(*(F.lit(len(t.words())) for t in given))
    needs = F.array(*(F.array(*map(F.lit, t.needed())).cast("array<int>") for t in given))
    labels = F.array(*(F.lit(t.label) for t in given))
    rows = voted.withColumn("n", F.get(sizes, F.col("template")))
    along = Window.partitionBy("id", "digest", "template").orderBy("diagonal")
    step = (F.col("diagonal") - F.lag("diagonal").over(along)) * DRIFT > F.col("n")
    rows = rows.withColumn("new", F.coalesce(step, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(along))
    taken = F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(p.alias("at"), (p - F.col("diagonal")).alias("place")))))
    merged = rows.groupBy("id", "digest", "template", "island", "n").agg(taken.alias("met"))
    covered = F.array_distinct(F.flatten(F.transform("met", lambda m: F.sequence(m["place"], m["place"] + k - 1))))
    ends = merged.select(
        "id", "digest", "template", "n", covered.alias("covered"),
        F.array_min(F.transform("met", lambda m: m["at"])).alias("start"), (F.array_max(F.transform("met", lambda m: m["at"])) + k).alias("end"),
    )
    holds = (100 * F.size("covered") >= HOLDS * F.col("n")) & (F.size(F.array_except(F.get(needs, F.col("template")), "covered")) == 0) & (2 * (F.col("end") - F.col("start")) <= 3 * F.col("n"))
    return ends.where(holds).select("id", "digest", F.get(labels, F.col("template")).alias("label"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (F.size("covered") / F.col("n")).alias("share"))


def scan(docs: DataFrame, id_col: str, text_col: str, given: Sequence[Template] = TEMPLATES, k: int = GRAM) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, spans, labels, score.

    `n_base` counts the places of base phrases, `first_word` and `last_word` are their smallest
    and largest start (null without any).  `spans` lists the verified places of templates as
    (label, start, end, share), in order; `labels` has theirs and the base ones; `score` is the
    largest share of a template that a span holds, 0 without any.

    Null texts count as empty and have no words.  Texts meet their spans by id and digest, so
    rows that repeat an id keep their own result and equal rows have equal ones; null ids are
    one id.  A text of any length is one row; its grams are exploded and never gathered.
    Extra columns are ignored; an empty table gives no rows.
    """
    mine = own_names(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    span = F.struct("start", "end", "label", "share")
    found = spans(votes(mine, given, k), given, k).groupBy(F.col("id").alias("other"), F.col("digest").alias("text_digest")).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    found = joinable(table(found, "spans"))
    rows = mine.select("id", F.md5("text").alias("digest"), base_places(F.col("text")).alias("b")).select("id", "digest", "b.*")
    rows = rows.join(found, rows["id"].eqNullSafe(found["other"]) & (rows["digest"] == found["text_digest"]), "left")
    own = F.transform("places", lambda p: p["label"])
    met = F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>"))
    starts = F.transform("places", lambda p: p["at"])
    return rows.select(
        "id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_sort(F.array_distinct(own)).alias("base_labels"), "spans", F.array_sort(F.array_distinct(F.concat(own, met))).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )
