"""Licence scan: a trained paragraph classifier, a calibrated unknown class, and template comparison.

A paragraph is a line of a text. A sparse multinomial logistic regression over
word 1- to 3-grams names a licence family. It is trained on windows of the
templates (passages, and short notices made of every lead and every name of a
licence), bare and between words of document lines, against the lines of all
documents (class unknown). Its features are the n-grams of the
templates that hold a word which is rare in ordinary lines. A prediction stands
above a probability that is calibrated on held-out unknown lines. It is
confirmed by comparison with the templates of its family: the paragraph shares
at least ``SIMILARITY`` of the five-word shingles of the shorter of the two, or
holds at least that share of the weight of a short notice's words, where a word
weighs the more the rarer it is in ordinary lines.

N-grams outside the vocabulary have no weight, so a paragraph without any
n-gram that speaks for a family is unknown whatever else it holds. Only
paragraphs with the rarest word of such an n-gram are scored; no other can be
predicted. Everything runs as DataFrame expressions and Spark ML (JVM) stages;
training counts words and equal vectors of lines, no text is shuffled.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm.common import cut_lineage, table

# Opening passages by licence family: fixed values.
PASSAGES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ),
    "lgpl": (
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "proprietary": (
        "Copyright the authors. All rights reserved. Unauthorized copying of this file is strictly prohibited.",
    ),
}
# Names of the licences by family, in the forms in which notices give them: fixed values.
NAMES = {
    "apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license"),
    "mit": ("MIT License", "MIT", "terms of the MIT License"),
    "gpl": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3", "GPL-3.0", "GPL-3.0-or-later",
            "GPL-3.0-only", "GPLv3 or later"),
    "lgpl": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v2.1", "GNU LGPL version 3", "LGPLv3", "LGPL-3.0",
             "LGPL-2.1-or-later", "LGPLv3 or later"),
    "bsd": ("BSD License", "BSD 3-Clause License", "3-clause BSD license", "BSD-3-Clause", "BSD-2-Clause"),
    "mpl": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0"),
    "cc-by": ("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License",
                 "Creative Commons Attribution-ShareAlike 4.0"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License",
                 "Creative Commons Attribution-NonCommercial 4.0"),
    "cc0": ("CC0 1.0", "CC0-1.0", "CC0 1.0 Universal", "CC0"),
    "proprietary": ("All rights reserved.",),
}
# What stands in front of a name in a notice; the last group is for families without a licence to grant.
LEADS = ("", "Licensed under", "Licensed under the", "Released under the", "Distributed under the", "Available under", "Published under the",
         "This work is licensed under the", "SPDX-License-Identifier:", "License:")
CLAIMS = ("", "Copyright the authors.", "Copyright 2020 Example Ltd.")
FAMILIES = ("unknown", *NAMES)
SHINGLE = 5
SIMILARITY = 0.8
WINDOW, STEP = 12, 3  # words of a training window, and its advance
FAMILY_ROWS, UNKNOWN_WEIGHT = 300.0, 5.0  # weight of a family in the training, and of the unknown class in families
COPIES = 12, 3  # training rows of a window of a passage and of a short notice: bare, and between words of lines
SHORT = 12  # words of a short notice at most
HELD_OUT = 4  # every fourth training row calibrates
ACCEPT = 0.999  # share of held-out unknown lines that must stay unknown
RARE = 0.01  # an n-gram is a feature if one of its words is in at most this share of ordinary lines


def tokens(text: Column) -> Column:
    """Lower-case words and numbers; digits of a number become ``0`` so that versions compare equal."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), "[0-9]+", "0"), F.lit(r"[a-z0]+(?:[.+-][a-z0]+)*"), F.lit(0))


def runs(words: Column, k: int) -> Column:
    """All runs of k words as strings; empty if there are fewer words."""
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k),
                                                  lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]))
                  ).otherwise(F.array().cast("array<string>"))


def grams(words: Column) -> Column:
    return F.concat(*[runs(words, k) for k in (1, 2, 3)])


def shingles(words: Column) -> Column:
    """Distinct five-word runs; fewer words are one shingle of all of them, none is none."""
    short = F.when(F.size(words) > 0, F.array(F.concat_ws(" ", words))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(words) < SHINGLE, short).otherwise(F.array_distinct(runs(words, SHINGLE)))


def listed(words: list[str]) -> Column:
    """A literal array of strings without line ends."""
    return F.split(F.lit("\n".join(words)), "\n") if words else F.array().cast("array<string>")


def templates(spark: SparkSession) -> DataFrame:
    """(family, words, copies) of every passage and of every lead with every name."""
    rows = [(f, t, COPIES[0]) for f, ts in PASSAGES.items() for t in ts]
    rows += [(f, f"{lead} {name}", COPIES[1]) for f, names in NAMES.items() for name in names for lead in (CLAIMS if f == "proprietary" else LEADS)]
    table_ = F.from_json(F.lit(json.dumps([dict(zip(("family", "text", "copies"), r)) for r in rows])), "array<struct<family:string,text:string,copies:int>>")
    words = spark.range(1).select(F.explode(table_).alias("t")).select("t.family", tokens(F.col("t.text")).alias("words"), "t.copies")
    return words.groupBy("family", "words").agg(F.max("copies").alias("copies"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, words): the lines of every text; a null text has none."""
    return (docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
            .select("doc_id", "paragraph", tokens(F.col("line")).alias("words")))


def of_templates(parts: list[str]) -> Column:
    """``kept``: the words that templates hold, in order. Each word is looked up in a set that is made once, not once a line."""
    return F.filter("words", lambda w: w.isin(parts)).alias("kept")


def plain_lines(docs: DataFrame, known: list[str], parts: list[str]) -> DataFrame:
    """(words, kept): the lines of three words or more without three words in a row (``known``) of a template."""
    # the generators keep the words as one value; otherwise each use of them would cut the line again
    cut = lines(docs).select(F.explode(F.array("words")).alias("words")).where(F.size("words") > 2)
    cut = cut.select("words", F.explode(F.array(of_templates(parts))).alias("kept"))
    # three words in a row of a template are in a row in ``kept`` as well; only where that holds the whole line is compared
    near = F.exists(runs(F.col("kept"), 3), lambda g: g.isin(known))
    return cut.where(~(near & F.arrays_overlap(runs(F.col("words"), 3), listed(known))))


@dataclass
class Scanner:
    vectors: CountVectorizerModel
    model: LogisticRegressionModel
    threshold: float
    anchors: list[str]
    seen: dict[str, float]  # share of ordinary lines that hold a word of the templates


def train(docs: DataFrame) -> Scanner:
    """Fits and calibrates the classifier on the lines of all of ``docs``, in two passes; equal vectors are one weighted row."""
    spark = docs.sparkSession
    base = cut_lineage(templates(spark))
    known = [r[0] for r in base.select(F.explode(F.array_distinct(runs(F.col("words"), 3)))).distinct().collect()]
    vocabulary = [r[0] for r in base.select(F.explode(grams(F.col("words"))).alias("g")).distinct().orderBy("g").collect()]
    parts = sorted({w for g in vocabulary for w in g.split(" ")})
    plain = plain_lines(docs, known, parts)
    # first pass: lines per word of the templates, all lines, and 997 lines to stand around the templates
    number = F.pmod(F.xxhash64("words"), F.lit(997)).cast("string")
    facts = F.concat(F.transform(F.array_distinct("kept"), lambda w: F.struct(F.lit("word").alias("kind"), w.alias("key"), F.lit(None).cast("array<string>").alias("noise"))),
                     F.array(F.struct(F.lit("line").alias("kind"), number.alias("key"), F.slice("words", 1, 16).alias("noise"))))
    facts = cut_lineage(plain.select(F.explode(facts).alias("f")).groupBy("f.kind", "f.key").agg(F.count(F.lit(1)).alias("n"), F.min("f.noise").alias("noise")))
    counts = facts.where("kind = 'word'").collect()  # at most one row per word of the templates
    n_plain = facts.where("kind = 'line'").agg(F.sum("n")).first()[0] or 1
    seen = {r["key"]: r["n"] / n_plain for r in counts}
    features = [g for g in vocabulary if min(seen.get(w, 0.0) for w in g.split(" ")) <= RARE]
    windows = base.select("family", "copies", F.explode(F.concat(
        F.array("words"),
        F.when(F.size("words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - WINDOW + 1, F.lit(STEP)),
                                                     lambda s: F.slice("words", s, WINDOW))).otherwise(F.array().cast("array<array<string>>"))
    )).alias("words"))
    # every window bare, and between words of document lines (a paragraph may hold more than the notice)
    around = windows.select("family", "words", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    around = around.withColumn("i", F.pmod(F.xxhash64("family", "words", "copy"), F.lit(997)).cast("string"))
    noise = facts.where("kind = 'line'").select(F.col("key").alias("i"), "noise")
    mixed = (around.join(noise, "i", "left").select("family", F.when((F.col("copy") == 0) | F.col("noise").isNull(), F.col("words"))
             .otherwise(F.concat(F.slice("noise", 1, 8), "words", F.slice("noise", 9, 8))).alias("words")))
    label = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")).cast("double") - 1
    # second pass: the n-grams of a line that are features; a line without a rare word of the templates has none
    rare = sorted({w for g in features for w in g.split(" ") if seen.get(w, 0.0) <= RARE})
    told = F.when(F.exists("kept", lambda w: w.isin(rare)), F.array_sort(F.array_distinct(F.filter(grams(F.col("words")), lambda g: g.isin(features))))
                  ).otherwise(F.array().cast("array<string>"))
    rows = mixed.select(label.alias("label"), "words", of_templates(parts)).unionByName(plain.select(F.lit(0.0).alias("label"), "words", "kept"))
    rows = rows.select("label", told.alias("grams"), (F.pmod(F.xxhash64("words"), F.lit(HELD_OUT)) == 0).alias("held_out"))
    rows = cut_lineage(rows.groupBy("label", "grams", "held_out").agg(F.count(F.lit(1)).alias("n")))
    fit_rows = rows.where((F.col("label") > 0) | ~F.col("held_out"))
    # every family weighs the same, however many names it has, and the unknown class as much as five of them
    size = fit_rows.groupBy("label").agg(F.sum("n").alias("rows"))
    weight = F.when(F.col("label") > 0, 1.0).otherwise(UNKNOWN_WEIGHT) * FAMILY_ROWS * F.col("n") / F.col("rows")
    fit_rows = fit_rows.join(F.broadcast(size), "label").withColumn("weight", weight)  # one row per family
    vectors = CountVectorizerModel.from_vocabulary(features, "grams", "features", binary=True)
    # sorted, so that the sums of the fit do not depend on the layout of the documents
    fit_rows = vectors.transform(fit_rows).select("label", "features", "weight", "grams").repartition(4, "label", "grams").sortWithinPartitions("label", "grams")
    model = LogisticRegression(family="multinomial", regParam=2e-4, elasticNetParam=0.5, maxIter=25, standardization=False, weightCol="weight"
                               ).fit(fit_rows.select("label", "features", "weight"))
    scored = model.transform(vectors.transform(rows.where("held_out and label = 0")))
    best = F.array_max(F.slice(vector_to_array("probability"), 2, len(FAMILIES) - 1))
    calm = scored.agg(F.percentile(best, F.lit(ACCEPT), F.col("n"))).first()[0]
    threshold = min(max(0.5, float(calm) if calm is not None else 0.5), 0.9)

    return Scanner(vectors, model, threshold, anchor_words(features, model.coefficientMatrix.toArray(),
                                                           model.interceptVector.toArray(), threshold, seen), seen)


def anchor_words(vocabulary: list[str], weights: np.ndarray, intercepts: np.ndarray, threshold: float, seen: dict[str, float]) -> list[str]:
    """Words of which a paragraph must hold at least one to be named.

    A family wins over class 0 with probability ``threshold`` only if its
    n-grams gain more log odds than the intercepts take. The n-grams of least
    gain are left out while all of them together gain too little; a paragraph
    must hold one of the others, and so the rarest word of it.
    """
    gain = (weights[1:] - weights[0]).max(0)
    need = float(np.log(threshold / (1 - threshold)) + (intercepts[0] - intercepts[1:]).min())
    order = np.argsort(gain, kind="stable")
    total = np.cumsum(np.maximum(gain[order], 0))
    speaks = [vocabulary[j] for j, t in zip(order, total) if t >= need]
    return sorted({min(g.split(" "), key=lambda w: (seen.get(w, 0), w)) for g in speaks})


def word_weights(scanner: Scanner, words: list[str]) -> dict[str, float]:
    """Weight of a word in a short notice: the rarer it is in ordinary lines, the more."""
    return {w: float(-np.log(scanner.seen.get(w, 0.0) + 1e-4)) for w in words}


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """(doc_id, paragraph, family, predicted, probability, similarity): one row per paragraph that the classifier names.

    ``predicted`` is the classifier's family, ``similarity`` the best with a
    template of it (share of shingles, or of the weight of a short notice's
    words), ``family`` is ``predicted`` if that confirms it, else ``unknown``.
    ``paragraph`` counts the lines of a text from 0. Null and empty texts give
    no rows; repeated rows give repeated rows; whole texts of any length are
    read; a null id is carried; other columns are ignored. An empty table gives
    no rows.
    """
    s = scanner or train(docs)
    # the few candidates are stored, so that the texts are read and cut into words once
    para = cut_lineage(lines(docs.select("doc_id", "text")).where(F.exists("words", lambda w: w.isin(s.anchors)))).withColumn("grams", grams(F.col("words")))
    scored = s.model.transform(s.vectors.transform(para))
    p = vector_to_array("probability")
    named = (scored.select("doc_id", "paragraph", "words", F.col("prediction").cast("int").alias("k"), p.alias("p"))
             .withColumn("probability", F.get("p", F.col("k"))).where((F.col("k") > 0) & (F.col("probability") >= s.threshold)))
    named = named.withColumn("predicted", F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.col("k") + 1))
    base = templates(docs.sparkSession)
    weights = word_weights(s, [r[0] for r in base.select(F.explode("words")).distinct().collect()])  # the words of the templates
    weight = F.from_json(F.lit(json.dumps(weights)), "map<string,double>")
    total = lambda ws: F.aggregate(ws, F.lit(0.0), lambda a, w: a + F.coalesce(F.element_at(weight, w), F.lit(0.0)))
    one = F.struct(shingles(F.col("words")).alias("runs"), F.array_distinct("words").alias("words"), (F.size("words") <= SHORT).alias("short"),
                   total(F.array_distinct("words")).alias("weight"))
    parts = cut_lineage(base.groupBy(F.col("family").alias("predicted")).agg(F.collect_list(one).alias("templates")))
    joined = named.join(F.broadcast(parts), "predicted").withColumn("own", shingles(F.col("words")))  # one row per family
    both = F.transform("templates", lambda t: F.greatest(
        F.when((F.size("own") > 0) & (F.size("words") >= SHINGLE) & (F.size(t["words"]) >= SHINGLE),
               F.size(F.array_intersect("own", t["runs"])) / F.least(F.size("own"), F.size(t["runs"]))).otherwise(0.0),
        F.when(t["short"], total(F.array_intersect(t["words"], F.col("words"))) / t["weight"]).otherwise(0.0)))
    found = joined.withColumn("similarity", F.least(F.array_max(both), F.lit(1.0)))
    return found.select("doc_id", "paragraph", F.when(F.col("similarity") >= SIMILARITY, F.col("predicted")).otherwise("unknown").alias("family"),
                        "predicted", F.round("probability", 4).alias("probability"), F.round("similarity", 6).alias("similarity"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of all ``documents``."""
    return scan(table(spark, sf_dir, "documents"))
