"""Licence scans by a trained paragraph classifier.

Built from DataFrame functions and Spark's own logistic regression; no Python
runs in tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.expr import bind
from quire.llm.store import hash_sample, stored

c = F.col
UNKNOWN = "unknown"

# Wording by which works are put under a licence.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 2 or later.",
        "Licensed under the GPL version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    ),
    "LGPL": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
    "proprietary": (
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced in any form without the prior written permission of the copyright holder.",
    ),
}
# Wording about licences that puts nothing under one.
MENTIONS = (
    "The driver showed a licence to the officer.",
    "Her driving license was renewed in the spring.",
    "The restaurant lost its liquor license.",
    "They asked for permission to use the hall.",
    "The apache helicopter landed near the river.",
    "We compared the license terms of several libraries.",
    "Copyright law protects authors.",
    "The creative team met in the commons.",
    "The warranty covers parts and labour for two years.",
    "All rights reserved seats were sold.",
)
# Every word sequence that counts holds one of these.
TRIGGERS = (
    "license", "licensed", "licence", "licenced", "licenses", "gnu", "gpl", "lgpl", "agpl", "apache", "bsd", "mozilla",
    "mpl", "cc", "cc0", "creative", "commons", "attribution", "spdx", "copyright", "permission", "rights", "redistribution", "redistribute", "warranty",
)
DROPPED = 6  # copies of a template, each without every sixth word from another place on
TEMPERATURES = tuple(x / 4 for x in range(1, 33))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty array for a null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def grams(tokens: Column) -> Column:
    """Distinct sequences of two and three words."""
    def of(n: int, xs: Column) -> Column:
        steps = F.when(F.size(xs) >= n, F.sequence(F.lit(1), F.size(xs) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda i: F.array_join(F.slice(xs, i, n), " "))

    return bind(tokens, lambda xs: F.array_distinct(F.concat(of(2, xs), of(3, xs))))


def _table(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(a).alias("family"), F.lit(b).alias("text")) for a, b in rows))
    return spark.range(1).select(F.explode(pairs).alias("t")).select("t.family", "t.text")


@dataclass(frozen=True)
class Model:
    """Weights per word sequence and family, offsets, and the temperature that calibrates them."""

    families: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    offsets: tuple[float, ...]
    temperature: float
    templates: tuple[tuple[str, tuple[str, ...]], ...]

    def logits(self, found: Column) -> Column:
        """A logit per family for the word sequences of a paragraph.

        Only sequences with a weight are looked up; a paragraph without any has
        the offsets, which is the unknown class.
        """
        table = F.create_map(*(x for g, w in self.weights.items() for x in (F.lit(g), F.lit(list(w)))))
        return F.aggregate(
            F.array_intersect(found, F.lit(list(self.weights))), F.lit(list(self.offsets)),
            lambda sums, g: F.zip_with(sums, table[g], lambda x, y: x + y))

    def probabilities(self, logits: Column) -> Column:
        def soft(xs: Column) -> Column:
            powers = F.transform(xs, lambda x: F.exp((x - F.array_max(xs)) / self.temperature))
            return bind(powers, lambda ps: F.transform(ps, lambda p: p / F.aggregate(ps, F.lit(0.0), lambda a, x: a + x)))

        return bind(logits, soft)

    def similarity(self, found: Column, family: Column) -> Column:
        """Largest share of a template's word sequences that the paragraph holds."""
        known = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(list(g)).alias("grams")) for f, g in self.templates))
        shares = F.transform(
            F.filter(known, lambda t: t["family"] == family),
            lambda t: F.size(F.array_intersect(t["grams"], found)) / F.size(t["grams"]))
        return F.coalesce(F.array_max(shares), F.lit(0.0))


def paragraphs(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, paragraph, text`` of the lines that hold a word the classifier knows.

    A sequence with a weight holds a trigger word, so lines without one would
    get the unknown class; they are left out before anything is computed.
    """
    some = lambda x: F.arrays_overlap(words(x), F.lit(list(TRIGGERS)))
    docs = df.select(c(doc_id).alias("doc_id"), c(text).alias("text")).where(some(c("text")))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "[\r\n]+")).alias("paragraph", "text"))
    return lines.where(some(c("text")))


def train(df: DataFrame, most_negatives: int = 2000, seed: int = 3, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fits on the templates and, as unknown, on ``most_negatives`` documents' opening lines.

    The negatives are drawn by a hash of the id over the whole table; lines that
    share a word sequence with a template are not used. Each template also comes
    in copies that lack some words. Two of these copies and a third of the
    unknown rows are kept to find the temperature.
    """
    spark = df.sparkSession
    own = _table(spark, [(f, t) for f, ts in TEMPLATES.items() for t in ts])
    mentions = _table(spark, [(UNKNOWN, t) for t in MENTIONS])
    near = F.exists("words", lambda w: F.array_contains(F.lit(list(TRIGGERS)), w))
    known = own.select("family", words(c("text")).alias("words")).withColumn("grams", grams(c("words"))).collect()
    vocabulary = sorted({g for r in known for g in r["grams"] if set(g.split()) & set(TRIGGERS)})
    copies = F.explode(F.sequence(F.lit(0), F.lit(DROPPED))).alias("copy")
    positives = own.unionByName(mentions).select("family", words(c("text")).alias("words"), copies).where(near).select(
        "family", "copy", F.filter("words", lambda w, i: (c("copy") == 0) | ((i + c("copy")) % DROPPED != 0)).alias("words"))
    openings = df.select(
        F.xxhash64(doc_id, F.lit(seed)).alias("key"), F.xxhash64(text).alias("tie"),
        F.get(F.split(text, "[\r\n]+", 2), F.lit(0)).alias("text"))
    sample = hash_sample(openings, most_negatives, c("key"), c("tie"))
    negatives = sample.select(words(c("text")).alias("words")).select(
        F.lit(UNKNOWN).alias("family"), F.pmod(F.xxhash64("words"), F.lit(9)).cast("int").alias("copy"), "words")
    known_grams = F.array_intersect(grams(c("words")), F.lit(vocabulary)).alias("grams")
    rows = positives.select("family", "copy", known_grams).where((c("family") == UNKNOWN) | (F.size("grams") > 0)).unionByName(
        negatives.select("family", "copy", known_grams).where(F.size("grams") == 0))
    families = (UNKNOWN, *TEMPLATES)
    label = F.array_position(F.lit(list(families)), c("family")).cast("double") - 1
    weight = F.when(c("family") == UNKNOWN, F.lit(0.2)).otherwise(F.lit(1.0))
    rows = stored(rows.select(label.alias("label"), "grams", "copy", weight.alias("weight")), "training")
    counted = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True).transform(rows)
    held = c("copy") >= DROPPED - 1
    fitted = LogisticRegression(
        family="multinomial", regParam=3e-4, elasticNetParam=0.5, maxIter=60, weightCol="weight", standardization=False,
    ).fit(counted.where(~held).coalesce(1))
    matrix = fitted.coefficientMatrix.toArray()
    weights = {g: tuple(float(x) for x in matrix[:, i]) for i, g in enumerate(vocabulary) if matrix[:, i].any()}
    templates = tuple((r["family"], tuple(r["grams"])) for r in known if r["grams"])
    model = Model(families, weights, tuple(float(x) for x in fitted.interceptVector), 1.0, templates)
    # the temperature under which the kept rows are likeliest
    logits = rows.where(held).select("label", model.logits(c("grams")).alias("z"))
    losses = [
        F.sum(F.ln(F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp((x - F.array_max("z")) / t)))  # noqa: B023
              - (F.get("z", c("label").cast("int")) - F.array_max("z")) / t)
        for t in TEMPERATURES
    ]
    loss = logits.agg(*losses).first()
    best = min(range(len(TEMPERATURES)), key=lambda i: (loss[i] is None, loss[i] or 0.0))
    return Model(families, weights, model.offsets, TEMPERATURES[best] if loss[best] is not None else 1.0, templates)


def scan(
    df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", least: float = 0.5, alike: float = 0.6,
) -> DataFrame:
    """``doc_id, paragraph, family, probability, similarity, confirmed`` of each licence notice.

    Paragraphs are the lines of the whole text, numbered from 0. A paragraph
    whose likeliest class is unknown, or less likely than ``least``, gives no
    row. ``confirmed`` says whether it holds the share ``alike`` of the word
    sequences of a template of its family.

    The scan is one pass over the documents without a shuffle. A null text has
    no paragraphs, a null id stays null, repeated rows are repeated.
    """
    found = paragraphs(df, doc_id, text).withColumn("grams", grams(words(c("text"))))
    scored = found.withColumn("p", model.probabilities(model.logits(c("grams"))))
    best = F.array_position("p", F.array_max("p")).cast("int")
    named = scored.withColumn("family", F.element_at(F.lit(list(model.families)), best)).withColumn(
        "probability", F.round(F.array_max("p"), 6))
    return (
        named.where((c("family") != UNKNOWN) & (c("probability") >= least))
        .withColumn("similarity", F.round(model.similarity(c("grams"), c("family")), 6))
        .select("doc_id", "paragraph", "family", "probability", "similarity", (c("similarity") >= alike).alias("confirmed"))
    )
