"""Licence scans: paragraphs classified by sparse n-gram logistic regression.

Native: DataFrame functions and Spark's own estimators.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm.common import discard, saved, text_of

UNKNOWN = "unknown"
# Notices by which authors place a work under a licence.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "mpl-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0": (
        "Released into the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal license.",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "unlicense": (
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, as permitted by the unlicense",
    ),
    "epl-2.0": (
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    ),
}
# Sentences with the same words that place nothing under a licence.
NO_LICENCE = (
    "All rights reserved.",
    "Copyright 2021 by the authors.",
    "He lost his driving license last summer and had to apply for a new one.",
    "The city issues a license to every restaurant that serves wine.",
    "You need the permission of the owner to enter the garden.",
    "The public library is open on Sundays.",
    "The general public was not admitted to the hearing.",
    "No part of this book may be reproduced without permission of the publisher.",
    "The warranty covers repairs for two years after the purchase.",
    "The software is sold under a proprietary license; redistribution is prohibited.",
    "Copyright law differs from country to country.",
    "Version 2.0 of the program is faster than version 1.0.",
    "A free license to fish is granted to residents.",
    "The foundation published the terms of the agreement.",
    "See the license agreement of the vendor for details.",
)
# A paragraph that names none of these isn't a notice; every template names one.
ANCHOR = r"(?i)licen[sc]|\bpermission is hereby\b|permission to use|redistribut|public domain|\bcc0\b|copyright|creative commons|public license"

NGRAMS = 3
# Of a notice's n-grams, or of the paragraph's if it has fewer, so many must be shared.
LEAST_SHARED = 0.6
# Paragraphs that share less with every notice are what the unknown class learns from, all
# of them. Together they weigh no more than so many of the fixed sentences.
UNLIKE, UNLIKE_WEIGHT = 0.5, 300.0
# The cut is set so that at most this share of all of them is given a family, unless that
# takes more than MOST_CUT.
FALSE_SHARE, LEAST_CUT, MOST_CUT, CUT_STEPS = 0.001, 0.5, 0.99, 10_000


def grams(text: Column) -> Column:
    """Distinct word n-grams, letters and digits only, lower-cased."""

    def of(words: Column) -> Column:
        def n_grams(n: int) -> Column:
            starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, n), " "))

        return F.array_distinct(F.concat(*[n_grams(n) for n in range(1, NGRAMS + 1)]))

    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(F.array(words), of)[0]


def _variants(text: str) -> list[str]:
    words = text.split()
    out = [text, "Copyright 2020 the authors. " + text, " ".join(words[len(words) // 4 :]), " ".join(words[: 3 * len(words) // 4 + 1])]
    return [v for v in out if len(v.split()) >= 3 or v == text]


class Classifier:
    """Weights per n-gram and class, and intercepts. ``unlike`` (text) are paragraphs that
    are no notices; all of them are learned from, where they lie."""

    def __init__(self, unlike: DataFrame):
        spark = unlike.sparkSession
        self.classes = [UNKNOWN, *TEMPLATES]
        rows = [(v, float(self.classes.index(family)), 1.0) for family, texts in TEMPLATES.items() for t in texts for v in _variants(t)]
        rows += [(t, 0.0, 1.0) for t in NO_LICENCE]
        fixed = spark.createDataFrame(rows, "text string, label double, weight double").coalesce(1)
        # Only n-grams of the fixed sentences are features: the model stays small.
        vocabulary = sorted(r["gram"] for r in fixed.select(F.explode(grams(F.col("text"))).alias("gram")).distinct().collect())
        terms = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features").setBinary(True)

        def features(rows: DataFrame) -> DataFrame:
            return terms.transform(rows.withColumn("grams", grams(F.col("text")))).select("label", "weight", "features")

        others = unlike.select("text").distinct().withColumn("label", F.lit(0.0)).withColumn("weight", F.lit(1.0))
        others = saved(features(others))
        weight = min(1.0, UNLIKE_WEIGHT / max(1, others.count()))
        data = features(fixed).unionByName(others.withColumn("weight", F.lit(weight)))
        estimator = LogisticRegression(family="multinomial", weightCol="weight", regParam=1e-3, elasticNetParam=0.1, maxIter=40)
        model = estimator.fit(data)
        discard(others)
        matrix = model.coefficientMatrix.toArray()
        self.intercepts = [float(x) for x in model.interceptVector]
        some = [(g, [float(x) for x in matrix[:, k]]) for k, g in enumerate(vocabulary) if abs(matrix[:, k]).max() > 0]
        self.weights = spark.createDataFrame(some, "gram string, w array<double>")

    def classify(self, paragraphs: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, family, probability) of paragraphs, each with its most likely class."""
        words = paragraphs.select(*keys, F.explode_outer(grams(F.col("text"))).alias("gram"))
        sums = [F.coalesce(F.sum(F.get("w", F.lit(k))), F.lit(0.0)) + b for k, b in enumerate(self.intercepts)]
        scores = words.join(F.broadcast(self.weights), "gram", "left").groupBy(*keys).agg(F.array(*sums).alias("z"))
        most = F.array_max("z")
        total = F.aggregate(F.transform("z", lambda z: F.exp(z - most)), F.lit(0.0), lambda a, e: a + e)
        best = F.array_position("z", most).cast("int")
        family = F.element_at(F.array(*map(F.lit, self.classes)), best)
        return scores.select(*keys, family.alias("family"), (1 / total).alias("probability"))


def cut_of(unlike: DataFrame) -> float:
    """The least probability, in steps, that gives a family to no more than FALSE_SHARE of
    the classified paragraphs ``unlike`` (family, probability). All are counted."""
    step = F.when(F.col("family") != UNKNOWN, F.floor(F.col("probability") * CUT_STEPS)).otherwise(-1)
    counts = {r["step"]: r["count"] for r in unlike.groupBy(step.cast("int").alias("step")).count().collect()}  # CUT_STEPS + 2 rows at most
    over = 0
    for k in sorted((k for k in counts if k >= 0), reverse=True):
        over += counts[k]
        if over > FALSE_SHARE * sum(counts.values()):
            return min(MOST_CUT, max(LEAST_CUT, (k + 1) / CUT_STEPS))
    return LEAST_CUT


def template_grams(spark: SparkSession) -> DataFrame:
    rows = [(family, k, t) for family, texts in TEMPLATES.items() for k, t in enumerate(texts)]
    found = spark.createDataFrame(rows, "tf string, tk int, text string").withColumn("g", grams(F.col("text")))
    return found.select("tf", "tk", F.size("g").alias("tn"), F.explode("g").alias("gram"))


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pos, text, family, probability, shared, confirmed): one row
    per paragraph (line) of the documents that names a licence word. ``shared`` is the
    best share of n-grams with a notice of the predicted family.

    Null and empty texts have no such paragraph. Rows with equal id and text give their
    paragraphs once. The unknown class and the cut follow from all paragraphs that share
    little with any notice; without one, from the fixed sentences and LEAST_CUT.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", text_of("text").alias("text")).where(F.col("text").rlike(ANCHOR))
    keys = ["doc_id", "text_hash", "pos"]
    lines = (
        rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        .where(F.col("text").rlike(ANCHOR))
        .dropDuplicates(keys)
    )
    candidates = saved(lines)
    words = candidates.select(*keys, F.size(grams(F.col("text"))).alias("n"), F.explode(grams(F.col("text"))).alias("gram"))
    # Templates are fixed: some hundred rows.
    shared = words.join(F.broadcast(template_grams(spark)), "gram").groupBy(*keys, "tf", "tk", "tn", "n").agg(F.count(F.lit(1)).alias("c"))
    shared = saved(shared.groupBy(*keys, F.col("tf").alias("family")).agg(F.max(F.col("c") / F.least("n", "tn")).alias("shared")))
    most = shared.groupBy(*keys).agg(F.max("shared").alias("most"))
    lines = saved(_meet(candidates, most, keys).withColumn("unlike", F.coalesce("most", F.lit(0.0)) < UNLIKE).drop("most"))
    discard(candidates)
    model = Classifier(lines.where("unlike"))
    found = saved(model.classify(lines, [*keys, "unlike"]))
    cut = cut_of(found.where("unlike"))
    found = found.drop("unlike").withColumn("family", F.when(F.col("probability") >= cut, F.col("family")).otherwise(UNKNOWN))
    out = _meet(_meet(lines.drop("unlike"), found, keys), shared, [*keys, "family"])
    out = out.withColumn("shared", F.coalesce("shared", F.lit(0.0)))
    return out.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("shared") >= LEAST_SHARED))


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null."""
    right = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
    return left.join(right, on, "left").drop(*[f"r_{k}" for k in keys])


def licence_digest(documents: DataFrame) -> DataFrame:
    """Per document: paragraphs looked at, those confirmed, the families found and the
    likeliest of them."""
    found = (
        scan(documents.select("doc_id", "text"))
        .groupBy("doc_id", "text_hash")
        .agg(
            F.count(F.lit(1)).alias("n_candidates"),
            F.count_if("confirmed").alias("n_confirmed"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
            F.max(F.when(F.col("confirmed"), F.struct("probability", "family"))).alias("best"),
        )
    )
    rows = documents.select("doc_id", F.xxhash64(text_of("text")).alias("text_hash"))
    none = F.lit(0).cast("long")
    return _meet(rows, found, ["doc_id", "text_hash"]).select(
        "doc_id",
        F.coalesce("n_candidates", none).alias("n_candidates"),
        F.coalesce("n_confirmed", none).alias("n_confirmed"),
        F.coalesce("families", F.lit("")).alias("families"),
        F.col("best.family").alias("best_family"),
        F.round("best.probability", 6).alias("best_probability"),
    )
