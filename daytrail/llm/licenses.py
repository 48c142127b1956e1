"""License scans: a trained paragraph classifier whose findings a template confirms.

A paragraph is a line; a line of more than ``WINDOW`` words is read in windows of so many, a new one
every ``STEP`` words, so that of any notice in it one window holds 0.6 or is filled by it to 0.6. Its
word 1- and 2-grams are hashed to a sparse vector, and a multinomial logistic regression gives
probabilities of the licence families and of *unknown*. The regression is trained here: on the
families' templates (whole, in parts, and set between sampled words up to the length of a window,
since notices come cut and joined with other text) and, for *unknown*, on paragraphs of the corpus
that no template would confirm, a bounded sample by hash (``SAMPLE`` paragraphs of ``SAMPLE_TEXTS``
texts). A second regression of one variable, fitted on training rows that the first one did
not see, turns the lead of the best family over *unknown* into a calibrated probability; below
``KNOWN`` a paragraph is unknown. What is left is compared with the templates of its family: the
share of its distinct 2-grams that one template has, or of the template's that it has, must reach
``CONFIRMED``.

Everything is DataFrame work and Spark's own feature transformers; no Python runs on executors.

Defined cases: null and empty texts have no paragraph and no licence; paragraphs of one word have
1-grams only and are not confirmed; a corpus too small to give a sample of unknown paragraphs is
completed with fixed sentences; rows with equal ids are rows of their own; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrail.plans.ranking import with_group_row
from daytrail.session import cut_lineage

FEATURES, SAMPLE, SAMPLE_TEXTS = 1 << 13, 3000, 500
KNOWN, CONFIRMED = 0.5, 0.6
UNKNOWN = "unknown"
#: Words of a window of a long line, and from one window's start to the next.
WINDOW, STEP = 64, 48
#: Lengths to which sampled words fill templates up for training.
LENGTHS = (16, 32, 48, WINDOW)

# Notices of common licences, as their publishers word them.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
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
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work.",
    ),
}
#: Paragraphs that no licence has, for corpora that have too few.
PLAIN = (
    "The train leaves the station at nine in the morning.",
    "She opened the window and looked at the rain over the hills.",
    "Version 2.0 of the program adds a new button to the first page.",
    "The school was released from duty under the new law.",
    "He works in the public library of the town.",
    "A list of general terms is printed on the last page.",
)


def words_of(paragraph: Column) -> Column:
    """Lower-case words; inner dots and hyphens stay, so 4.0 and by-nc are words."""
    return F.regexp_extract_all(F.lower(paragraph), F.lit(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"), F.lit(0))


def features(rows: DataFrame) -> DataFrame:
    """Adds ``pairs`` (2-grams) and ``features`` to rows with ``words``."""
    paired = NGram(n=2, inputCol="words", outputCol="pairs").transform(rows)
    terms = paired.withColumn("terms", F.concat("words", "pairs"))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="terms", outputCol="features").transform(terms).drop("terms")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(row, words) of the lines with a word, long ones in windows; ``row`` is whatever ``docs`` names so."""
    lines = docs.select("row", F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line"))
    whole = lines.select("row", words_of(F.col("line")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.size("words") - (WINDOW - STEP), F.lit(STEP))
    cut = F.transform(starts, lambda start: F.slice("words", start, F.lit(WINDOW)))
    return whole.select("row", F.explode(F.when(F.size("words") <= WINDOW, F.array("words")).otherwise(cut)).alias("words"))


def template_rows(spark: SparkSession) -> DataFrame:
    """(family, words) of the templates. Fixed size."""
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    return spark.createDataFrame(rows, "family string, line string").select("family", words_of(F.col("line")).alias("words"))


def overlaps() -> Column:
    """Of rows (pairs, templates): the share of the smaller side that each template has in common."""
    mine = F.array_distinct("pairs")

    def share(template: Column) -> Column:
        common = F.size(F.array_intersect(mine, template))
        return common / F.greatest(F.lit(1), F.least(F.size(mine), F.size(template)))

    return F.transform("templates", share)


def training_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(family, words): templates whole, without their first or last words, and set between
    sampled words; sampled paragraphs as *unknown*, but for those that look like a template."""
    templates = template_rows(spark)
    known = NGram(n=2, inputCol="words", outputCol="pairs").transform(templates).agg(
        F.collect_list(F.array_distinct("pairs")).alias("templates")
    )
    h = F.xxhash64(F.col("text").cast("string"))
    # Texts by hash, each once; only the hashes of all texts are moved.
    texts = docs.where("text IS NOT NULL").select(h.alias("h")).distinct().orderBy("h").limit(SAMPLE_TEXTS)
    picked = (
        paragraphs(docs.select("text", h.alias("row")).join(F.broadcast(texts.withColumnRenamed("h", "row")), "row", "left_semi"))
        .where(F.size("words") >= 3)
        .select("words", F.xxhash64("words").alias("h"))
        .distinct()
        .orderBy("h")
        .limit(SAMPLE)
    )
    plain = spark.createDataFrame([(x,) for x in PLAIN], "line string").select(words_of(F.col("line")).alias("words"))
    sample = cut_lineage(picked.select("words").union(plain).coalesce(1))
    pairs = NGram(n=2, inputCol="words", outputCol="pairs").transform(sample)
    looks = F.array_max(overlaps()) >= CONFIRMED
    unknown = cut_lineage(
        with_group_row(pairs, known).where(~looks).select(F.lit(UNKNOWN).alias("family"), "words").coalesce(1)
    )
    parts = templates.select(
        "family", "words", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("cut")
    ).select(
        "family",
        # A slide of two thirds of the words, or for cut 0 the whole.
        F.when(F.col("cut") == 0, F.col("words")).otherwise(
            F.slice(
                "words",
                (1 + F.floor(F.size("words") / 3 * (F.col("cut") - 1) / 8)).cast("int"),
                F.greatest(F.lit(3), F.ceil(F.size("words") * 2 / 3)).cast("int"),
            )
        ).alias("words"),
    )
    # Words of some of the sample in one row, twice the longest length at least.
    some = unknown.orderBy(F.xxhash64("words")).limit(SAMPLE // 10)
    fill = some.agg(F.flatten(F.collect_list("words")).alias("fill")).withColumn(
        "fill", F.flatten(F.array_repeat("fill", F.ceil(2 * WINDOW / F.size("fill")).cast("int")))
    )
    lengths, thirds = F.array(*[F.lit(x) for x in LENGTHS]), F.sequence(F.lit(0), F.lit(3))
    placed = templates.select("family", "words", F.explode(lengths).alias("length")).select(
        "*", F.explode(thirds).alias("third"), (F.col("length") - F.size("words")).alias("room")
    ).where("room > 0")
    begin = 1 + F.pmod(F.xxhash64("words", "length", "third"), F.size("fill") - WINDOW)
    before = F.floor(F.col("room") * F.col("third") / 3)
    set_in = (
        with_group_row(placed, fill)
        .withColumn("begin", begin.cast("int")).withColumn("before", before.cast("int"))
        .select(
            "family",
            F.concat(
                F.slice("fill", F.col("begin"), F.col("before")), "words",
                F.slice("fill", F.col("begin") + F.col("before"), F.col("room") - F.col("before")),
            ).alias("words"),
        )
    )
    return parts.union(set_in).union(unknown)


class Classifier:
    """The trained regression, its class names and the calibration of its lead."""

    def __init__(self, model: LogisticRegressionModel, slope: float, offset: float):
        self.model, self.slope, self.offset = model, slope, offset
        self.names = [*sorted(TEMPLATES), UNKNOWN]

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``family`` (null: unknown) and ``score``, the calibrated probability of being known."""
        raw = self.model.transform(rows).withColumn("raw", vector_to_array("rawPrediction"))
        best = F.array_max(F.slice("raw", 1, len(TEMPLATES)))
        lead = best - F.element_at("raw", -1)
        score = 1 / (1 + F.exp(-(lead * self.slope + self.offset)))
        name = F.get(F.array(*[F.lit(x) for x in self.names]), F.array_position("raw", best).cast("int") - 1)
        return (
            raw.withColumn("score", score)
            .withColumn("family", F.when(F.col("score") >= KNOWN, name))
            .drop("raw", "rawPrediction", "probability", "prediction")
        )


def train(spark: SparkSession, docs: DataFrame) -> Classifier:
    names = F.array(*[F.lit(x) for x in [*sorted(TEMPLATES), UNKNOWN]])
    label = (F.array_position(names, F.col("family")) - 1).cast("double")
    rows = cut_lineage(
        features(training_rows(spark, docs)).select(
            label.alias("label"),
            # Classes weigh alike, whatever their number of rows.
            F.when(F.col("family") == UNKNOWN, 0.1).otherwise(1.0).alias("weight"),
            "features",
            F.pmod(F.xxhash64("words", "family"), F.lit(5)).alias("fold"),
        ).coalesce(1)
    )
    fit = LogisticRegression(
        family="multinomial", regParam=1e-3, elasticNetParam=0.0, maxIter=40, weightCol="weight", standardization=False
    )
    first = fit.fit(rows.where("fold <> 0"))
    known = (F.col("label") < len(TEMPLATES)).cast("double")
    raw = first.transform(rows.where("fold = 0")).withColumn("raw", vector_to_array("rawPrediction"))
    lead = F.array_max(F.slice("raw", 1, len(TEMPLATES))) - F.element_at("raw", -1)
    held = raw.select(array_to_vector(F.array(lead)).alias("features"), known.alias("label"), "weight")
    scale = LogisticRegression(regParam=1e-2, maxIter=50, weightCol="weight", standardization=False).fit(held)
    return Classifier(first, float(scale.coefficients[0]), float(scale.intercept))


def confirmed(found: DataFrame) -> DataFrame:
    """Rows (family, pairs, ...) whose 2-grams a template of the family confirms, with ``overlap``."""
    spark = found.sparkSession
    templates = NGram(n=2, inputCol="words", outputCol="pairs").transform(template_rows(spark))
    by_family = templates.groupBy("family").agg(F.collect_list(F.array_distinct("pairs")).alias("templates"))
    return (
        found.join(F.broadcast(by_family), "family")  # one row a family
        .withColumn("overlap", F.array_max(overlaps()))
        .where(F.col("overlap") >= CONFIRMED)
        .drop("templates")
    )


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licenses, score), a row for each row of ``docs``.

    ``licenses``: the confirmed families by name, joined with commas, or null; ``score``: the
    highest calibrated probability among them, or 0.
    """
    classifier = train(docs.sparkSession, docs)
    keyed = docs.select("doc_id", F.md5(F.col("text").cast("string").cast("binary")).alias("row"), "text")
    found = confirmed(classifier.predict(features(paragraphs(keyed))).where("family IS NOT NULL"))
    per_text = found.groupBy("row").agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licenses"),
        F.max("score").alias("score"),
    )
    return (
        keyed.select("doc_id", "row")
        .join(cut_lineage(per_text), "row", "left")
        .select("doc_id", "licenses", F.coalesce("score", F.lit(0.0)).alias("score"))
    )
