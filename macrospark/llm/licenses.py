"""Licence scans: a trained classifier of paragraphs, confirmed by templates.

A paragraph is a line. Its words and word pairs are hashed into a sparse vector for a multinomial logistic regression over
licence families, `none` and `unknown` (a licence notice of no known family). It is trained on notices from the templates in surroundings
drawn from paragraphs of the corpus, on plain paragraphs, and on notices whose names are replaced by words of the corpus. On rows held out, a
temperature makes the probabilities honest and a threshold keeps wrong families rare. A family is reported if it is
likely enough and most word pairs of one of its templates stand in the paragraph; other notices are `unknown`."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from macrospark.llm.common import kept, let, same_row, text_mark

# Usual notices of each family.
TEMPLATES = {
    "agpl-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL v3.0."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "bsd-3-clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GPL v3.0."],
    "isc": ["Released under the ISC License."],
    "lgpl-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without permission."],
}
#: Notices without a name; @ stands for words of the corpus.
UNNAMED = ["Licensed under the @ License.", "This work is licensed under the @ Public License, version 1.", "Released under the @ License.", "Distributed under the terms of the @ Licence."]
CLASSES = [*sorted(TEMPLATES), "none", "unknown"]

#: Buckets of the hashed vector, paragraphs drawn for training, share of template pairs that confirms, false families accepted among held-out rows.
FEATURES, SAMPLE, CONFIRM, FALSE_RATE = 1 << 13, 12_000, 0.7, 0.002
TEMPERATURES = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]


def tokens(text: Column) -> Column:
    """Lower-case words and numbers, versions kept whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"), F.lit(0))


def grams(found: Column) -> Column:
    """Words and pairs of neighbours, each once."""
    pairs = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", w[i], w[i + 1])))
    return let(found, lambda w: F.array_distinct(F.concat(w, F.coalesce(pairs(w), F.array().cast("array<string>")))))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, mark (the text_mark of the text), paragraph (its number) and line of all lines with a letter."""
    lines = docs.select("doc_id", text_mark(F.col("text")).alias("mark"), F.posexplode(F.split("text", "\n", -1)).alias("paragraph", "line"))
    return lines.where(F.col("line").rlike(r"\p{L}"))


def training_rows(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """line, label (number in CLASSES) and held (set aside for calibration) made from up to `rows` paragraphs. They are those with
    the smallest hashes among the paragraphs of documents drawn by a hash, some `rows` / 4 of them, so that only these are sorted."""
    share = min(1.0, rows / 4 / max(1, docs.count()))
    chosen = docs.where(F.pmod(F.xxhash64(F.lit("licence"), "doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    drawn = paragraphs(chosen).select("line").where(~F.lower("line").rlike("licen[cs]e|rights reserved|public domain"))
    drawn = drawn.withColumn("h", F.xxhash64("line")).orderBy("h", "line").limit(rows)
    dice = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "h"), F.lit(n)).cast("int")
    flat = [(CLASSES.index(f), t) for f in sorted(TEMPLATES) for t in TEMPLATES[f]]
    notices = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(t).alias("text")) for k, t in flat])
    w = F.split("line", " ")
    some = lambda at: F.array_join(F.slice(w, F.lit(1) + dice(at, 20), dice(at + "n", 8)), " ")
    # one word in ten of a longer notice is lost
    worn = lambda t: F.array_join(F.filter(F.split(t, " "), lambda x: (F.pmod(F.xxhash64(F.lit("worn"), "h", x), F.lit(10)) > 0) | (F.size(F.split(t, " ")) < 8)), " ")
    around = lambda t: F.when(dice("wrap", 2) == 0, t).otherwise(F.concat_ws(" ", some("a"), t, some("b")))
    notice = notices[dice("notice", len(flat))]
    unnamed = F.array(*[F.lit(t) for t in UNNAMED])[dice("unnamed", len(UNNAMED))]
    own = F.array_join(F.slice(w, 1, 2), " ")
    kind = dice("kind", 10)
    line = F.when(kind < 5, F.col("line")).when(kind < 9, around(worn(notice["text"]))).otherwise(around(F.replace(unnamed, F.lit("@"), own)))
    label = F.when(kind < 5, CLASSES.index("none")).when(kind < 9, notice["label"]).otherwise(CLASSES.index("unknown"))
    made = drawn.select(line.alias("line"), label.cast("double").alias("label"), (dice("held", 4) == 0).alias("held"))
    # every class at least once, however small the corpus
    sure = [*flat, (CLASSES.index("none"), ""), *[(CLASSES.index("unknown"), t.replace("@", "Example")) for t in UNNAMED]]
    return made.unionByName(docs.sparkSession.createDataFrame([(t, float(k), False) for k, t in sure], made.schema))


@dataclass(frozen=True)
class Classifier:
    model: LogisticRegressionModel
    temperature: float
    threshold: float


def _vectors(rows: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(rows.withColumn("grams", grams(tokens(F.col("line")))))


def _softened(raw: Column, temperature: Column | float) -> Column:
    """Probabilities from raw scores."""
    t = temperature if isinstance(temperature, Column) else F.lit(temperature)
    return let(raw, lambda r: let(F.transform(r, lambda x: F.exp((x - F.array_max(r)) / t)), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))))


def train(docs: DataFrame, rows: int = SAMPLE) -> Classifier:
    made = kept(_vectors(training_rows(docs, rows)), "licence-training")
    model = LogisticRegression(maxIter=40, regParam=1e-4, family="multinomial", standardization=False).fit(made.where("NOT held").coalesce(4))
    held = kept(model.transform(made.where("held")).select("label", vector_to_array("rawPrediction").alias("raw")), "licence-held")
    losses = held.agg(*[F.avg(-F.log(F.greatest(_softened(F.col("raw"), t)[F.col("label").cast("int")], F.lit(1e-12)))).alias(str(t)) for t in TEMPERATURES]).first()
    temperature = min(TEMPERATURES, key=lambda t: (losses[str(t)] if losses[str(t)] is not None else 0.0, abs(t - 1.0)))
    p = _softened(F.col("raw"), temperature)
    best = F.array_max(F.slice(p, 1, len(TEMPLATES)))
    wrong = held.where(F.col("label") >= len(TEMPLATES)).agg(F.percentile_approx(best, 1.0 - FALSE_RATE, 10_000)).first()[0]
    return Classifier(model, temperature, max(0.5, wrong or 0.0))


def likeness(found: Column, family: Column) -> Column:
    """Share of word pairs of the family's closest template that stand in the paragraph."""
    known = F.create_map(*[x for f, ts in sorted(TEMPLATES.items()) for x in (F.lit(f), F.array(*[F.array(*[F.lit(g) for g in _pairs(t)]) for t in ts]))])
    return F.array_max(F.transform(F.element_at(known, family), lambda t: F.size(F.array_intersect(t, found)) / F.size(t)))


def _pairs(text: str) -> list[str]:
    words = re.findall(r"\w+(?:[.\-]\w+)*", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def classify(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, mark, paragraph, licence (a family or `unknown`), probability and likeness of the paragraphs that are notices."""
    scored = classifier.model.transform(_vectors(paragraphs(docs))).select("doc_id", "mark", "paragraph", "grams", vector_to_array("rawPrediction").alias("raw"))
    none = CLASSES.index("none")
    notices = scored.where(F.array_position("raw", F.array_max("raw")) != none + 1)
    rows = notices.withColumn("p", _softened(F.col("raw"), classifier.temperature)).withColumn("_best", F.slice("p", 1, len(TEMPLATES)))
    rows = rows.withColumn("family", F.array(*[F.lit(c) for c in sorted(TEMPLATES)])[F.array_position("_best", F.array_max("_best")).cast("int") - 1])
    rows = rows.withColumn("likeness", likeness(F.col("grams"), F.col("family")))
    sure = (F.array_max("_best") >= classifier.threshold) & (F.col("likeness") >= CONFIRM)
    return rows.select("doc_id", "mark", "paragraph", F.when(sure, F.col("family")).otherwise("unknown").alias("licence"),
                       F.when(sure, F.array_max("_best")).otherwise(F.array_max("p")).alias("probability"), "likeness")


def notices(docs: DataFrame) -> DataFrame:
    """The licence notices of all documents. Null and empty texts have none; equal rows have theirs each; a table
    without text has none."""
    return classify(docs, train(docs))


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`, by its own text: doc_id, licences (its families and `unknown`, in order of name, joined by a comma; null if it has none),
    n_notices and n_unknown."""
    found = notices(docs).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(  # equal rows have the same notices
        F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("licences"), F.count_distinct("paragraph").alias("n_notices"),
        F.count_distinct(F.when(F.col("licence") == "unknown", F.col("paragraph"))).alias("n_unknown"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.join(found, same_row(docs), "left").select("doc_id", "licences", zero("n_notices"), zero("n_unknown"))
