"""Licence scans by a trained paragraph classifier, in DataFrame and pyspark.ml operations only.

A sparse word n-gram multinomial logistic regression tells licence families and "unknown"
apart.  It learns from the families' template notices and from a bounded sample of the corpus'
own paragraphs, which template overlap labels.  A family's probability must pass a level
calibrated on held-out ordinary paragraphs, and a comparison with the family's templates
confirms it.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nazar.llm import tables
from nazar.operators.common import computed

#: Notices of the licence families (statements, standard headers, short forms, SPDX lines).
TEMPLATES = {
    "agpl-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by"
        " the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU AGPL v3.",
        "SPDX-License-Identifier: AGPL-3.0"],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0"],
    "bsd-3-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
        " without specific prior written permission.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"
        " the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Licensed under the GNU GPL v2.",
        "SPDX-License-Identifier: GPL-2.0"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"
        " the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0"],
    "lgpl-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by"
        " the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU LGPL v3.",
        "SPDX-License-Identifier: LGPL-3.0"],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the"
        " Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT"],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this work may be reproduced without permission.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."],
}
UNKNOWN = "unknown"
#: Documents (expected) whose paragraphs train the unknown class, and the most paragraphs of one.
TRAIN_DOCS, TRAIN_PARAGRAPHS = 800, 6
#: Copies of each template in the training set.
COPIES = 12
#: Size of the n-gram vocabulary, and the fewest training rows that hold an n-gram of it.
VOCABULARY, MIN_ROWS = 1 << 13, 3
#: Share of a template's n-grams that labels a paragraph, and that confirms a prediction; more
#: than the words that SPDX lines of all licences share.
LABEL_OVERLAP, CONFIRM_OVERLAP = 0.7, 0.7
#: A line break inside a hard-wrapped sentence: after a line of 50 to 90 characters that ends it
#: with no sign, before one that is not blank.
WRAP = r"\r?\n(?<=(?:\A|[\n\r])[^\n\r]{49,89}[^\n\r.!?:;]\r?\n)(?=[^\s])"
#: Share of held-out ordinary paragraphs that may pass the calibrated level, and its floor.
FALSE_SHARE, FLOOR = 0.001, 0.5
SIZES = (1, 2, 3)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-z0-9]+(?:[.][0-9]+)*"), F.lit(0))


def _runs(starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))


def with_grams(df: DataFrame) -> DataFrame:
    """``df`` with grams: the distinct word n-grams of its column p."""
    df = df.withColumn("w", words(F.col("p")))
    parts = []
    for n in SIZES:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        parts.append(_runs(starts, n))
    return df.withColumn("grams", F.array_distinct(F.concat(*parts))).drop("w")


def _grams(text: str) -> list[str]:
    w = re.findall(r"[a-z0-9]+(?:[.][0-9]+)*", text.lower())
    return list(dict.fromkeys(" ".join(w[i:i + n]) for n in SIZES for i in range(len(w) - n + 1)))


def _overlaps(grams: Column, of: Column) -> Column:
    """For each template of ``of``: the share of its n-grams that a paragraph holds, and its family."""
    return F.transform(of, lambda x: F.struct((F.size(F.array_intersect(grams, x["t"])) / F.size(x["t"])).alias("o"), x["f"].alias("f")))


def _templates() -> Column:
    """All templates as one constant: array of (family f, n-grams t)."""
    return F.array(*[F.struct(F.lit(f).alias("f"), F.array(*[F.lit(g) for g in _grams(t)]).alias("t")) for f in TEMPLATES for t in TEMPLATES[f]])


def paragraphs(text: Column) -> Column:
    """The lines of a text that are not blank, hard-wrapped ones joined."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), WRAP, " "), "[\\n\\r]+"), lambda p: F.trim(p) != "")


def training_rows(docs: DataFrame) -> DataFrame:
    """p, grams, label: templates, and paragraphs of a bounded sample of texts (the first ones by hash)."""
    spark = docs.sparkSession
    n = docs.count()
    h = F.pmod(F.xxhash64(F.lit(53), "text"), F.lit(1 << 20))
    some = docs.where("text is not null").where(h < F.lit((1 << 20) * min(1.0, TRAIN_DOCS / max(1, n))))
    own = some.select(F.explode(F.slice(F.array_sort(F.transform(paragraphs(F.col("text")), lambda p: F.struct(F.xxhash64(p).alias("h"), p.alias("p")))), 1, TRAIN_PARAGRAPHS)).alias("x"))
    own = tables.save(with_grams(own.select(F.col("x.p").alias("p")).distinct()))
    own = own.withColumn("best", F.array_max(_overlaps(F.col("grams"), _templates())))
    own = own.select("p", "grams", F.when(F.col("best.o") >= LABEL_OVERLAP, F.col("best.f")).otherwise(F.lit(UNKNOWN)).alias("label"))
    notices = spark.createDataFrame([(t, _grams(t), f) for f in TEMPLATES for t in TEMPLATES[f] for _ in range(COPIES)], "p string, grams array<string>, label string")
    return own.unionByName(notices)


def anchor_words(place: dict[str, int]) -> list[str]:
    """Words of which a confirmed paragraph holds one: of each template so many of its rarest words
    (``place``: a word's rank by frequency) that its n-grams without them are too few."""
    out = set()
    for text in (t for own in TEMPLATES.values() for t in own):
        rest = _grams(text)
        least = CONFIRM_OVERLAP * len(rest)
        for w in sorted({w for w in _grams(text) if w.isalpha()}, key=lambda w: (-place.get(w, len(place)), w)):
            if len(rest) < least:
                break
            out.add(w)
            rest = [g for g in rest if w not in g.split(" ")]
    return sorted(out)


class Classifier:
    """The fitted n-gram vocabulary, regression, calibrated level and the words a notice must hold one of."""

    def __init__(self, docs: DataFrame):
        rows = training_rows(docs)
        labels = [UNKNOWN, *TEMPLATES]
        index = F.create_map(*[F.lit(x) for i, f in enumerate(labels) for x in (f, float(i))])
        rows = rows.withColumn("y", index[F.col("label")]).withColumn("held", (F.col("label") == UNKNOWN) & (F.pmod(F.xxhash64(F.lit(59), "p"), F.lit(4)) == 0))
        rows = tables.save(rows.select("grams", "y", "held"))
        train = rows.where("not held")
        self.labels = labels
        # the n-grams of most training rows; ties by the n-gram, so that every run has the same ones
        common = train.select(F.explode("grams").alias("g")).groupBy("g").count().where(F.col("count") >= MIN_ROWS)
        vocabulary = [r["g"] for r in common.orderBy(F.desc("count"), "g").limit(VOCABULARY).collect()]
        self.counts = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="x")
        self.counts.setBinary(True)
        fit = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", maxIter=25, regParam=1e-3, elasticNetParam=0.3)
        self.model = fit.fit(tables.save(self.counts.transform(train).select("x", "y")))
        best = self.predicted(rows.where("held"))
        level = best.agg(F.percentile_approx(F.when(F.col("family") == UNKNOWN, F.lit(0.0)).otherwise(F.col("p_family")), 1 - FALSE_SHARE, 10_000)).first()[0]
        self.level = max(FLOOR, level or 0.0)
        self.anchors = anchor_words({g: i for i, g in enumerate(self.counts.vocabulary)})  # by falling frequency

    def predicted(self, rows: DataFrame) -> DataFrame:
        """``rows`` (grams) with family and p_family of the likeliest class."""
        p = vector_to_array("probability")
        out = self.model.transform(self.counts.transform(rows)).withColumn("pp", p)
        which = F.array_position("pp", F.array_max("pp"))
        return (out.withColumn("family", F.element_at(F.array(*[F.lit(x) for x in self.labels]), which.cast("int")))
                .withColumn("p_family", F.array_max("pp")).drop("x", "rawPrediction", "probability", "prediction", "pp"))


def confirmed(best: DataFrame) -> DataFrame:
    """p, family: those of ``best`` that the family's templates confirm, no other family's being nearer;
    equal paragraphs are compared once.  The templates' lambda reads a computed column: it would run
    an expression once a template."""
    rows = with_grams(best.select("p", "family").distinct())
    rows = computed(rows.select("p", "family", F.inline_outer(F.array(F.struct("grams")))), "os", _overlaps(F.col("grams"), _templates()))
    nearest = F.array_max(F.transform("os", lambda x: x["o"]))
    nearest_own = F.array_max(F.transform("os", lambda x: F.when(x["f"] == F.col("family"), x["o"])))
    return rows.where((nearest_own >= CONFIRM_OVERLAP) & (nearest_own >= nearest)).select("p", "family")


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, families (sorted, comma-joined), confidence (the highest;
    0 without a licence): one row a document, over all paragraphs (lines, hard-wrapped ones joined)
    of its whole text.  Null and empty texts have no paragraphs; null and repeated ids, and equal
    rows, are rows of their own; a paragraph that two families' templates fit alike is the
    likelier one's.  An empty table gives an empty result; other columns are not read."""
    one = F.col("doc_id").cast("long").alias("doc_id")
    found = docs.select(one, paragraphs(F.col("text")).alias("ps"))
    keep = F.filter("ps", lambda p: p.rlike(f"(?i)(?<![a-z])(?:{'|'.join(model.anchors)})(?![a-z])"))
    found = tables.save(found.select("doc_id", F.size("ps").cast("long").alias("n_paragraphs"), keep.alias("ps")).withColumn("uid", F.monotonically_increasing_id()))
    rows = with_grams(found.select("uid", F.explode("ps").alias("p")))
    likely = (F.col("family") != UNKNOWN) & (F.col("p_family") >= model.level)
    # n-grams are many times a paragraph's size: the paragraph is kept instead, if it goes further
    best = model.predicted(rows).select("uid", F.when(likely, F.col("p")).alias("p"), "family", "p_family")
    best = tables.save(best).where("p is not null")
    per = best.join(confirmed(best), ["p", "family"], "left_semi").groupBy("uid").agg(F.count("*").alias("n_licensed"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"), F.max("p_family").alias("confidence"))
    out = found.drop("ps").join(per, "uid", "left")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_licensed", F.lit(0)).cast("long").alias("n_licensed"),
                      F.coalesce("families", F.lit("")).alias("families"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, Classifier(docs))
