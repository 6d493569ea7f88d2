"""Licence notices in documents: a trained classifier of paragraphs, confirmed by templates.

A paragraph (a line with a word) is the set of those words and word pairs in it that occur in a
template. A multinomial logistic regression gives it a licence family or "unknown". It is trained on
notices made from fixed templates and on the paragraphs of all documents, without those in which a
pair of several templates turns up. Paragraphs that hold the same terms are one row with a weight.
However many documents there are, their paragraphs together weigh what those of NEGATIVES documents
would, so that the templates keep their share.

Unknown is calibrated: a quarter of these paragraphs is held back from training, and a family is only
believed at a probability that no more than one in a thousand of them reaches, and at least one half. A prediction is
then confirmed, or not, by comparison with the family's templates: the share of a template's word
pairs that the paragraph has, which must be CONFIRM or more for the best template.

Scoring looks each word and pair up by hash. Most paragraphs end at a bound: if even the largest
weights, over families, of what they hold stay below unknown's, no family can win.

All steps are SQL functions and Spark's own ML stages, and run inside the JVM. Two passes read all
documents: the one for training shuffles counts of sets of terms, that for scoring has no shuffle. What is
broadcast are the templates and the model, whose sizes are fixed by the templates.

Defined results: null, empty or wordless texts have no paragraphs; a paragraph counts in full, however long; each of repeated
rows is reported; a null id comes through as null; without documents there is nothing to report; only doc_id and text are read.
"""

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevitals.llm.common import stored

NEGATIVES = 1000  # documents whose weight the paragraphs of all have together, at most
CONFIRM = 0.75
UNKNOWN = "unknown"

#: Names by which notices call a family's licence.
NAMES = {
    "apache": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0", "the Apache 2.0 license"],
    "mit": ["the MIT License", "the MIT license (MIT)", "MIT"],
    "bsd": ["the BSD License", "the BSD 3-Clause License", "the BSD 2-Clause License", "BSD-3-Clause", "a BSD-style license"],
    "gpl": ["the GNU General Public License, version 3", "the GNU General Public License, version 2", "the GNU GPL", "GPL-3.0", "GPLv3", "GPL-2.0-or-later"],
    "lgpl": ["the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License", "LGPL-2.1", "LGPLv3"],
    "agpl": ["the GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"],
    "mpl": ["the Mozilla Public License, Version 2.0", "MPL-2.0", "the Mozilla Public License"],
    "cc-by": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0"],
    "cc0": ["CC0 1.0", "CC0 1.0 Universal", "the CC0 1.0 Universal Public Domain Dedication", "CC0-1.0"],
    "unlicense": ["The Unlicense", "the Unlicense (public domain)"],
}
#: What stands around a licence's name.
FRAMES = [
    "Licensed under {}.",
    "Released under {}.",
    "This work is licensed under {}.",
    "This software is distributed under the terms of {}.",
    "This project is available under {}; see the LICENSE file for details.",
    "SPDX-License-Identifier: {}",
    "License: {}",
]
#: Opening words of the licences' own notices.
NOTICES = {
    "apache": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
FAMILIES = [UNKNOWN, *NAMES]


def templates(spark: SparkSession) -> DataFrame:
    """family and text of every template."""
    rows = [(family, frame.format(name)) for family, names in NAMES.items() for name in names for frame in FRAMES]
    rows += [(family, text) for family, texts in NOTICES.items() for text in texts]
    listed = F.array(*(F.struct(F.lit(family).alias("family"), F.lit(text).alias("text")) for family, text in rows))
    return spark.range(1).select(F.explode(listed).alias("row")).select("row.family", "row.text")


_WORD_ENDS = "[^\\p{L}\\p{N}.]+|\\.+(?=[^\\p{L}\\p{N}]|$)"
#: SQL: hashes of the word pairs of an array `words`, in order.
_PAIRS = "if(size(words) < 2, cast(array() as array<bigint>), transform(sequence(0, size(words) - 2), i -> xxhash64(get(words, i), get(words, i + 1))))"
_TERMS = f"concat(transform(words, x -> xxhash64(x)), {_PAIRS})"


def split_words(text: str) -> str:
    """SQL: lower-cased words of a text, without the dots that end them."""
    pattern = _WORD_ENDS.replace("\\", "\\\\")
    return f"filter(split(lower({text}), '{pattern}'), w -> w <> '')"


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (line number from 0) and words of every line with a word."""
    # The words come out of a generator, so that no filter above makes Spark split a line again.
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(f"posexplode(transform(split(text, '\\n'), l -> {split_words('l')})) as (paragraph, words)"))
    return lines.where("size(words) > 0")


class Vocabulary:
    """The templates' terms, numbered, and their lookup by hash as SQL."""

    def __init__(self, known: DataFrame):
        terms = known.select(F.explode(F.expr(_TERMS)).alias("term")).distinct().orderBy("term")
        self.terms = [row.term for row in terms.collect()]  # as many as the templates have
        self.places = 1 << max(12, (64 * len(self.terms)).bit_length())
        table: dict[int, list[int]] = {}
        for number, term in enumerate(self.terms):
            table.setdefault(term % self.places, []).append(number)
        self.depth = max(map(len, table.values()), default=1)
        self.tables = [literal([table.get(place, [])[level] if level < len(table.get(place, [])) else -1 for place in range(self.places)], "int") for level in range(self.depth)]
        self.hashes = literal(self.terms, "bigint")

    def found(self, terms: str = _TERMS) -> str:
        """SQL: the distinct numbers of the vocabulary's terms in a paragraph."""
        look = lambda table: f"get({table}, cast(pmod(h, {self.places}) as int))"
        hit = "coalesce(" + ", ".join(f"if(get({self.hashes}, {look(t)}) = h, {look(t)}, null)" for t in self.tables) + ", -1)"
        return f"array_distinct(filter(transform({terms}, h -> {hit}), n -> n >= 0))"


def literal(values: list, kind: str) -> str:
    """SQL: a constant array, folded once by the optimizer."""
    return f"from_json('[{','.join(map(str, values))}]', 'array<{kind}>')"


def trained(docs: DataFrame) -> tuple[Vocabulary, list[list[float]], list[float], float]:
    """The vocabulary, weights by family and term, intercepts, and the probability to believe."""
    spark = docs.sparkSession
    known = templates(spark).select("family", F.expr(split_words("text")).alias("words"))
    known = stored(known, "templates")
    vocabulary = Vocabulary(known)
    size = len(vocabulary.terms)
    number = F.element_at(F.create_map(*(F.lit(x) for i, family in enumerate(FAMILIES) for x in (family, float(i)))), F.col("family"))
    share = min(1.0, NEGATIVES / max(docs.count(), 1))
    # Paragraphs with a pair that several templates have, such as "licensed under", may be notices.
    marks = known.select(F.explode(F.array_distinct(F.expr(_PAIRS))).alias("pair")).groupBy("pair").count().where("count >= 3").select("pair")
    listed = literal(sorted(row.pair for row in marks.collect()), "bigint")
    others = paragraphs(docs).where(f"not arrays_overlap({_PAIRS}, {listed})")
    others = others.select(F.sort_array(F.expr(vocabulary.found())).alias("found"), (F.pmod(F.xxhash64("words"), F.lit(4)) == 0).alias("held"))
    others = stored(others.groupBy("found", "held").agg(F.count("*").cast("double").alias("times")), "negatives")
    rows = known.select(F.sort_array(F.expr(vocabulary.found())).alias("found"), number.alias("label")).groupBy("found", "label").agg(F.count("*").cast("double").alias("weight"))
    rows = rows.union(others.where("not held").select("found", F.lit(0.0).alias("label"), F.col("times") * share))
    places = CountVectorizerModel.from_vocabulary([str(j) for j in range(size)], inputCol="terms", outputCol="features")
    rows = places.transform(rows.withColumn("terms", F.col("found").cast("array<string>"))).select("features", "label", "weight")
    fit = LogisticRegression(maxIter=30, regParam=1e-4, family="multinomial", weightCol="weight", standardization=False).fit(rows)
    weights, intercepts = fit.coefficientMatrix.toArray().tolist(), fit.interceptVector.toArray().tolist()
    weights += [[0.0] * size for _ in range(len(FAMILIES) - len(weights))]
    reached = others.where("held").select(F.array_max(F.slice(F.expr(probabilities(weights, intercepts)), 2, len(FAMILIES))).alias("p"), F.col("times").cast("long").alias("times"))
    # Below one half it does not matter which, so few values are told apart.
    reached = reached.select(F.when(F.col("p") < 0.5, 0.0).otherwise(F.floor(F.col("p") * 1e6) / 1e6).alias("p"), "times")
    top = reached.agg(F.percentile("p", 0.999, F.col("times"))).first()[0]
    return vocabulary, weights, intercepts, max(0.5, top or 0.0)


def probabilities(weights: list[list[float]], intercepts: list[float]) -> str:
    """SQL: the probability of each family for the terms `found`."""
    size = len(weights[0])
    flat, start = literal([x for row in weights for x in row], "double"), literal(intercepts, "double")
    margins = f"transform(sequence(0, {len(weights) - 1}), k -> aggregate(found, get({start}, k), (s, j) -> s + get({flat}, k * {size} + j)))"
    return f"transform(array({margins}), m -> transform(m, x -> 1 / aggregate(m, 0.0D, (s, y) -> s + exp(least(y - x, 700)))))[0]"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed of each believed notice."""
    spark = docs.sparkSession
    vocabulary, weights, intercepts, believed = trained(docs)
    lead = literal([max(row[j] - weights[0][j] for row in weights[1:]) for j in range(len(vocabulary.terms))], "double")
    start = max(x - intercepts[0] for x in intercepts[1:])
    # A family can only reach one half if its margin reaches unknown's.
    rows = paragraphs(docs).select("doc_id", "paragraph", F.explode(F.array(F.struct("words", F.expr(vocabulary.found()).alias("found")))).alias("row"))
    rows = rows.where(f"aggregate(row.found, {start}D, (s, j) -> s + get({lead}, j)) >= 0")
    rows = rows.select("doc_id", "paragraph", "row.words", "row.found").withColumn("p", F.expr(probabilities(weights, intercepts)))
    best = F.expr(f"array_max(slice(p, 2, {len(FAMILIES)}))")
    family = F.get(F.array(*map(F.lit, FAMILIES)), (F.array_position(F.col("p"), best) - 1).cast("int"))
    rows = rows.where(best >= believed).select("doc_id", "paragraph", family.alias("family"), best.alias("probability"), F.array_distinct(F.expr(_PAIRS)).alias("pairs"))
    known = templates(spark).select("family", F.expr(split_words("text")).alias("words")).select("family", F.array_distinct(F.expr(_PAIRS)).alias("template"))
    known = known.where("size(template) > 0").groupBy("family").agg(F.collect_list("template").alias("known"))
    compared = rows.join(F.broadcast(known), "family", "left")
    shares = F.transform(F.coalesce("known", F.expr("cast(array() as array<array<bigint>>)")), lambda one: F.size(F.array_intersect(one, F.col("pairs"))) / F.size(one))
    similarity = F.coalesce(F.array_max(shares), F.lit(0.0))
    return compared.select("doc_id", "paragraph", "family", "probability", similarity.alias("similarity")).withColumn("confirmed", F.col("similarity") >= CONFIRM)
