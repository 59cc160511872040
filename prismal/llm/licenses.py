"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are lines, and beside them blocks: runs of two lines or more between lines without a word, so
that wrapped notices are read whole. Those that hold an anchor are turned into
word 1- and 2-grams and classified by a multinomial logistic regression over the licence families
and `none`; below the calibrated probability the family is unknown. A family is confirmed if the
paragraph's words contain enough of the words of one of its templates, in any order. The anchors are taken
from the templates: of each one more word than a confirmed paragraph may lack, so a paragraph without
an anchor cannot be confirmed and is not classified. A block must also hold as many of the template's 2-grams,
since a long one has most words somewhere. It is reported, at its first line, only for a family that none
of its lines has.

A paragraph that is worded as a licence notice (`NOTICE`) but is rejected or not confirmed has the family
`unknown`, with share 0 and the probability of the most probable licence family or none. A line that is part
of the notice confirmed for its block is not reported, nor is a block that holds a reported line.

The regression is trained here, with Spark ML, on paragraphs made from the templates by rule (case,
missing words, words of prose before and after) and on prose that uses the anchors otherwise; a
third of them is held back, and with notices of other licences (`OTHERS`) sets the threshold: the least
probability from which on at most `CALIBRATE_SHARE` of what is accepted has another family. Training and scan
are DataFrame functions throughout; a row's n-grams meet the weights, a list of fixed size, within the row.

Defined cases: null and empty texts have no paragraphs of interest and no licence; repeated rows (equal
id and text) get the same result; null ids are matched as equal; other columns pass through (those
that an output name clashes with are replaced); very long lines are read whole.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Most n-grams that the classifier knows.
FEATURES = 4096
ROUNDS = 24
CALIBRATE_SHARE = 0.01
#: Share of a template's distinct words that a paragraph must hold.
CONFIRM = 0.8
OUTPUTS = ("licences", "families")
#: Starts of words that anchors are taken from first, since prose has them seldom.
RARE = ("licen", "copyright", "cc", "spdx", "redistribution", "reserved", "domain", "gnu", "gpl", "bsd", "mozilla", "apache", "permission", "permitted", "waived", "hereby", "modification", "documentation", "binary", "obtaining", "foundation")
#: Starts of the words that every match of NOTICE holds one of.
NOTICE_STARTS = ("spdx", "licen", "permission", "redistribution", "domain", "reserved")

#: Wording of a statement that something is under a licence, in lower case with single spaces.
NOTICE = "|".join((
    r"\bspdx-license-identifier: *\S",
    r"\blicen[cs]ed under (?:the |an? )?[\p{L}\p{N}]",
    r"\b(?:released|distributed|published|available|provided|covered) under (?:the |an? )?(?:[\p{L}\p{N}.,-]+ ){1,8}?(?:public )?licen[cs]e\b",
    r"\b(?:subject to|under) the terms (?:and conditions )?of (?:the |an? )?(?:[\p{L}\p{N}.,-]+ ){1,8}?licen[cs]e\b",
    r"\bpermission (?:is hereby granted|to use, copy, modify)",
    r"\bpermission is granted to (?:anyone|copy)",
    r"\bredistribution and use in source\b",
    r"\bdedicated to the public domain\b",
    r"\ball rights reserved\b",
))
UNKNOWN = "unknown"

# Short notices of each family as they are commonly written.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache License 2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT license",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, subject to the copyright notice",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL version 2",
    ],
    "lgpl": ["under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1", "Licensed under the GNU LGPL version 3"],
    "agpl": ["under the terms of the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0", "Licensed under the GNU AGPL version 3"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Licensed under the BSD 3-Clause License",
        "Released under the BSD license",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial License", "Released under the CC BY-NC-SA license"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike License"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution International License"],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0", "To the extent possible under law, all copyright has been waived under CC0", "released into the public domain"],
    "reserved": ["Copyright the authors. All rights reserved.", "All rights reserved", "Copyright. All rights reserved", "All rights reserved. No part of this publication may be reproduced without permission of the copyright holder"],
}
PROSE = (
    "she lost her driving licence and paid for a new license on monday",
    "the bar was licensed to sell beer and wine until midnight",
    "poets take some licence with the truth in every verse",
    "the lecture on copyright law was moved to the public library",
    "the court saw no warrant for the search of the house",
    "the book fell into the public domain many years ago",
    "a dealer must hold a licence for each of the shops",
    "the redistribution of land among farmers began that spring",
    "the minister said the fishing licences would be reviewed",
    "copyright disputes between the two studios went on for years",
    "his dog had a license tag from the county of the coast",
    "the nurse was licensed by the state board last year",
    "warranty claims for the car must reach the dealer in time",
    "the domain of the public servant is a general matter under law",
)
#: Notices of licences without a family here, for the calibration of the threshold only.
OTHERS = (
    "Licensed under the Eclipse Public License 2.0",
    "SPDX-License-Identifier: ISC",
    "SPDX-License-Identifier: Zlib",
    "Released under the Boost Software License, version 1.0",
    "Licensed under the European Union Public Licence",
    "This font software is licensed under the SIL Open Font License, version 1.1",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
    "Covered by the Common Development and Distribution License, version 1.1",
    "Distributed under the terms of the Artistic License 2.0",
    "Licensed under the Academic Free License version 3.0",
)
_FILL = "the of and river stone letter window garden under morning table paper before after house".split()
_MISSING = "none"


def normal_words(text):
    """Lower-cased words of letters, digits, dots and hyphens (inside words) of a column."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+(?:[.-][\\p{L}\\p{N}]+)*"), F.lit(0))


def grams(words):
    """The distinct 1- and 2-grams of an array of words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    two = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, two))


@functools.lru_cache(maxsize=1)
def anchors() -> tuple[str, ...]:
    """Starts of words, in lower case, of which every paragraph that can be confirmed holds one.

    Of each template one more distinct word is taken than a confirmed paragraph may lack.
    """
    found = set()
    for template in (t for ts in TEMPLATES.values() for t in ts):
        words = sorted(set(re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", template.lower())))
        least = math.ceil(CONFIRM * len(words) - 1e-9)  # words that a confirmed paragraph holds
        words.sort(key=lambda w: (not w.startswith(RARE), -len(w), w))
        found |= {next((r for r in RARE if w.startswith(r)), w) for w in words[: len(words) - least + 1]}
    return tuple(sorted(found))


def _gate(starts) -> str:
    """A pattern for words with one of the starts; the first letters are looked at before the alternatives."""
    first = "".join(sorted({w[0] for w in starts}))
    return f"(?<![a-z0-9])(?=[{first}])(?:{'|'.join(map(re.escape, sorted(starts)))})"


def may_hold(text):
    """Whether a text can hold a confirmed paragraph or a notice: a necessary condition in one regular expression."""
    return F.lower(text).rlike(_gate({*anchors(), *NOTICE_STARTS}))


def _literals(rows: list[tuple[str, str]]):
    return F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("template")) for f, t in rows]))


def templates(spark: SparkSession) -> DataFrame:
    """(family, words): the distinct words of each template."""
    rows = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    return spark.range(1).select(_literals(rows).alias("t")).select("t.family", F.array_distinct(normal_words(F.col("t.template"))).alias("words"))


@functools.lru_cache(maxsize=1)
def template_grams() -> tuple[str, ...]:
    """The 1- and 2-grams of all templates, a fixed list."""
    found = set()
    for template in (t for ts in TEMPLATES.values() for t in ts):
        words = list(dict.fromkeys(re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", template.lower())))
        found |= {*words, *map(" ".join, zip(words, words[1:]))}
    return tuple(sorted(found))


def training_set(spark: SparkSession) -> DataFrame:
    """(family, text, held): variants of templates and prose, made by rule."""
    rows = [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [(_MISSING, t) for t in PROSE]
    base = spark.range(1, numPartitions=1).select(_literals(rows).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))).alias("k")).select("t.*", "k")
    words = F.split("template", " ")
    # two of three rounds lose about a twelfth of their words; some are upper-case; most stand in prose
    lost = F.filter(words, lambda w, i: (F.col("k") % 3 == 0) | (F.pmod(F.xxhash64(w, i, "k"), F.lit(12)) != 0))
    fill = F.array(*map(F.lit, _FILL))

    def prose(seed: int, most: int):
        n = F.pmod(F.xxhash64("template", "k", F.lit(seed)), F.lit(most + 1)).cast("int")
        pick = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.element_at(fill, F.pmod(F.xxhash64("template", "k", i, F.lit(seed)), F.lit(len(_FILL))).cast("int") + 1))
        return F.array_join(F.slice(pick, 1, n), " ")

    text = F.concat_ws(" ", prose(1, 12), F.array_join(lost, " "), prose(2, 12))
    text = F.when(F.col("k") % 7 == 0, F.upper(text)).otherwise(text)
    return base.select("family", text.alias("text"), (F.pmod(F.xxhash64("template", "k", F.lit("held")), F.lit(3)) == 0).alias("held"))


class Model:
    """Families, weights by n-gram, biases and the threshold of probability."""

    def __init__(self, families: list[str], weights: dict[str, list[float]], bias: list[float], threshold: float):
        self.families, self.weights, self.bias, self.threshold = families, weights, bias, threshold
        self.known = sorted({*weights, *template_grams()})

    def held(self, words):
        """The distinct n-grams of an array of words that the model or a template knows."""
        return F.array_intersect(grams(words), F.array(*map(F.lit, self.known)))

    def best(self, held):
        """Struct (family, p) of the most probable family, `none` included, from what `held` gives."""
        names = [g for g in self.known if g in self.weights]
        rows = F.expr("array(" + ", ".join("array(" + ", ".join(f"{x:g}D" for x in self.weights[g]) + ")" for g in names) + ")")
        place = F.array(*map(F.lit, names))
        none = F.array(*[F.lit(0.0)] * len(self.families))
        weight = F.transform(held, lambda g: F.coalesce(F.get(rows, (F.array_position(place, g) - 1).cast("int")), none))
        z = F.aggregate(weight, F.array(*map(F.lit, self.bias)), lambda acc, w: F.zip_with(acc, w, lambda x, y: x + y))

        def result(z):
            total = F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max(z)))
            return F.struct(F.element_at(F.array(*map(F.lit, self.families)), F.array_position(z, F.array_max(z)).cast("int")).alias("family"), (1 / total).alias("p"))

        return F.transform(F.array(z), result)[0]  # so that z is computed once


@functools.lru_cache(maxsize=1)
def _fit(_application: str) -> Model:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, StringIndexer

    spark = SparkSession.getActiveSession()
    rows = training_set(spark).withColumn("grams", grams(normal_words(F.col("text")))).coalesce(1)
    used = rows.where("NOT held").select("family", "grams").cache()
    index = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(used)
    counter = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=FEATURES, minDF=2, binary=True).fit(used)
    ready = counter.transform(index.transform(used)).select("features", "label")
    fitted = LogisticRegression(maxIter=40, regParam=0.002, elasticNetParam=0.5, standardization=False, family="multinomial").fit(ready)
    used.unpersist()
    matrix = fitted.coefficientMatrix.toArray().T.tolist()
    weights = {g: [round(x, 4) for x in w] for g, w in zip(counter.vocabulary, matrix) if any(abs(x) >= 5e-5 for x in w)}
    model = Model(list(index.labels), weights, [float(x) for x in fitted.interceptVector], 0.0)
    model.threshold = calibrated(held_back(spark, model), CALIBRATE_SHARE)
    return model


def held_back(spark: SparkSession, model: Model) -> list[tuple[float, bool]]:
    """(p, right) of the paragraphs kept from training that the model gives a licence family; notices of other licences count as wrong."""
    rows = training_set(spark).where("held").select("family", "text")
    others = spark.createDataFrame([(UNKNOWN, t) for t in OTHERS], "family string, text string").coalesce(1)
    best = model.best(F.col("held")).alias("best")
    scored = rows.unionAll(others).select("family", model.held(normal_words(F.col("text"))).alias("held")).select("family", best)
    return [(r["p"], r["right"]) for r in scored.where(F.col("best.family") != _MISSING).select("best.p", (F.col("best.family") == F.col("family")).alias("right")).collect()]


def calibrated(scored: list[tuple[float, bool]], share: float) -> float:
    """The least probability from which on at most `share` of what is accepted is wrong; over 1 if there is none."""
    found, wrong = math.inf, 0
    ordered = sorted(scored, reverse=True)
    for k, (p, right) in enumerate(ordered, 1):
        wrong += not right
        if wrong <= share * k and (k == len(ordered) or ordered[k][0] < p):
            found = p
    return found


def fit(spark: SparkSession) -> Model:
    """The classifier; it depends on templates and prose only and is trained once an application."""
    return _fit(spark.sparkContext.applicationId)


def _flat(text):
    """Lower case with single spaces, for NOTICE; marks of comments at the start of lines go."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?m)^[\s#*/;%!>|-]+", " "), r"\s+", " ")


def is_notice(text):
    return _flat(text).rlike(NOTICE)


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tk, line, block, whole, words, notice): lines and blocks that hold an anchor or are notices; block is a block's first line."""
    text = F.col("text")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(may_hold(text))
    lines = F.split("text", "\n", -1)
    wordless = F.filter(F.transform("lines", lambda x, i: F.when(~x.rlike(r"[\p{L}\p{N}]"), i)), lambda i: i.isNotNull())
    ends = F.concat(wordless, F.array(F.size("lines")))
    start = F.concat(F.array(F.lit(0)), F.transform(wordless, lambda i: i + 1))
    spans = F.filter(F.arrays_zip(start.alias("lo"), ends.alias("hi")), lambda x: x["hi"] > x["lo"])
    own = own.select("id", F.xxhash64("text").alias("tk"), lines.alias("lines")).select("*", spans.alias("spans"))
    own = own.select("id", "tk", "lines", F.explode("spans").alias("b")).select("id", "tk", F.col("b.lo").alias("block"), F.slice("lines", F.col("b.lo") + 1, F.col("b.hi") - F.col("b.lo")).alias("lines"))
    joined = F.array_join("lines", "\n")
    own = own.where(may_hold(joined))
    alone = F.transform("lines", lambda x, i: F.struct((F.col("block") + i).alias("line"), F.lit(False).alias("whole"), x.alias("par")))
    both = F.concat(alone, F.when(F.size("lines") > 1, F.array(F.struct(F.col("block").alias("line"), F.lit(True).alias("whole"), joined.alias("par")))).otherwise(F.array().cast("array<struct<line:int,whole:boolean,par:string>>")))
    rows = own.select("id", "tk", "block", F.explode(both).alias("p")).select("id", "tk", "block", "p.line", "p.whole", "p.par")
    rows = rows.where(may_hold(F.col("par")))
    return rows.select("id", "tk", "line", "block", "whole", normal_words(F.col("par")).alias("words"), is_notice(F.col("par")).alias("notice"))


def license_lines(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tk, line, family, p, share): confirmed licence paragraphs and unknown notices; share of the best template's words found."""
    rows = paragraphs(docs, id_col, text_col).select("id", "tk", "line", "block", "whole", "notice", model.held(F.col("words")).alias("held"), F.when(~F.col("whole"), F.col("words")).alias("words"))
    rows = rows.withColumn("best", model.best(F.col("held"))).withColumn("p", F.when(F.col("best.family") != _MISSING, F.col("best.p")))
    rows = rows.withColumn("family", F.when(F.col("p") >= model.threshold, F.col("best.family"))).drop("best")
    lists = templates(docs.sparkSession).select("family", F.struct("words", grams(F.col("words")).alias("grams")).alias("t")).groupBy("family").agg(F.collect_list("t").alias("known"))
    rows = rows.where("family IS NOT NULL OR notice").join(F.broadcast(lists), "family", "left")  # a fixed list

    def held(t):
        share = F.size(F.array_intersect("held", t["words"])) / F.size(t["words"])
        return F.when(F.col("whole"), F.least(share, F.size(F.array_intersect("held", t["grams"])) / F.size(t["grams"]))).otherwise(share)

    best = F.array_max(F.transform("known", lambda t: F.struct(held(t).alias("share"), t["words"].alias("words"))))
    rows = rows.select("id", "tk", "line", "block", "whole", "family", "p", "notice", "words", best.alias("best"))
    sure = F.coalesce(F.col("best.share") >= CONFIRM, F.lit(False))
    hit = F.struct("line", "whole", F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"), F.coalesce("p", F.lit(0.0)).alias("p"), F.when(sure, F.col("best.share")).otherwise(0.0).alias("share"), F.when(sure, F.col("best.words")).otherwise(F.col("words")).alias("words"))
    blocks = rows.where(sure | F.col("notice")).select("id", "tk", "block", hit.alias("hit")).groupBy("id", "tk", "block").agg(F.collect_set("hit").alias("hits"))  # repeated rows count once
    alone, whole = F.filter("hits", lambda x: ~x["whole"]), F.filter("hits", lambda x: x["whole"])
    new = F.filter(whole, lambda x: ~F.exists(alone, lambda y: y["family"] == x["family"]))
    new = F.filter(new, lambda x: (x["family"] != UNKNOWN) | (F.size(alone) == 0))
    part = lambda y: F.exists(new, lambda x: (x["family"] != UNKNOWN) & (F.size(F.array_except(y["words"], x["words"])) * 2 <= F.size(F.array_distinct(y["words"]))))
    kept = F.concat(F.filter(alone, lambda y: (y["family"] != UNKNOWN) | ~part(y)), new)
    return blocks.select("id", "tk", F.explode(kept).alias("x")).select("id", "tk", "x.line", "x.family", "x.p", "x.share")


def license_scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus licences (line, family, p, share by line) and families (distinct, sorted); both empty where there is none."""
    model = model or fit(docs.sparkSession)
    keep = [c for c in docs.columns if c not in OUTPUTS]
    lines = license_lines(docs, model, id_col, text_col)
    per = lines.groupBy(F.col("id").alias("_id"), F.col("tk").alias("_tk")).agg(F.array_sort(F.collect_list(F.struct("line", "family", "p", "share"))).alias("_found"))
    joined = docs.select(*keep).withColumn("_text_key", F.xxhash64(text_col)).join(per, (F.col("_text_key") == F.col("_tk")) & F.col(id_col).eqNullSafe(F.col("_id")), "left")
    none = F.array().cast("array<struct<line:int,family:string,p:double,share:double>>")
    out = joined.withColumn("licences", F.coalesce("_found", none))
    return out.select(*keep, "licences", F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))).alias("families"))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence paragraphs and families of every whole document; `unknown` among them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = docs.select("doc_id", F.xxhash64("text").alias("tk"))
    lines = license_lines(docs, fit(spark)).groupBy("id", "tk").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("family")).alias("families"), F.array_sort(F.collect_set("line")).alias("at"))
    found = ids.join(lines, (ids["tk"] == lines["tk"]) & ids["doc_id"].eqNullSafe(lines["id"]), "left")
    places = F.array_join(F.transform(F.coalesce("at", F.array().cast("array<int>")), lambda i: i.cast("string")), ",")
    return found.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_licences"), F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"), places.alias("lines"))
