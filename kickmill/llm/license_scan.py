"""Licence notices with DataFrame functions and a trained paragraph classifier.

Paragraphs are runs of lines with words, and each of their lines by itself.  One that has one of the ``CUES`` or agrees with a notice of any family (shared 2-grams) is a
candidate.  Its distinct word 1- and 2-grams are the features of a sparse (L1-penalised) multinomial logistic regression over licence families and ``unknown``, fitted by
MLlib on notices, sentences and whole paragraphs of licences, on look-alikes and on licences that are near to a family.
``unknown`` is calibrated on sentence patterns that the calibrating fit never saw (``fitted``).  A prediction counts once the
paragraph also agrees with a template of that family and has all words that the template asks for: name and version.

The model is a bounded table of n-grams held by every task, so documents are scanned in place without a shuffle.
"""

from __future__ import annotations

import json
import re
from itertools import product
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kickmill.llm.decontaminate import constant, let

UNKNOWN = "unknown"
#: A paragraph with any of these (lower case) is a candidate, whether it agrees with a template or not.
CUES = ("licen", "copyright", "rights reserved", "public domain", "redistribut", "permission is hereby", "warranty", "spdx")
# Fixed values from here to ``TEXTS``: names and texts of public licences.
#: Names by which notices call a family.
NAMES = {
    "MIT": ("MIT License", "MIT licence", "Expat License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache License v2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3 license", "GPL-3.0 license", "GPLv3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2 license", "GPL-2.0 license", "GPLv2"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0 license", "LGPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1 license", "LGPLv2.1"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0 license", "AGPLv3"),
    "BSD-3-Clause": ("BSD 3-Clause License", "three-clause BSD license", "New BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "two-clause BSD license", "Simplified BSD License"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "MPL 2.0 license"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "EPL-2.0 license"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Zero public domain dedication"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Unlicense": ("Unlicense",),
}
#: Identifiers that say more than the family's name.
IDENTIFIERS = {f: (f + "-only", f + "-or-later", f) for f in ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0")}
#: Sentences by which works refer to a licence, or that only one licence has.
SENTENCES = {
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",),
    "Apache-2.0": ("You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "GPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version",),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 2 of the License, or any later version",),
    "LGPL-3.0": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, either version 3 of the License",),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, either version 2.1 of the License",),
    "AGPL-3.0": ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",),
    "BSD-3-Clause": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and dedicated this work to the public domain",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice",),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission", "This document is proprietary and confidential. Unauthorized copying or redistribution is prohibited.", "Copyright 2021 Example Inc. All rights reserved."),
}
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
#: Whole paragraphs of licence texts.
TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD-3-Clause": (_BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "BSD-2-Clause": (_BSD,),
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
}
#: Licences beside the families, other versions of theirs, and names without the version; all are ``unknown``.
NEAR = (
    "Apache License, Version 1.1", "Apache License 1.0", "Apache License", "GNU General Public License, version 1", "GNU General Public License", "GNU Lesser General Public License", "Mozilla Public License, Version 1.1",
    "MPL 1.1 license", "BSD license", "BSD 4-Clause License", "CC BY 3.0", "CC BY-SA 3.0", "CC BY-NC 3.0", "CC BY-NC-ND 3.0", "Creative Commons Attribution 3.0 Unported License", "Creative Commons license", "Eclipse Public License 1.0",
    "Artistic License 2.0", "SIL Open Font License, Version 1.1", "Python Software Foundation License", "PHP License 3.01", "European Union Public Licence 1.2", "Open Data Commons Open Database License",
)
#: Words of names that a notice may leave out; all others it must have.
GENERIC = frozenset("license licence public general version international commons creative gnu".split())
#: Words that tell sentences of different families apart, with those that have digits.
TELLING = frozenset(("lesser", "affero", "neither"))
NOTICES = ("Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This project is distributed under the terms of the {}.", "The code is available under {}. See LICENSE for details.", "License: {}")
#: Words around the sentences in training.
CONTEXTS = ("2019 {}", "(c) The authors. {}", "Please note: {}", "{} See the end of this page.", "Terms of use: {} Contact us for more.")
#: Sentences that have a cue and grant nothing.
LOOKALIKES = tuple(
    a.format(b)
    for a, b in product(
        ("He lost his {} license last year.", "A {} license is required.", "The {} licence costs forty euros a year.", "She renewed the {} license online.", "The court discussed {} copyright law.", "Copyright of {} works lasts seventy years.", "The {} warranty covers two years.", "A {} company bought the rights to redistribute the film.", "The state may redistribute {} income.", "The {} board revoked licenses in May.", "Old {} songs enter the public domain.", "Which license should a {} project choose?", "Licensed {} dealers only.", "My {} licence expires under the new rules.", "All rights of {} users are respected.", "There is no warranty on {} goods.", "Permission is needed for a {} event."),
        ("driving", "fishing", "software", "medical", "hunting", "public", "free", "music", "general", "national", "business", "pilot"),
    )
)
#: Look-alikes of one sentence pattern follow each other.
LOOKALIKE_WORDS = 12
#: Share of the held-out look-alikes whose best family's probability the threshold must exceed.
CALIBRATED = 0.85
#: Share of a template's or the paragraph's 2-grams, whichever are fewer, that must agree.
AGREEMENT = 0.6
#: Words of notices that other texts have as well; they decide what is looked for first, not what is found.
COMMON = frozenset("a and are at by for in is may not of the this to under with work terms".split())
#: Least probability of a family, also when the calibration split would allow less.
LEAST = 0.5


class Template(NamedTuple):
    text: str
    #: Words that a paragraph must have to agree.
    marks: tuple[str, ...] = ()
    #: A whole paragraph: so many of its own pairs must be there, while of a notice a part will do.
    whole: bool = False


def plain_words(text: str) -> list[str]:
    """``words_of`` for the templates, which are ASCII."""
    return re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower())


def templates() -> dict[str, list[Template]]:
    out: dict[str, list[Template]] = {}
    for family, names in NAMES.items():
        marks = {name: tuple(w for w in plain_words(name) if w not in GENERIC) for name in names}
        out[family] = [Template(n.format(name), marks[name]) for name in names for n in NOTICES]
        for name in IDENTIFIERS.get(family, (family,)):
            out[family] += [Template(n.format(name), (name.lower(),)) for n in ("SPDX-License-Identifier: {}", "License: {}", "Licensed under {}.")]
    for family, sentences in SENTENCES.items():
        told = lambda t: () if family == "proprietary" else tuple(w for w in plain_words(t) if w in TELLING or any(c.isdigit() for c in w))  # noqa: B023, E731
        out.setdefault(family, []).extend(Template(t, told(t)) for t in sentences)
    for family, texts in TEXTS.items():
        out[family] += [Template(t, (), True) for t in texts]
    return {family: list({t.text.lower(): t for t in ts}.values()) for family, ts in out.items()}


def training_rows() -> list[tuple[str, str, int]]:
    """(text, family, group): notices with words around them or left out, and look-alikes; in a fixed order.

    Look-alikes of one sentence pattern have its number as their group, which is -1 for all else.  No two rows have equal words.
    """
    rows: dict[tuple[str, ...], tuple[str, str, int]] = {}

    def add(text: str, family: str, group: int = -1) -> None:
        rows.setdefault(tuple(plain_words(text)), (text, family, group))

    alone = {x for texts in (*SENTENCES.values(), *TEXTS.values()) for x in texts}
    for family, own in sorted(templates().items()):
        for i, t in enumerate(own):
            add(t.text, family)
            add("Notice - " + t.text, family)
            add(t.text + " Thank you for reading this page.", family)
            if t.text not in alone:
                continue
            for around in CONTEXTS:
                add(around.format(t.text), family)
            words = t.text.split()
            if len(words) > 12:
                add(" ".join(w for j, w in enumerate(words) if j != i % len(words)), family)
                if not t.whole:
                    add(" ".join(words[: len(words) * 3 // 4]), family)
    for i, t in enumerate(LOOKALIKES):
        add(t, UNKNOWN, i // LOOKALIKE_WORDS)
    for name in NEAR:
        for n in NOTICES:
            add(n.format(name), UNKNOWN)
            add("Notice - " + n.format(name), UNKNOWN)
    return list(rows.values())


def words_of(low: Column) -> Column:
    """Letters, digits, and ``.`` and ``-`` inside."""
    return F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def grams(text: Column) -> Column:
    """Distinct words and pairs of words, lower case."""
    return let(words_of(F.lower(text)), lambda w: F.array_distinct(F.concat(w, pairs(w))))


def pairs(w: Column) -> Column:
    none = F.expr("cast(array() as array<string>)")
    return F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))).otherwise(none)


class Fit(NamedTuple):
    classes: list[str]
    #: JSON list of {g: gram, w: a weight for each class}.
    weights: str
    intercepts: list[float]
    #: Least probability of a family.
    least: float
    #: Look-alikes that the threshold was calibrated on.
    n_calibration: int


#: The fit depends on constants alone, so one is enough for a driver.
_fits: list[Fit] = []


def fitted(spark: SparkSession) -> Fit:
    """The model; fitted at the first call.

    Every other sentence pattern of the look-alikes is held out from a first fit, and the ``CALIBRATED`` quantile of the
    best family's probability of its sentences there is the threshold, ``LEAST`` at least.  What passes is left to the templates.  The model itself has all rows.
    """
    if not _fits:
        _fits.append(_fit(spark))
    return _fits[0]


def _fit(spark: SparkSession) -> Fit:
    rows = training_rows()
    classes = sorted({c for _, c, _ in rows})
    # a bounded list of constants
    data = spark.createDataFrame([(plain_words(t) + pairs_of(t), float(classes.index(c)), g) for t, c, g in rows], "x array<string>, label double, g int").coalesce(1).cache()
    counted = None
    try:
        counter = CountVectorizer(inputCol="x", outputCol="features", binary=True, minDF=3.0).fit(data)
        counted = counter.transform(data).select("features", "label", "g").cache()
        fit = lambda d: LogisticRegression(family="multinomial", regParam=0.0003, elasticNetParam=0.5, maxIter=25, tol=1e-4, standardization=False).fit(d)
        held = (F.col("g") >= 0) & (F.col("g") % 2 == 0)
        part = fit(counted.filter(~held))
        of_families = F.filter(vector_items("probability"), lambda _, i: i != classes.index(UNKNOWN))
        judged = [r.p for r in part.transform(counted.filter(held)).select(F.array_max(of_families).alias("p")).collect()]
        model = fit(counted)
    finally:
        data.unpersist()
        if counted is not None:
            counted.unpersist()
    matrix, vocabulary = model.coefficientMatrix.toArray(), counter.vocabulary
    used = [i for i in range(matrix.shape[1]) if matrix[:, i].any()]
    weights = json.dumps([{"g": vocabulary[i], "w": [round(float(x), 9) for x in matrix[:, i]]} for i in used])
    return Fit(classes, weights, [round(float(x), 9) for x in model.interceptVector], max(LEAST, sorted(judged)[int(CALIBRATED * len(judged))]), len(judged))


def train(spark: SparkSession) -> tuple[list[str], DataFrame, list[float], float]:
    """(classes, (gram, weights) table, intercepts, least probability of a family)."""
    fit = fitted(spark)
    table = spark.range(1).select(F.explode(F.from_json(F.lit(fit.weights), "array<struct<g:string,w:array<double>>>")).alias("r")).select("r.g", "r.w")
    return fit.classes, table, fit.intercepts, fit.least


def vector_items(column: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)


def pairs_of(text: str) -> list[str]:
    """The distinct pairs of words of a template."""
    w = plain_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def pair_pattern(known: set[str]) -> str:
    """Matches lower-case text that has one of the pairs, by the words of ``grams``; nested by first letter and word."""
    after: dict[str, dict[str, list[str]]] = {}
    for pair in sorted(known):
        first, second = pair.split(" ")
        after.setdefault(first[0], {}).setdefault(first[1:], []).append(second)
    letter, either = r"[\p{L}\p{N}]", lambda parts: f"(?:{'|'.join(parts)})"
    gap = rf"(?![.-]{letter})[^\p{{L}}\p{{N}}]+"
    ways = [re.escape(c) + either([re.escape(rest) + gap + either(map(re.escape, ends)) for rest, ends in words.items()]) for c, words in after.items()]
    return rf"(?<!{letter})(?<!{letter}[.-])" + either(ways) + rf"(?![.-]?{letter})"


def telling_pairs(template: list[str]) -> list[str]:
    """So many pairs, the least common ones, that no text can agree with the template without one of them, unless it has fewer pairs itself."""
    common = lambda p: sum(w in COMMON for w in p.split(" "))
    return sorted(template, key=lambda p: (common(p), -len(p), p))[: int((1 - AGREEMENT) * len(template) + 1e-9) + 1]


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``licences``: array<struct<paragraph, lines, family, probability, agreement, confirmed>> of its candidates.

    ``paragraph`` is the first line, from 0, and ``lines`` how many there are.  Lines without letters and digits end a
    paragraph.  One of several lines is left out if a line of it is confirmed for the same family.  ``family`` may be ``unknown``; ``confirmed`` needs a family above the
    calibrated probability and agreement with one of its templates whose ``marks`` the paragraph has: of a notice 0.6 of its pairs
    or of the paragraph's own, whichever are fewer, of a whole paragraph 0.6 of its pairs.  So no part of a text that two
    licences share tells one of them.

    Null or empty text and text without cues and template pairs have no candidates.  Very long lines are read whole.  All columns of
    ``docs`` are kept, one named ``licences`` is replaced; ids play no part, repeated rows are judged alike, an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    classes, table, intercepts, least = train(spark)
    weights, size = constant(table.withColumn("h", F.xxhash64("g")), "h", F.struct(F.col("g"), F.col("w")), "struct<g:string,w:array<double>>")
    known = {f: [{"p": pairs_of(t.text), "m": list(t.marks), "whole": t.whole} for t in ts if pairs_of(t.text)] for f, ts in templates().items()}
    zero = F.array(*[F.lit(x) for x in intercepts])
    kind = "struct<p:array<string>,m:array<string>,whole:boolean>"
    text_templates = F.from_json(F.lit(json.dumps([known.get(c, []) for c in classes])), f"array<array<{kind}>>")
    # whole paragraphs of licences have cues, so only notices are looked for without one
    notices = {tuple(t["p"]) for ts in known.values() for t in ts if not t["whole"]}
    notice_pairs = {p for t in notices for p in t}
    longest = max(len(t) for t in notices)
    telling = pair_pattern({p for t in notices for p in telling_pairs(list(t))})
    listed = lambda xs: F.from_json(F.lit(json.dumps(sorted(xs))), "array<string>")
    template_grams = listed({p for ts in known.values() for t in ts for p in t["p"]})
    template_marks = listed({m for ts in known.values() for t in ts for m in t["m"]})
    notice_list, some_pair = F.from_json(F.lit(json.dumps(sorted(map(list, notices)))), "array<array<string>>"), pair_pattern(notice_pairs)

    def score(own: Column) -> Column:
        found = F.flatten(F.transform(own, lambda g: F.filter(F.get(weights, F.pmod(F.xxhash64(g), F.lit(size)).cast("int")), lambda e: e["g"] == g)))
        return F.aggregate(found, zero, lambda acc, e: F.zip_with(acc, e["w"], lambda a, b: a + b))

    def softmax(scores: Column) -> Column:
        return let(F.transform(scores, lambda s: F.exp(s - F.array_max(scores))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))

    def known_pairs(own: Column, body) -> Column:
        """body(struct<n pairs, those of them that a template has, words that a template asks for>)."""
        two = F.filter(own, lambda g: F.contains(g, F.lit(" ")))
        return let(let(two, lambda g: F.struct(F.size(g).alias("n"), F.array_intersect(g, template_grams).alias("p"), F.array_intersect(own, template_marks).alias("m"))), body)

    def share(x: Column, pairs: Column, whole: Column | bool = False) -> Column:
        of = F.size(pairs) if whole is False else F.when(whole, F.size(pairs)).otherwise(F.least(x["n"], F.size(pairs)))
        return F.size(F.array_intersect(x["p"], pairs)) / F.greatest(F.lit(1), F.least(x["n"], of) if whole is False else of)

    def agreement(own: Column, number: Column) -> Column:
        marked = lambda x: F.filter(F.get(text_templates, number), lambda t: F.size(F.array_except(t["m"], x["m"])) == 0)
        return known_pairs(own, lambda x: F.coalesce(F.array_max(F.transform(marked(x), lambda t: share(x, t["p"], t["whole"]))), F.lit(0.0)))

    def agrees(own: Column) -> Column:
        return known_pairs(own, lambda x: F.exists(notice_list, lambda t: share(x, t) >= AGREEMENT))

    def verdict(paragraph: Column, n_lines: Column, own: Column) -> Column:
        return let(softmax(score(own)), lambda p: let(F.array_position(p, F.array_max(p)).cast("int") - 1, lambda k: let(agreement(own, k), lambda a: F.struct(paragraph.alias("paragraph"), n_lines.alias("lines"), F.get(F.array(*[F.lit(c) for c in classes]), k).alias("family"), F.round(F.array_max(p), 6).alias("probability"), F.round(a, 6).alias("agreement"), ((F.get(F.array(*[F.lit(c) for c in classes]), k) != UNKNOWN) & (F.array_max(p) >= least) & (a >= AGREEMENT)).alias("confirmed")))))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cued = lambda low: _any([F.contains(low, F.lit(x)) for x in CUES])
    # d different words have d - 1 different pairs at least
    few = lambda low: F.size(F.array_distinct(words_of(low))) - 1 < longest
    hinted = lambda c: let(F.lower(c), lambda low: cued(low) | F.rlike(low, F.lit(telling)) | (F.rlike(low, F.lit(some_pair)) & few(low)))
    judged = lambda x, at, n: let(grams(x), lambda own: F.when(cued(F.lower(x)) | agrees(own), verdict(at, n, own)))
    kept = lambda found: F.filter(found, lambda x: x.isNotNull())

    def of_paragraph(p: Column) -> Column:
        """Candidates among the lines of a paragraph and the paragraph itself."""
        lines = F.filter(F.transform(p["x"], lambda x, i: F.struct((p["i"] + i).alias("i"), x.alias("x"))), lambda s: hinted(s["x"]))
        alone = kept(F.transform(lines, lambda s: judged(s["x"], s["i"], F.lit(1))))
        joined = F.array_join(p["x"], "\n")
        whole = F.when((F.size(p["x"]) > 1) & hinted(joined), judged(joined, p["i"], F.size(p["x"])))
        known = lambda one, every: F.exists(every, lambda x: x["confirmed"] & (x["family"] == one["family"]))
        return let(alone, lambda ls: let(whole, lambda w: F.concat(ls, F.filter(F.array(w), lambda x: x.isNotNull() & ~known(x, ls)))))

    # without a cue or a pair of some template there is nothing in any of its lines either
    loosely = lambda c: let(F.lower(c), lambda low: cued(low) | F.rlike(low, F.lit(some_pair)))
    found = F.transform(F.filter(paragraphs(text), lambda p: loosely(F.array_join(p["x"], "\n"))), of_paragraph)
    return docs.withColumn("licences", F.flatten(found))


def paragraphs(text: Column) -> Column:
    """array<struct<i, x>>: number of the first line, and the lines, of every run of lines with letters or digits."""

    def runs(lines: Column, full: Column) -> Column:
        edges = lambda step: F.filter(F.transform(full, lambda f, i: F.when(f & ~F.coalesce(F.get(full, i + step), F.lit(False)), i)), lambda i: i.isNotNull())
        return F.zip_with(edges(-1), edges(1), lambda a, b: F.struct(a.alias("i"), F.slice(lines, a + 1, b - a + 1).alias("x")))

    return let(F.split(text, "\n"), lambda lines: let(F.transform(lines, lambda x: F.rlike(x, F.lit(r"[\p{L}\p{N}]"))), lambda full: runs(lines, full)))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document: its confirmed licence families, its candidates and how many were confirmed."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    families = F.array_sort(F.array_distinct(F.transform(F.filter("licences", lambda x: x["confirmed"]), lambda x: x["family"])))
    return out.select("doc_id", families.alias("families"), F.size("licences").cast("long").alias("n_candidates"), F.size(F.filter("licences", lambda x: x["confirmed"])).cast("long").alias("n_confirmed"))
