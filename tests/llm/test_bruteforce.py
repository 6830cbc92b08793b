"""Licences, languages and the pipeline's stages against plain Python versions, text by text."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import regex
from pyspark.sql import functions as F

from kickmill.llm import language_id as LI
from kickmill.llm import license_scan as LS
from kickmill.llm.queries import QUERIES
from kickmill.llm.tables import stored

SMALL = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# --- languages ------------------------------------------------------------------------------------------


def features(text):
    data = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in f" {text.lower()} ".encode())
    found = Counter()
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            g = data[i : i + n]
            if (g[0] == 32 and g[-1] == 32) or 32 in g[1:-1]:
                continue
            h = n * 0x85EBCA6B & 0xFFFFFFFF
            for b in g:
                h = (h ^ b) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            found[h >> (32 - LI.BITS)] += 1
    return found


def duel(names, machines, margins):
    total, worst = dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
    for m, x in zip(machines, margins):
        p = 1 / (1 + math.exp(-min(50.0, max(-50.0, m.slope * x))))
        for name, q in ((m.plus, p), (m.minus, 1 - p)):
            total[name] += q
            worst[name] = min(worst[name], q)
    best = max(names, key=lambda n: total[n])  # the first of equals
    return best, worst[best]


def plain_language(model, table, text):
    if text is None or not regex.search(r"\p{L}", text):
        return "und", 0.0
    own = features(text)
    n = max(1, sum(own.values()))
    margins = [sum(int(table[f, i]) * c for f, c in own.items()) / LI.SCALE / n + m.bias for i, m in enumerate(model.machines())]
    family, score = duel(model.families, model.between, margins)
    at = len(model.between) + sum(len(model.within[f]) for f in model.families[: model.families.index(family)])
    lang, inner = duel(model.languages[family], model.within[family], margins[at : at + len(model.within[family])])
    return lang, score * inner


def test_languages(spark):
    docs = documents(spark)
    sample = LI.training_sample(docs, "doc_id", "text", "lang", LI.PER_LANGUAGE)
    model = LI.train([t for t, _ in sample], [lang for _, lang in sample])
    table = model.table()
    got = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, SMALL).collect()}
    for r in docs.collect():
        lang, score = plain_language(model, table, r.text)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 2e-6


def test_ties_between_machines():
    """Equal sums: the first name in order wins, whatever the machines' order."""
    even = [LI.Machine(a, b, np.zeros(1), 0.0, 4.0) for a, b in (("a", "b"), ("a", "c"), ("b", "c"))]
    best, worst = LI.vote(["a", "b", "c"], even, np.zeros((2, 3)))
    assert best.tolist() == [0, 0] and worst.tolist() == [0.5, 0.5]


def test_language_sample_of_repeated_ids(spark):
    """Many rows of one id and language teach as one."""
    rows = [(1, f"the text number {i}", "en") for i in range(300)] + [(i, "der text", "de") for i in range(2, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = LI.training_sample(df, "doc_id", "text", "lang", 250)
    assert sum(lang == "en" for _, lang in sample) <= 1


# --- licences -------------------------------------------------------------------------------------------


def grams(text):
    words = regex.findall(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*", text.lower())
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))


class PlainLicences:
    def __init__(self, spark):
        self.classes, table, self.intercepts, self.least = LS.train(spark)
        self.weights = {r.g: r.w for r in table.collect()}
        self.templates = {f: [({g for g in grams(t.text) if " " in g}, set(t.marks), t.whole) for t in ts] for f, ts in LS.templates().items()}
        self.notices = [t for ts in self.templates.values() for t, _, whole in ts if t and not whole]

    def agreement(self, own, family):
        two = {g for g in own if " " in g}
        return max((len(two & t) / (len(t) if whole else max(1, min(len(two), len(t)))) for t, marks, whole in self.templates.get(family, []) if t and marks <= set(own)), default=0.0)

    def agrees(self, own):
        two = {g for g in own if " " in g}
        return any(len(two & t) / max(1, min(len(two), len(t))) >= LS.AGREEMENT for t in self.notices)

    def judged(self, text, at, lines):
        own = grams(text)
        if not any(c in text.lower() for c in LS.CUES) and not self.agrees(own):
            return None
        scores = np.array(self.intercepts) + sum((np.array(self.weights[g]) for g in own if g in self.weights), np.zeros(len(self.classes)))
        p = np.exp(scores - scores.max())
        p /= p.sum()
        family, agreement = self.classes[int(p.argmax())], self.agreement(own, self.classes[int(p.argmax())])
        return at, lines, family, float(p.max()), agreement, family != LS.UNKNOWN and p.max() >= self.least and agreement >= LS.AGREEMENT

    def scan(self, text):
        lines, out, at = (text or "").split("\n"), [], 0
        while at < len(lines):
            end = at
            while end < len(lines) and regex.search(r"[\p{L}\p{N}]", lines[end]):
                end += 1
            alone = [x for i in range(at, end) if (x := self.judged(lines[i], i, 1))]
            whole = self.judged("\n".join(lines[at:end]), at, end - at) if end - at > 1 else None
            if whole and not any(x[5] and x[2] == whole[2] for x in alone):
                alone.append(whole)
            out += alone
            at = max(end, at + 1)
        return out


#: Notices whose wording is none of the templates'.
OTHER_WORDINGS = {
    "You can use it under the terms of the MIT License": ["MIT"],
    "Everything here is distributed under the terms of the Apache License, Version 2.0 unless stated otherwise": ["Apache-2.0"],
    "The text of this page is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License": ["CC-BY-SA-4.0"],
    "Our tools are available under the GNU General Public License v3.0 only": ["GPL-3.0"],
    "permission is hereby granted, free of charge, to any person obtaining a copy of this program": ["MIT"],
    "Redistribution and use in source form, with or without modification, are permitted": None,
    "A fishing license is required at the lake": [],
    "The library is open on Sundays and free of charge": [],
    "She got permission to use the hall for a fee": [],
}


def test_licences(spark):
    plain = PlainLicences(spark)
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    rows += [(10**6 + i, t) for i, t in enumerate([*OTHER_WORDINGS, None, "", "\n\n", "a\nb\n\nReleased under the\nMIT License.\nAll rights reserved.", "Licensed under the ISC License." * 2])] + [(10**6, next(iter(OTHER_WORDINGS)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = LS.scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain.scan(r.text)
        assert [(x.paragraph, x.lines, x.family, x.confirmed) for x in r.licences] == [(*x[:3], x[5]) for x in want], r.doc_id
        assert all(abs(x.probability - w[3]) < 2e-6 and abs(x.agreement - w[4]) < 2e-6 for x, w in zip(r.licences, want))
    found = {r.text: sorted({x.family for x in r.licences if x.confirmed}) for r in got}
    assert {t: found[t] for t, w in OTHER_WORDINGS.items() if w is not None} == {t: w for t, w in OTHER_WORDINGS.items() if w is not None}
    assert LS.scan(df.limit(0)).count() == 0


def test_licence_query(spark):
    plain = PlainLicences(spark)
    got = {r.doc_id: r for r in QUERIES["op5_license_scan"](spark, SMALL).collect()}
    for r in documents(spark).collect():
        want = plain.scan(r.text)
        sure = [x[2] for x in want if x[5]]
        assert (got[r.doc_id].families, got[r.doc_id].n_candidates, got[r.doc_id].n_confirmed) == (sorted(set(sure)), len(want), len(sure))


# --- stages ---------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def hits(items, text):
    """Words of the text inside any window of an item."""
    known = {}
    for t in items:
        w = words(t)
        for i in range(max(0, len(w) - 12) if len(w) >= 13 else bool(w)):
            own = tuple(w[i : i + 13])
            known.setdefault(len(own), set()).add(own)
    w = words(text)
    covered = set()
    for n, wins in known.items():
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                covered.update(range(i, i + n))
    return len(w), len(covered)


def test_stages_that_drop(spark):
    import corpus_pipeline as CP

    plan = dict(CP.STAGES)
    extra = [(10**9, "123 456", "en", "s", 7), (10**9 + 1, None, None, None, None), (10**9 + 2, "", "de", "s", 0), (None, "the house and the garden of the old man were near the river", None, "s", 5)]
    docs = stored(documents(spark).unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long")), "test")
    step = stored(plan["language_id"](spark, docs.withColumns({"lang_pred": F.lit("x"), "judged": F.lit(1)}), SMALL), "test")
    sample = LI.training_sample(docs, "doc_id", "text", "lang", LI.PER_LANGUAGE)
    model = LI.train([t for t, _ in sample], [lang for _, lang in sample])
    table, want = model.table(), []
    for r in docs.collect():
        lang, score = plain_language(model, table, r.text)
        if lang != "und" and round(score, 6) >= CP.LEAST_SCORE:
            want.append((r.doc_id, r.text, r.lang or lang, r.source, r.n_chars))
    digest = lambda rows: sorted(hashlib.md5(repr(tuple(r)).encode()).hexdigest() for r in rows)
    assert step.columns == CP.COLUMNS and digest(step.collect()) == digest(want)

    bench = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = plan["contamination"](spark, docs, SMALL)
    clean = [r for r in docs.collect() if not (lambda n, h: h > 0 and 20 * h >= n)(*hits(bench, r.text))]
    assert got.columns == CP.COLUMNS and digest(got.collect()) == digest(clean) and len(clean) < docs.count()
    for stage in ("language_id", "repeated_passages", "contamination", "packing"):
        assert plan[stage](spark, docs.limit(0), SMALL).count() == 0
