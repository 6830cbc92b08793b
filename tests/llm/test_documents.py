"""Packing, language ID, licences and decontamination."""

import random
import textwrap
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kickmill.llm import decontaminate as DC
from kickmill.llm import language_id as LI
from kickmill.llm import license_scan as LS
from kickmill.llm import packing as PK
from kickmill.llm.queries import ORACLES, QUERIES
from tests.oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer(tokenizer_path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path)


def test_encoder_equals_tokenizer(tokenizer, tokenizer_path):
    encoder = PK.PieceEncoder(tokenizer_path)
    rng = random.Random(0)
    signs = list("abcXYZ é'sΣς \n\t\x1c\x85\xa0<>|12½²!.-İK–’…́") + ["<|endoftext|>", "don't", "ΑΣ Σ", "\r\n", "  ", "中文", "ﬁ"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for t, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def check_packing(pieces, texts, tokenizer, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for d, t in texts.items():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted(by_doc[d], key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and sum(p.length for p in own) == len(ids)
        for p in own:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        total = sum(p.length for p in own)
        assert total <= length and total & (total - 1) == 0  # full, or a power of two


def test_packing(spark, tokenizer, tokenizer_path):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(int(rng.paretovariate(0.7) * 10) % 9000)) for i in range(300)} | {900: None, 901: "", 902: "x " * 20000}
    df = spark.createDataFrame([(i, t, "other") for i, t in texts.items()], "doc_id long, text string, ids string").repartition(3)
    out = PK.pack(df, tokenizer_path, length=256, shard_sequences=16).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(out, texts, tokenizer, 256)
    assert PK.pack(df.limit(0), tokenizer_path).count() == 0


def test_packing_of_null_ids_and_repeated_rows(spark, tokenizer, tokenizer_path):
    rows = [(None, "alpha beta"), (None, "alpha beta"), (7, "gamma"), (7, "gamma"), (7, None), (7, "delta " * 300)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, sequence_id string").coalesce(1)
    out = PK.pack(df, tokenizer_path, length=64, shard_sequences=2).collect()
    want = sorted((str(i), len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    assert sorted((str(p.doc_id), p.doc_tokens) for p in out if p.start == 0) == want and sum(p.length for p in out) == sum(n for _, n in want)
    places = {(p.sequence_id, p.offset + k) for p in out for k in range(p.length)}
    assert len(places) == sum(n for _, n in want)


def test_every_plain_character_in_context(tokenizer, tokenizer_path):
    """Between letters, digits and signs, alone and twice; also those whose lower case would leave the plain ones."""
    encoder = PK.PieceEncoder(tokenizer_path)
    for c in map(chr, [*range(0x260), *range(0x2000, 0x2030)]):
        t = f"a{c}b 1{c}2 .{c}, {c} {c}{c}'s{c} '{c}"
        assert encoder.encode([t])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, hex(ord(c))
    assert encoder.encode(["\u00d5\u0245"])[0].tolist() == tokenizer.encode("\u00d5\u0245", add_special_tokens=False).ids
    assert "\u0245" not in PK.PLAIN and "\u0130" not in PK.PLAIN and "\u00d5" in PK.PLAIN


def test_long_texts_are_tokenized_in_sections(tokenizer, tokenizer_path, monkeypatch):
    """Sections end before white space; a text without any is taken whole."""
    monkeypatch.setattr(PK, "SECTION", 50)
    monkeypatch.setattr(PK, "LEARNED", 7)
    encoder, rng = PK.PieceEncoder(tokenizer_path, remembered=40), random.Random(3)
    signs = ["don't", "中文", "ΑΣ", "naïve", "x" * 120, "<|endoftext|>", "12½", "Σ", "\n\n", " \t", "ﬁ", "word", "été", "--"]
    texts = [rng.choice(["", " "]).join(rng.choice(signs) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for t, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    assert list(PK.batches_of(["a" * 30, None, "b" * 30, "c" * 80, ""])) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_costs_are_balanced():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 400, 400)
    room = PK.capacities(int(sizes.sum()), 2048, True)
    assert room.sum() == sizes.sum()
    pieces, over = PK.assign(sizes, room, 1.0, 1 / 2048)
    assert not over and sum(p[2] for p in pieces) == sizes.sum()
    cost = np.zeros(len(room))
    for i, _, n, s in pieces:
        cost[s] += n + n * n / 2048
    full = cost[room == 2048]
    assert full.max() / full.min() < 1.1


def test_packing_query(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    check_packing(QUERIES["op4_packing"](spark, SMALL).collect(), texts, tokenizer, 2048)


def test_language_query(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op6_language_id"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    words = {"en": "the of and with that from this".split(), "de": "der und nicht auf sch ung".split(), "fr": "le une que dans pour".split(), "es": "los una por con ción".split()}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(list(words) * 30)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 !?", "de"), (1003, "THE OF AND WITH", None), (None, "der und nicht auf", "de"), (1004, "und nicht " * 20000, None), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in LI.identify(df).collect()}
    assert got[1000] == got[1001] == got[1002] == ("und", 0.0)
    assert got[1003][0] == "en" and got[1004][0] == "de" and got[None][0] == "de"
    unlabelled = LI.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"} and len(unlabelled) == len(rows)
    assert LI.identify(df.limit(0)).count() == 0
    clash = df.withColumns({"_p": F.lit(1), "judged": F.lit(2), "JUDGED_": F.lit(3)})
    assert {r.doc_id: (r.lang_pred, r.lang_score, r._p, r.judged) for r in LI.identify(clash).collect()} == {d: (*v, 1, 2) for d, v in got.items()}
    # the label of a held-out row changes nothing
    flipped = df.withColumn("lang", F.when(LI.held_out("doc_id"), "fr").otherwise(F.col("lang")))
    assert {r.doc_id: (r.lang_pred, r.lang_score) for r in LI.identify(flipped).collect()} == got


def test_decontamination_sql(spark):
    compare(spark, QUERIES["op7_decontaminate"], ORACLES["op7_decontaminate"], SMALL)


BENCH = "The quick brown fox jumps over the lazy dog while seven wizards brew strong coffee nearby every morning"


def cases(spark):
    bench = spark.createDataFrame([(1, BENCH), (2, BENCH.upper()), (3, "Answer: forty-two"), (4, None), (5, "..."), (None, "zebra crossing ahead"), (7, "Éclair 2")], "item_id long, text string")
    rows = [(1, "x " * 50 + BENCH + " y" * 50), (2, " ".join(BENCH.split()[:12])), (3, "so ANSWER -- forty, two!"), (4, None), (5, ""), (6, "zebra crossing ahead"), (7, "éclair 2"), (8, "Éclair 2"), (8, "Éclair 2"), (9, "word " * 30000 + BENCH), (None, BENCH)]
    return spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, hits string"), bench


def test_decontamination_cases(spark, monkeypatch):
    docs, bench = cases(spark)
    read = lambda df: sorted((r.doc_id or 0, r.scan.n_words, r.scan.n_hit, tuple(r.scan.items)) for r in df.collect())
    got = read(DC.scan(docs, bench))
    n = len(BENCH.split())
    assert got == [(0, n, n, ("1", "2")), (1, 100 + n, n, ("1", "2")), (2, 12, 0, ()), (3, 4, 3, ("3",)), (4, 0, 0, ()), (5, 0, 0, ()), (6, 3, 0, ()), (7, 2, 0, ()), (8, 2, 2, ("7",)), (8, 2, 2, ("7",)), (9, 30000 + n, n, ("1", "2"))]
    # a benchmark too large to hold takes the joins
    assert read(DC.scan(docs, bench, max_windows=1)) == got
    kept = [r.doc_id for r in DC.drop_contaminated(docs, bench).collect()]
    assert sorted(kept) == [2, 4, 5, 6, 7, 9]
    cut = {r.doc_id: r.text for r in DC.remove_spans(docs, bench).collect()}
    assert cut[1] == "x " * 50 + "y" + " y" * 49 and cut[3] == "so " and cut[7] == "éclair 2"
    clash = docs.withColumns({c: F.lit(c) for c in ("scan", "found", "_row", "_text", "_found", "words", "items")})
    for most in (DC.MAX_WINDOWS, 1):
        assert read(DC.scan(clash, bench, max_windows=most)) == got and DC.scan(clash, bench, max_windows=most).columns == clash.columns
        for out in (DC.drop_contaminated(clash, bench, max_windows=most), DC.remove_spans(clash, bench, max_windows=most)):
            assert out.columns == clash.columns and {(r.scan, r.found, r._row, r._text) for r in out.collect()} == {("scan", "found", "_row", "_text")}
    assert DC.scan(docs.limit(0), bench).count() == 0
    assert all(r.scan.n_hit == 0 for r in DC.scan(docs, bench.limit(0)).collect())


def test_licences(spark):
    lines = {
        "Released under the MIT License.": ["MIT"], "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"], "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"],
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"], "All rights reserved.": ["proprietary"], "He renewed his driving license in May.": [], "The copyright of the song expired.": [], "no cue at all": [], "": [],
        "intro\nReleased under the MIT License.\nmore\nAll rights reserved.": ["MIT", "proprietary"],
    }
    rows = [(i, t, 1) for i, t in enumerate(lines)] + [(99, None, 1), (98, "filler " * 30000 + "\nReleased under the MIT License.", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, licences int")
    got = {r.doc_id: sorted(x.family for x in r.licences if x.confirmed) for r in LS.scan(df).collect()}
    assert [got[i] for i in range(len(lines))] == list(lines.values())
    assert got[99] == [] and got[98] == ["MIT"]


def confirmed(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: sorted({x.family for x in r.licences if x.confirmed}) for r in LS.scan(df).collect()}
    return [(t, got[i]) for i, t in enumerate(texts)]


def test_licences_of_every_template(spark):
    """Every notice, sentence and whole paragraph is found, with or without a cue."""
    rows = {t.text: [f] for f, ts in LS.templates().items() for t in ts}
    assert confirmed(spark, list(rows)) == list(rows.items())


def test_licences_near_a_family(spark):
    """Other versions, other licences and names without a version are none of the families."""
    want = {
        "Licensed under the Apache License, Version 1.1.": [], "It is free under the Apache License, Version 1.1": [], "Released under the BSD license.": [], "The code is under the BSD license": [],
        "SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0"], "// SPDX-License-Identifier: LGPL-2.1-only": ["LGPL-2.1"], "This work is licensed under CC BY-NC-ND 4.0.": ["CC-BY-NC-ND-4.0"],
        "This work is licensed under CC BY-NC-ND 3.0.": [], "Licensed under CC BY 2.5.": [], "Licensed under the Mozilla Public License, Version 1.0.": [], "Released under the GNU General Public License.": [],
        "Released under the GNU Lesser General Public License, version 2.1.": ["LGPL-2.1"], "This project is distributed under the terms of the GNU Affero General Public License, version 3.": ["AGPL-3.0"],
        "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": ["CC-BY-NC-SA-4.0"],
        "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 2.0 Generic License.": [],
    }
    assert confirmed(spark, list(want)) == list(want.items())


def test_licences_of_no_lookalike(spark):
    rows = [*LS.LOOKALIKES, *(n.format(name) for name in LS.NEAR for n in LS.NOTICES)]
    assert [x for x in confirmed(spark, rows) if x[1]] == []


def test_licences_whole_texts(spark):
    """Wrapped texts; what both licences share tells neither."""
    wrapped = lambda t: "\n".join(" * " + x for x in textwrap.wrap(t, 60))
    two, three = LS.TEXTS["BSD-2-Clause"][0], LS.TEXTS["BSD-3-Clause"][0]
    want = {wrapped(two): ["BSD-2-Clause"], wrapped(three): ["BSD-3-Clause"], two[:150]: [], wrapped(LS.TEXTS["MIT"][0]): ["MIT"], wrapped(LS.TEXTS["BSL-1.0"][0]): ["BSL-1.0"], wrapped(LS.TEXTS["Zlib"][0]): ["Zlib"]}
    assert confirmed(spark, list(want)) == list(want.items())


def test_licence_calibration_is_held_out():
    """No two training rows have equal words, and a held-out sentence's pattern has no row in the calibrating fit."""
    rows = LS.training_rows()
    assert len({tuple(LS.plain_words(t)) for t, _, _ in rows}) == len(rows)
    assert all(f == LS.UNKNOWN for _, f, g in rows if g >= 0)
    groups = defaultdict(set)
    for t, _, g in rows:
        if g >= 0:
            groups[g].add(len(t.split()))
    assert len(groups) == len(LS.LOOKALIKES) // LS.LOOKALIKE_WORDS and all(len(x) == 1 for x in groups.values())


def test_licences_over_several_lines(spark):
    """Notices wrapped over lines, also in comments; none is reported twice."""
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    texts = {
        "Released under the MIT\nLicense.": [(0, 1, "MIT")], "intro\n\n" + isc + "\n\nmore": [(2, 3, "ISC")], "# code\n#\n" + "\n".join("# " + x for x in isc.split("\n")): [(2, 3, "ISC")],
        "a title\r\n \r\nReleased under the CC\r\nBY 4.0.\r\n\r\nAll rights reserved.": [(2, 2, "CC-BY-4.0"), (5, 1, "proprietary")], "Released under the CC\n\nBY 4.0.": [], "\n\n": [],
        "intro\nReleased under the MIT License.\nmore": [(1, 1, "MIT")],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(x.paragraph, x.lines, x.family) for x in r.licences if x.confirmed] for r in LS.scan(df).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_licence_pairs_pattern(spark):
    """The pattern finds a pair of words exactly where ``grams`` has it."""
    texts = ["CC BY 4.0.", "xcc by", "cc -- by", "cc-by 4", "cc.by", "cc. by", "cc by-nc", "cc by.", "a-cc by", "a- cc by", "cc\nby", "by 4.0", "by 4.0.1", "by 4", "écc by", "cc byé", "CC (BY"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    known = ["cc by", "by 4.0"]
    got = df.select("t", F.rlike(F.lower("t"), F.lit(LS.pair_pattern(set(known)))).alias("a"), F.arrays_overlap(LS.grams(F.col("t")), F.array(*map(F.lit, known))).alias("b")).collect()
    assert {r.t for r in got if r.a} == {r.t for r in got if r.b} and {r.a for r in got} == {True, False}


def test_pipeline_stages(spark):
    """Each stage against a plain version of itself, on its own input."""
    import corpus_pipeline as CP
    from tests.llm.test_dedup import brute_components, brute_windows

    plan = dict(CP.STAGES)
    assert list(plan) == ["language_id", "near_duplicates", "repeated_passages", "contamination", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(spark.createDataFrame([(10**9, "123 456", "en", "s", 7), (10**9 + 1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    step = J_stored(plan["language_id"](spark, docs, SMALL))
    assert step.columns == CP.COLUMNS
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in step.collect()} == {10**9, 10**9 + 1}
    own = [(r.doc_id, r.text) for r in step.collect()]
    nxt = J_stored(plan["near_duplicates"](spark, step, SMALL))
    assert sorted(r.doc_id for r in nxt.collect()) == sorted(d for d, _, c in brute_components(own) if d == c)
    own = [(r.doc_id, r.text) for r in nxt.collect()]
    third = J_stored(plan["repeated_passages"](spark, nxt, SMALL))
    want = {d: t.split() for d, _, _, t in brute_windows(own, 13)}
    assert {r.doc_id: r.text.split() for r in third.collect()} == want
    assert all(r.n_chars == len(r.text) for r in third.collect())
    fourth = J_stored(plan["contamination"](spark, third, SMALL))
    hit = DC.scan(third, spark.read.parquet(f"{SMALL}/benchmark.parquet")).filter(DC.is_contaminated(F.col("scan.n_hit"), F.col("scan.n_words"))).select("doc_id")
    assert fourth.count() == third.count() - hit.count()
    from tokenizers import Tokenizer

    import public_tokenizers

    check_packing(plan["packing"](spark, fourth, SMALL).collect(), {r.doc_id: r.text for r in fourth.collect()}, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 2048)


def J_stored(df):
    from kickmill.llm.tables import stored

    return stored(df, "test")


def test_many_items_of_one_text(spark):
    """Items count, not windows alone: 3,000 of one text go to the join path when fewer may be held, and all are reported."""
    bench = spark.createDataFrame([(f"i{i:05d}", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen") for i in range(3000)] + [("z", "short item")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight nine ten eleven twelve thirteen fourteen y"), (2, "a short item b"), (3, "clean"), (4, None)], "doc_id long, text string")
    want = None
    for most in (10_000, 500):
        got = {r.doc_id: (r.scan.n_words, r.scan.n_hit, len(r.scan["items"]), r.scan["items"][:2]) for r in DC.scan(docs, bench, max_windows=most).collect()}
        assert got == {1: (16, 14, 3000, ["i00000", "i00001"]), 2: (4, 2, 1, ["z"]), 3: (1, 0, 0, []), 4: (0, 0, 0, [])}
        assert want in (None, got)
        want = got


def test_many_languages_are_bounded(spark, monkeypatch):
    from kickmill.llm import language_id as LI

    monkeypatch.setattr(LI, "MOST_LABELS", 5)
    rows = [(i, f"word{i % 7} of language{i % 40} again", f"l{i % 40:02d}" if i % 40 < 5 or i % 3 else "l00") for i in range(900)] + [(5000 + i, "z" * 300_000, "long") for i in range(3)]
    sample = LI.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 250)
    assert len({lang for _, lang in sample}) == 5 and "long" not in {lang for _, lang in sample}
