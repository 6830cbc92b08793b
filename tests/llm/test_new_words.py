"""Periodic runs, sessions and token files against plain Python versions."""

import hashlib
import random
import re
import struct
import zlib
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kickmill.llm import sessions as S
from kickmill.llm import token_files as T
from kickmill.llm.byte_pieces import ByteEncoder
from kickmill.llm.periodic_runs import op11_periodic_runs, periodic_runs, planted, runs_of
from kickmill.llm.tables import folder

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# --- periodic runs --------------------------------------------------------------------------------------


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def plain_runs(words, least=6, times=4):
    """All maximal stretches of each period, kept where it is their smallest."""
    found = []
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q) and smallest_period(words[i : j + q]) == q:
                found.append((i, j - i + q, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    r = random.Random(11)
    for _ in range(400):
        texts = []
        for _ in range(r.randint(0, 6)):
            words = r.choices("abc"[: r.randint(1, 3)], k=r.randint(0, 30))
            for _ in range(r.randint(0, 3)):
                words += r.choices("abcd", k=r.randint(1, 4)) * r.randint(1, 9) + r.choices("ab", k=r.randint(0, 2))
            texts.append(words)
        assert runs_of(texts, 6, 4) == [plain_runs(w) for w in texts]


def test_long_runs_are_found_once():
    texts = [["a"] * 5000, list("ab") * 3000 + ["c"] + list("abc") * 900, [str(i) for i in range(3000)] * 5]
    assert runs_of(texts, 6, 4) == [[(0, 5000, 1)], [(0, 6000, 2), (5998, 2703, 3)], [(0, 15000, 3000)]]


def test_op11_equals_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in op11_periodic_runs(spark, SMALL).collect()}
    assert got.keys() == docs.keys() and any(r.n_runs for r in got.values())
    for doc, text in docs.items():
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        want = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
        assert tuple(got[doc])[1:] == want, doc


def test_periodic_runs_of_odd_rows(spark):
    long = "x y " * 40000
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a " * 6, 0), (3, "b b b b b b", 1), (3, "b b b b b b", 1), (4, long, 2)], "id long, body string, runs int")
    rows = periodic_runs(df, "id", "body").collect()
    assert sorted((r.id or 0, r.n_words, len(r.runs), r.body) for r in rows) == [(0, 6, 1, "a"), (1, 0, 0, ""), (2, 0, 0, ""), (3, 6, 1, "b"), (3, 6, 1, "b"), (4, 80000, 1, "x y")]
    assert [tuple(x) for r in rows if r.id == 4 for x in r.runs] == [(0, 80000, 2)]
    assert periodic_runs(df.filter("id > 9"), "id", "body").count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, "id", "body", times=3)
    assert planted(None, ["a"]) == ["a"] and planted(5, []) == []


# --- sessions -------------------------------------------------------------------------------------------

START = datetime(2024, 1, 1)


def plain_sessions(rows, pause=15, oldest=60, lateness=15):
    """rows: (click, client, minutes, arrived minutes, final, cents)."""
    once = {}
    for r in rows:
        if None not in r[:3]:
            once[r[0]] = r
    out = []
    for client in sorted({r[1] for r in once.values()}):
        own = [r for r in once.values() if r[1] == client]
        late = [r for r in own if r[3] is not None and r[3] - r[2] > lateness]
        timely = sorted((r for r in own if r not in late), key=lambda r: (r[2], r[0]))
        found = []
        for r in timely:
            why = None
            if found:
                last, first = found[-1]["clicks"][-1], found[-1]["clicks"][0]
                why = "end" if last[4] else "gap" if r[2] - last[2] >= pause else "length" if r[2] - first[2] > oldest else None
                if why:
                    found[-1]["why"] = why
            if not found or why:
                found.append({"clicks": [], "why": None})
            found[-1]["clicks"].append(r)
        for k, s in enumerate(found):
            a, b = s["clicks"][0], s["clicks"][-1]
            until = found[k + 1]["clicks"][0][2] if k + 1 < len(found) else 10**9
            path = ",".join(str(r[0]) for r in s["clicks"])
            out.append((client, a[0], a[2], b[2], len(s["clicks"]), sum(a[2] <= r[2] < until for r in late), sum(r[5] or 0 for r in s["clicks"]), s["why"] or ("end" if b[4] else "none"), hashlib.sha256(path.encode()).hexdigest()))
    return sorted(out)


def clicks_frame(spark, rows):
    at = lambda m: None if m is None else START + timedelta(minutes=m)
    data = [(r[0], r[1], at(r[2]), at(r[3]), r[4], r[5], "x") for r in rows]
    return spark.createDataFrame(data, "click_id long, client_id long, ts timestamp_ntz, arrived_at timestamp_ntz, fin boolean, cents long, cell string").repartition(3)


def sessions_of(spark, rows, **more):
    base = S.sessions(clicks_frame(spark, rows), F.col("fin"), F.col("cents"), **more)
    zero = int((START - datetime(1970, 1, 1)).total_seconds()) // 60
    return sorted((r.client_id, r.session_id, r.start_us // S.MINUTE - zero, r.end_us // S.MINUTE - zero, r.n_clicks, r.n_late, r.value_cents, r.closed_by, r.path_sha256) for r in base.collect())


@pytest.mark.parametrize("seed", range(4))
def test_sessions_equal_a_plain_machine(spark, seed):
    r = random.Random(seed)
    rows = []
    for click in range(700):
        t = r.randint(-3000, 3000) if r.random() < 0.4 else r.randint(-100, 250)
        client = r.choice([1, 1, 1, 2, 3, None]) if r.random() < 0.9 else r.randint(4, 40)
        rows.append((click if r.random() < 0.99 else None, client, t if r.random() < 0.98 else None, r.choice([None, t, t + 15, t + 16, t + 500]), r.choice([True, None, *[False] * 40]), r.choice([None, 1, 250])))
    rows += rows[::7]
    want = plain_sessions(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a session reaches across batches
    try:
        assert sessions_of(spark, rows) == want
        assert sessions_of(spark, rows, hour=5 * S.MINUTE) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert {w[7] for w in want} == {"end", "gap", "length", "none"}


def test_a_client_without_pause_and_rows_of_one_time(spark):
    rows = [(i, 7, i * 3, i * 3, False, 1) for i in range(2000)]  # 100 hours without a cut
    rows += [(5000 + i, 8, 100, 100, i in (3, 6), 2) for i in range(9)] + [(6000, 8, 100, 200, False, 5), (6001, 9, 0, 100, False, 5)]
    want = plain_sessions(rows)
    assert sessions_of(spark, rows) == want
    assert [w[5] for w in want if w[0] == 8] == [0, 0, 1] and not [w for w in want if w[0] == 9]
    assert sessions_of(spark, [(1, None, 3, 3, False, 1)]) == []


def test_zone_of_the_session_plays_no_part(spark):
    rows = [(1, 1, 0, 0, False, 1), (2, 1, 5, 5, False, 1)]
    want = sessions_of(spark, rows)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sessions_of(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# --- token files ----------------------------------------------------------------------------------------

ODD = ["'s", "'re", "'ll", "'v", "'", " ", "  ", "\n", "\t", "a", "re", "ve", "t", "D", "é", "ß", "1", "½", "!", "...", "\xa0", "　", "\x85", "\x1c", "́", "中", "😀", "ǅ", "​", "\x00", "<|endoftext|>", "'T", "’s"]


@pytest.fixture(scope="module")
def byte_tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_the_tokenizers(byte_tokenizer, monkeypatch):
    import kickmill.llm.byte_pieces as B

    e, r = ByteEncoder(byte_tokenizer, remembered=300), random.Random(13)
    for k in range(3000):
        texts = ["".join(r.choices(ODD[: None if k % 9 == 0 else 30], k=r.randint(0, 12))) for _ in range(r.randint(1, 4))]
        assert [x.tolist() for x in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts], texts
    plain = np.flatnonzero(B.classes() != B.ODD)
    for c in [*plain[:3000].tolist(), *r.sample(plain.tolist(), 3000)]:
        t = "a{0}b 1{0}2 .{0}, {0} {0}{0}'s".format(chr(c))
        assert e.encode([t])[0].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, hex(c)
    monkeypatch.setattr(B, "TOGETHER", 50)
    for _ in range(300):
        t = "".join(r.choices(ODD[:30], k=200))
        assert e.encode(["a", t, ""])[1].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def plain_tokens(path, rows):
    """{(id, text): [(start, n, crc), ...]} in ascending order of id, null ones first."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    start, out = 0, []
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_op13_equals_plain_version(spark, byte_tokenizer):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, T.op13_token_files(spark, SMALL).collect())) == plain_tokens(byte_tokenizer, docs)


def test_token_files_of_odd_rows(spark, byte_tokenizer):
    rows = [(None, None, 0), (None, "null id", 0), (3, "", 1), (3, "", 2), (5, "long " * 60000, 3), (-2, "first", 4), *[(9, "same", 5)] * 200, *[(100 + i, f"text {i} of many", 6) for i in range(300)]]
    df = spark.createDataFrame(rows, "k long, body string, start int").repartition(5)
    path = folder(spark, "tokens-test")
    T.write_token_files(df, path, byte_tokenizer, 2, "k", "body", part_bytes=4000, file_bytes=3000)
    got = [tuple(r) for r in T.read_token_files(spark, path, read_bytes=500).select("id", "start", "n_tokens", F.crc32("ids")).orderBy("start").collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [g[0] for g in got] == [r[0] for r in order] and sum(g[2] for g in got) == got[-1][1] + got[-1][2]
    assert [g[1] for g in got] == np.append(0, np.cumsum([g[2] for g in got]))[:-1].tolist()
    want = plain_tokens(byte_tokenizer, [r[:2] for r in order])
    assert sorted((g[0] or 0, g[2], g[3]) for g in got) == sorted((w[0] or 0, w[2], w[3]) for w in want)
    assert spark.read.parquet(f"{path}/manifest").count() > 3
    wanted = spark.createDataFrame([(9,), (9,), (150,), (7,), (None,), (-2,)], "k long")
    found = sorted((r.id, r.start, r.n_tokens) for r in T.find_documents(wanted, path, "k").collect())
    assert found == sorted(g[:3] for g in got if g[0] in (9, 150, -2)) and len(found) == 202


def test_empty_token_files_and_another_dictionary(spark, byte_tokenizer, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    path = folder(spark, "tokens-empty")
    T.write_token_files(empty, path, byte_tokenizer, 2)
    assert T.read_token_files(spark, path).count() == 0 and T.find_documents(empty, path).count() == 0
    with open(tmp_path / "f", "wb") as out:
        w = T.TokenWriter(out, b"one dictionary, not trained", 4)
        w.add(None, np.array([70000, 1], np.uint32))
        w.add(4, np.array([5], np.uint32))
        w.close()
    with open(tmp_path / "f", "rb") as source:
        f = T.TokenFile(source, w.size, b"one dictionary, not trained")
        assert f.document(0).tolist() == [70000, 1] and f.places(4) == [1] and f.places(0) == []
        with pytest.raises(ValueError):
            T.TokenFile(source, w.size, b"another")
        with pytest.raises(ValueError):
            T.TokenFile(source, w.size - 1, b"one dictionary, not trained")


def test_dictionary_pays():
    r = np.random.default_rng(5)
    base = r.integers(0, 50000, 400)
    parts = [T.serialized(np.concatenate([base[i : i + 40] for i in r.integers(0, 360, 30)]), 2) for _ in range(600)]
    import zstandard

    d = zstandard.ZstdCompressor(dict_data=T.dictionary_of(T.trained(parts[:500], 1 << 14)))
    assert sum(len(d.compress(p)) for p in parts[500:]) < 0.7 * sum(len(zstandard.ZstdCompressor().compress(p)) for p in parts[500:])


def test_machine_keeps_an_open_session_over_batches():
    cols = ["client", "stretch", "us", "late", "click", "final", "cents", "client_ends"]
    rows = [(1, 1, 0, False, 1, False, 5, 30), (1, 1, 10, False, 2, False, 5, 30), (1, 1, 30, True, 9, False, 5, 30), (1, 1, 30, False, 3, True, 5, 30)]
    for cut in range(5):
        parts = [pd.DataFrame(x, columns=cols).astype({"late": bool, "final": bool}) for x in (rows[:cut], rows[cut:])]
        got = pd.concat(list(S.machine(iter(parts), 20)))
        assert got[["session_id", "n_clicks", "n_late", "closed_by"]].values.tolist() == [[1, 2, 1, "length"], [3, 1, 0, "end"]]


def test_op12_equals_sql(spark):
    from tests.oracle import compare

    compare(spark, S.op12_gap_sessions, S.OP12_SQL, SMALL)
