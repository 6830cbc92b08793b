"""Substring, byte and near-duplicate operators against brute force, on texts with copies, shared passages and edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kickmill.llm import jaccard_join as J
from kickmill.llm.queries import QUERIES
from kickmill.llm.substring_dedup import dedup_substrings
from kickmill.llm.suffix_dedup import RunIndex, dedup_bytes, suffix_array

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed: int, n: int = 80) -> list[tuple]:
    """(doc_id, text): shared passages, copies, edits, very long and empty texts, nulls and repeated rows."""
    rng = random.Random(seed)
    words = ["the", "a", "of", "naïve", "été", "x", "Zeta", "42", "—"] + [f"w{i}" for i in range(200)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(12)]
    docs = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 6))]
        docs.append((i * 3 % n, rng.choice([" ", "\n", " \t "]).join(parts)))
    base = " ".join(rng.choice(words) for _ in range(300))
    for k in range(12):  # near copies
        own = base.split()
        for _ in range(k):
            own[rng.randrange(len(own))] = rng.choice(words)
        docs.append((500 + k, " ".join(own)))
    docs += [(600, base), (601, base), (602, ""), (603, None), (604, "  \n "), (605, "one"), (606, "One"), (607, "x " * 400), (608, " ".join(rng.choice(words) for _ in range(8000)))]
    docs += [(609, docs[5][1]), (609, docs[5][1]), (None, base), (None, None)]
    return docs


def frame(spark, docs):
    """With columns whose names clash with internal ones."""
    rows = [(i, t, 1, "c", 2.0, None) for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, chunk int, id string, bucket double, carry string")


def brute_windows(docs, k):
    least = {}
    for i, t in docs:
        w = WORD.findall(t or "")
        for a in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[a : a + k])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, t in docs:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if i is not None and least[tuple(w[a : a + k])] < i:
                gone[a : a + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,k", [(1, 13), (2, 13), (3, 4)])
def test_substrings(spark, seed, k):
    docs = corpus(seed)
    got = dedup_substrings(frame(spark, docs), k=k, carry=["chunk"])
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows), key=str) == brute_windows(docs, k)
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and r.chunk == 1


def test_substrings_with_colliding_hashes(spark):
    """With a first hash of 4 bits nearly all paths collide; the second hash and the words at the source decide."""
    docs = corpus(4)
    rows = dedup_substrings(frame(spark, docs), bits=4).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows), key=str) == brute_windows(docs, 13)


def test_what_differs_at_the_source_is_kept(spark, monkeypatch):
    """If both hashes fail, the words at the source coordinates don't agree and nothing is cut."""
    from kickmill.llm import substring_dedup as SD

    rng = random.Random(1)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    docs = [(1, text()), (2, text()), (3, text())]
    table = lambda i: pa.table({"id": pa.array([docs[i][0]], pa.int64()), "text": [docs[i][1]]})
    p = SD.Paths(table(1), 13)
    found = SD.Sources(np.ones(p.n, bool), np.zeros(p.n, np.int32), np.ones(p.n, np.int64), np.arange(p.n, dtype=np.int32))
    begin, end = p.chains(found)
    assert (begin.tolist(), end.tolist()) == ([0], [27])
    assert p.digests(begin, end) == [SD.digest(docs[1][1].encode().split())] != [SD.digest(docs[0][1].encode().split())]


def test_substrings_keep_separators(spark):
    text = "a b\n\nc  d e f"
    docs = spark.createDataFrame([(1, "x b\n\nc  d y"), (2, text), (3, "keep\nall  of this")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in dedup_substrings(docs, k=3, joined=False).collect()}
    assert got == {1: "x b\n\nc  d y", 2: "a e f", 3: "keep\nall  of this"}


def brute_bytes(texts, width):
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i : i + width] = 1
        gone = gone[: len(t)]
        edges = np.diff(np.concatenate(([0], gone, [0])))
        out.append((len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[gone == 0])).hexdigest()))
    return out


@pytest.mark.parametrize("seed,width", [(1, 400), (2, 100), (3, 30)])
def test_bytes(spark, seed, width):
    docs = corpus(seed) + [(700, "a" * 1500), (701, "ab" * 600)]
    got = dedup_bytes(frame(spark, docs), width=width).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    want = [(i, *b) for (i, _), b in zip(docs, brute_bytes([(t or "").encode() for _, t in docs], width))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_bytes_of_a_frequent_phrase(spark):
    """One phrase among many different heads and tails: its stretches are cut into items, and parts of them indexed one after another."""
    rng = random.Random(7)
    phrase, words = "".join(rng.choice("abcdefgh ") for _ in range(70)), ["".join(rng.choice("xyz") for _ in range(4)) for _ in range(3)]
    docs = [(i, "".join(rng.choice(words) for _ in range(rng.randint(5, 60))) + phrase + "".join(rng.choice(words) for _ in range(60)) + str(i % 7)) for i in range(150)]
    docs += [(1000, docs[0][1]), (1001, "é" * 400), (1002, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for width, part, uncut in ((100, 3000, 4), (400, 2000, 2)):
        got = dedup_bytes(df, width=width, part=part, uncut=uncut).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
        want = [(i, *b) for (i, _), b in zip(docs, brute_bytes([(t or "").encode() for _, t in docs], width))]
        assert sorted(map(tuple, got)) == sorted(want)


def test_stretches_of_equal_hashes_are_told_apart(monkeypatch):
    """A forced collision of the first hash: BLAKE2b still separates the stretches."""
    import pyarrow as pa

    from kickmill.llm import suffix_dedup as S

    table = pa.table({"text": ["a" * 100 + "b" * 400, "a" * 100 + "c" * 400]})
    own = S.Stretches(table, 400)
    assert len(set(own.second_hash().tolist())) == len(own.lead) > 1


def test_run_index():
    rng = np.random.default_rng(0)
    piece = rng.integers(97, 101, 300).astype(np.uint8)
    text = np.concatenate([piece, [255], piece[50:250], [255], rng.integers(97, 101, 100).astype(np.uint8), [255]]).astype(np.uint8)
    raw = text.tobytes()
    assert suffix_array(text).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    index = RunIndex(text, 512)
    assert index.length.sum() == len(text)
    got = index.matching_statistics()
    assert (index.restored() == text).all() and len(index.run) < len(text)

    def lcp(i, j):
        n = 0
        while max(i, j) + n < len(raw) and raw[i + n] == raw[j + n]:
            n += 1
        return n

    for i in range(0, len(raw), 7):
        assert got[i] == max(lcp(i, j) for j in range(len(raw)) if j != i)


def shingles(text, k=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(docs, percent=80):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in at[x] if j < i).items():
            if None not in (docs[i][0], docs[j][0]) and 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(docs)), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    docs = corpus(seed)
    got = J.jaccard_components(frame(spark, docs)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(docs)


def test_links(spark):
    """Every link between different sets, also inside a component."""
    rng = random.Random(11)
    own = [f"w{i}" for i in range(120)]
    docs = [*corpus(1), *((10**6 + i, " ".join(own[: 100 + rng.randint(0, 20)])) for i in range(15))]
    sets = {}
    for d, t in docs:
        if d is not None and shingles(t):
            sets[frozenset(shingles(t))] = min(d, sets.get(frozenset(shingles(t)), d))
    sets = sorted(((d, s) for s, d in sets.items()), key=lambda x: x[0])
    want = {(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if a != b and 100 * len(s & t) >= 80 * len(s | t)}
    got = [tuple(r) for r in J.jaccard_links(frame(spark, docs)).collect()]
    assert sorted(got) == sorted(want) and len({x for p in want for x in p}) <= len(want)


@pytest.mark.parametrize("easy", [0, 4])
def test_components_of_chains(spark, monkeypatch, easy):
    """A drifting family, whose ends are no longer alike, and families that share much but not enough."""
    monkeypatch.setattr(J, "EASY", easy)
    rng = random.Random(5)
    own = [f"c{i}" for i in range(200)]
    docs = []
    for k in range(60):
        docs.append((1000 - k, " ".join(own)))
        for _ in range(2):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
    shared = [f"s{i}" for i in range(100)]
    for k in range(40):
        docs.append((2000 + k, " ".join(shared + [f"f{k // 4}_{i}" for i in range(60)] + [f"g{k}"])))
    got = J.jaccard_components(frame(spark, docs)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(docs)


def test_empty_table(spark):
    none = frame(spark, [])
    assert dedup_substrings(none).count() == dedup_bytes(none).count() == J.jaccard_components(none).count() == 0


def test_queries_on_small_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op2_substring_dedup"](spark, SMALL).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in brute_windows(docs, 13)), key=str)
    got = QUERIES["op3_suffix_dedup"](spark, SMALL).collect()
    assert sorted(map(tuple, got)) == sorted((i, *b) for (i, _), b in zip(docs, brute_bytes([(t or "").encode() for _, t in docs], 400)))
    got = QUERIES["op10_jaccard_join"](spark, SMALL).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(docs)


def test_repeated_ids_with_different_texts(spark):
    """Equal ids of unlike documents join no groups, and of a group one row stays."""
    import corpus_pipeline as CP

    rng = random.Random(3)
    t, u, v = (" ".join(f"{c}{rng.randrange(900)}" for _ in range(40)) for c in "tuv")
    rows = [(3, t, "en", "s", 1), (5, t, "en", "s", 1), (5, u, "en", "s", 1), (5, u, "de", "a", 1), (5, v, "en", "s", 1), (7, v, "en", "s", 1), (None, t, "en", "s", 1), (9, "", "en", "s", 0), (9, "", "en", "s", 0), (9, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = J.jaccard_components(df, carry=["lang"]).collect()
    by = {(r.doc_id, r.n_shingles > 0, r.component_id) for r in got}
    assert by == {(3, True, 3), (5, True, 3), (5, True, 5), (7, True, 5), (None, True, None), (9, False, 9)} and len(got) == len(rows)
    assert len({r.group_id for r in got if r.component_id == 5}) == 2
    clash = df.withColumns({"_n": F.lit(1), "times": F.lit(2), "sha": F.lit(3)})
    kept = sorted(((r.doc_id, r.text, r.lang) for r in CP.near_duplicates(spark, clash, SMALL).collect()), key=str)
    assert kept == sorted([(3, t, "en"), (5, u, "de"), (5, v, "en"), (None, t, "en"), (9, "", "en"), (9, "", "en"), (9, None, None)], key=str)
    assert CP.near_duplicates(spark, df.limit(0), SMALL).count() == 0


@pytest.mark.parametrize("few", [0, 10**5])
def test_components_of_links(spark, monkeypatch, few):
    """In one task or in rounds: the least node that can be reached."""
    rng = random.Random(few)
    edges = {tuple(rng.sample(range(200), 2)) for _ in range(150)} | {(300 + i, 301 + i) for i in range(40)}
    least = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame(sorted(edges), "a long, b long")
    got = (J.few_components if few else J.components)(df).collect()
    assert {r.node: r.comp for r in got} == least and len(got) == len(least)
