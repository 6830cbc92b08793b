"""Similar names and the growing pool against plain versions that compare every name with all of the pool."""

import difflib
import random

import pytest

from kickmill.functions import names as N
from kickmill.operators import reconcile as RC
from kickmill.operators.similar import first_come, similar_pairs
from kickmill.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def plain_pairs(names, pool, cutoff):
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    return sorted((n, c, ratio(c, n), round(ratio(n, c), 4)) for n in set(names) for c in set(pool) if n != c and ratio(c, n) >= cutoff)


def plain_resolution(seen, teams, aliases, cutoff):
    """seen: (row, side, raw, normal); one name after another."""
    pool, next_id, done, out = dict(teams), max([0, *teams.values()]) + 1, set(), []
    for _, _, raw, normal in sorted(seen):
        if normal in done:
            continue
        done.add(normal)
        if normal in pool:
            out.append((normal, pool[normal], "exact", raw, normal, 1.0))
        elif normal in aliases:
            out.append((normal, aliases[normal][0], "alias", raw, normal, aliases[normal][1]))
        elif found := N.closest(normal, list(pool), cutoff):
            out.append((normal, pool[found[0]], "fuzzy", raw, *found))
        else:
            out.append((normal, next_id, "created", raw, normal, 1.0))
            pool[normal] = next_id
            next_id += 1
    return sorted(out)


def like(r, name):
    """The name with a few changes."""
    for _ in range(r.choice([0, 1, 1, 2, 3])):
        i = r.randrange(len(name) + 1)
        name = r.choice([name[:i] + name[i + 1 :], name[:i] + r.choice("abcé ") + name[i:], name[: i - 1] + name[i : i + 1] + name[i - 1 : i] + name[i + 1 :] if i else name])
    return name


def family(r, n, letters, longest=40):
    out = ["".join(r.choices(letters, k=r.randint(0, longest))) for _ in range(n // 4)]
    return out + [like(r, r.choice(out)) for _ in range(n - len(out))]


@pytest.mark.parametrize("cutoff", [0.92, 0.7, 0.5, 1.0])
def test_pairs_equal_brute_force(spark, cutoff):
    r = random.Random(int(cutoff * 100))
    names = family(r, 120, "abcdefghé ") + family(r, 40, "ab", 12) + ["", "a", "abc" * 90, "abc" * 89 + "ab"]
    pool = family(r, 40, "abcdefgh ") + [like(r, x) for x in names[:60]]
    frame = lambda x: spark.createDataFrame([(n, "x", 1) for n in [*x, None]], "name string, candidate string, n int")
    got = sorted(map(tuple, similar_pairs(frame(names), frame(pool), cutoff).collect()))
    assert got == [p for p in plain_pairs(names, pool, cutoff) if p[0] and p[1]] and (got or cutoff == 1.0)


def test_pairs_of_odd_inputs(spark):
    none = spark.createDataFrame([], "name string")
    assert similar_pairs(none, none).count() == 0
    with pytest.raises(ValueError):
        similar_pairs(none, none, 0)


@pytest.mark.parametrize("seed", range(2))
def test_growing_pool_equals_one_after_another(spark, seed):
    r = random.Random(seed)
    names = family(r, 150, "abcdef ", 16)
    # a chain in which each name resembles the one before
    chain = ["m" * 20 + "".join("xyz"[(i >> k) % 3] for k in range(5)) for i in range(20)]
    names = [" ".join(n.split()) for n in names] + chain
    r.shuffle(names)
    teams = {n: 10 + i for i, n in enumerate(dict.fromkeys(names[:12]))}
    aliases = {n: (11, 0.95) for n in dict.fromkeys(names[12:20]) if n not in teams}
    seen = [(r.randint(0, 400), r.randint(0, 1), n.upper(), n) for n in names * 2]
    seen = list({(row, side): (row, side, raw, n) for row, side, raw, n in seen}.values())
    got = RC.resolve_names(spark.createDataFrame(seen, "row_index long, side int, raw string, normal string"), spark.createDataFrame([(i, n) for n, i in teams.items()], "id long, normalized_key string"),
                           spark.createDataFrame([(t, n, c) for n, (t, c) in aliases.items()], "team_id long, normalized_alias string, confidence double"), 0.9)
    got = sorted((x.normal, x.team_id, x.kind, x.raw, x.matched_key, x.confidence) for x in got.collect())
    assert got == plain_resolution(seen, teams, aliases, 0.9)
    assert {g[2] for g in got} == {"exact", "alias", "fuzzy", "created"}


def test_pool_of_a_long_chain(spark):
    n = 60
    places = spark.createDataFrame([(f"n{i}", i) for i in range(n)], "name string, place long")
    pairs = spark.createDataFrame([(f"n{i}", f"n{i - 1}") for i in range(1, n)] + [("n5", "stored")], "name string, candidate string")
    # n5 resembles a stored name, so n6 joins again
    want = {f"n{i}" for i in range(n) if i % 2 == 0}
    assert {r.name for r in first_come(places, pairs).collect()} == want


def test_client_queries_equal_brute_force(spark):
    clients = spark.read.parquet(f"{SMALL}/clients.parquet").select("client_id", "name").collect()
    seen = [(r.client_id, 0, r.name, N.normal_name(r.name)) for r in clients if r.name is not None and r.client_id is not None]
    names = [s[3] for s in seen]
    assert sorted(map(tuple, QUERIES["similar_names"](spark, SMALL).collect())) == [(a, b, round(x, 6), y) for a, b, x, y in plain_pairs(names, names, 0.92)]
    teams = {}
    for r in spark.read.parquet(f"{SMALL}/vendors.parquet").filter("name IS NOT NULL").orderBy("vendor_id").collect():
        teams[N.normal_name(r.name)] = r.vendor_id
    got = sorted((r.normal, r.team_id, r.kind, r.matched_key) for r in QUERIES["client_resolution"](spark, SMALL).collect())
    assert got == sorted((x[0], x[1], x[2], x[4]) for x in plain_resolution(seen, teams, {}, 0.92))


def test_candidates_that_cannot_be_alike_are_not_written(spark):
    """Names that share a chunk but few other characters stay inside the join."""
    r = random.Random(3)
    names = ["abcdef" + "".join(r.choices("ghijklmnopqrstuvwxyz", k=11)) for _ in range(200)]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = similar_pairs(frame, frame, 0.92)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "bit_count" in plan
    assert sorted(map(tuple, pairs.collect())) == plain_pairs(names, names, 0.92)
