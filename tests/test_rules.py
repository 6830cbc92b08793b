"""The import rules against a plain version that takes one row after another; linked groups against union-find."""

import math
import random
from datetime import datetime

import pytest

from kickmill.operators import reconcile as RC
from kickmill.plans.queries import _empty_store

QUOTE = "struct<bookmaker:string,market:string,selection:string,decimal_odds:double,line:double,price_point:string>"
ROWS = f"row_index long, pairing string, league_key string, home_team_id long, away_team_id long, match_date date, kickoff_utc timestamp_ntz, ft_home int, ft_away int, ht_home int, ht_away int, dedupe_key string, external_id string, warnings array<string>, odds array<{QUOTE}>"


def plain(rows, matches, odds, sources, last):
    """rows: dicts in order; what becomes of each, in order."""
    matches, sources, out, held = [dict(m) for m in matches], dict(sources), [], {}
    identity = lambda q: (*q[:3], *q[4:])
    for match_id, *q in odds:
        held.setdefault(match_id, {}).setdefault(identity(q), q[3])
    for r in rows:
        note, target, outcome, new, link = [], None, "duplicate", False, False
        exact = next((m for m in matches if m["key"] == r["key"]), None)
        siblings = [m for m in matches if m["pairing"] == r["pairing"]]
        if r["ext"] in sources:
            target = sources[r["ext"]]
        elif exact:
            if exact["score"] != r["score"]:
                outcome = "conflict"
            else:
                target = exact["id"]
        elif r["timed"] and len(siblings) == 1 and not siblings[0]["timed"]:
            siblings[0].update(timed=True, key=r["key"])
            target, outcome, link = siblings[0]["id"], "enriched", r["ext"] is not None
            note = ["date-only match enriched with its kickoff time"]
        elif not r["timed"] and siblings:
            target = siblings[0]["id"] if len(siblings) == 1 else None
        else:
            target, outcome, new, link = r["row"] + 1 + last, "imported", True, r["ext"] is not None
            matches.append({"id": target, "pairing": r["pairing"], "timed": r["timed"], "key": r["key"], "score": r["score"]})
        if link:
            sources[r["ext"]] = target
        added = []
        if target is not None:
            own = held.setdefault(target, {})
            before = dict(own)
            for q in r["odds"]:
                old = before.get(identity(q))
                if new or old is None:
                    added.append(q)
                    own.setdefault(identity(q), q[3])
                elif not math.isclose(old, q[3], rel_tol=1e-9, abs_tol=1e-9):
                    note.append(f"price conflict {q[0]}/{q[1]}/{q[2]}: kept {old}, not {q[3]}")
        out.append((r["row"], outcome, target, new, link, ["given", *note], added))
    return out


def scene(seed):
    r = random.Random(seed)
    pairings, ids = [f"p{i}" for i in range(r.choice([4, 25]))], [f"e{i}" for i in range(12)]
    hours = [None, None, 12, 18]
    key = lambda p, h: f"{p}@{h}"
    quote = lambda: ("b" + str(r.randint(0, 1)), "m", r.choice("hda"), r.choice([1.5, 2.0, 2.0 + 1e-12, 3.25]), r.choice([None, None, 0.5]), r.choice([None, "closing"]))
    matches = {}
    for p in pairings:
        for h in r.sample([None, 12, 18], r.choice([0, 0, 0, 1, 1, 2])):
            matches[key(p, h)] = {"id": 100 + len(matches), "pairing": p, "timed": h is not None, "key": key(p, h), "score": (r.randint(0, 1), 0), "hour": h}
    matches = list(matches.values())
    sources = {e: m["id"] for e, m in zip(ids[:3], matches)}
    odds = [(m["id"], *quote()) for m in matches for _ in range(r.randint(0, 4))]
    rows = []
    for i in range(120):
        p, h = r.choice(pairings), r.choice(hours)
        score = r.choice([(0, 0), (1, 0), (None, 0)]) if r.random() < 0.2 else (0, 0)
        rows.append({"row": 2 * i, "pairing": p, "timed": h is not None, "hour": h, "key": key(p, h), "ext": r.choice([None, None, r.choice(ids)]), "score": score, "odds": [quote() for _ in range(r.randint(0, 4))]})
    return rows, matches, odds, sources


@pytest.mark.parametrize("seed", range(4))
def test_rules_equal_one_row_after_another(spark, seed):
    rows, matches, odds, sources = scene(seed)
    at = lambda h: None if h is None else datetime(2024, 1, 1, h)
    frame = spark.createDataFrame([(x["row"], x["pairing"], x["pairing"], None, None, None, at(x["hour"]), *x["score"], None, None, x["key"], x["ext"], ["given"], x["odds"]) for x in rows], ROWS).repartition(3)
    # the stored pairing is made of league, teams and day: here the league alone
    stored = spark.createDataFrame([(m["id"], m["pairing"], None, None, None, at(m["hour"]), *m["score"], m["key"]) for m in matches], "id long, league_key string, home_team_id long, away_team_id long, match_date date, kickoff_utc timestamp_ntz, ft_home int, ft_away int, dedupe_key string")
    held = spark.createDataFrame([(i, *o) for i, o in enumerate(odds)], "id long, match_id long, bookmaker string, market string, selection string, decimal_odds double, line double, price_point string")
    ids = spark.createDataFrame([("test", e, m) for e, m in sources.items()] + [("other", "e9", 1)], "source string, external_id string, match_id long")
    got = RC.act(frame, _empty_store(spark) | {"matches": stored, "odds": held, "sources": ids}, "test", 1000).collect()
    got = sorted((x.row_index, x.outcome, x.match_id, x.new_match, x.add_source, x.warnings, [tuple(q) for q in x.new_odds]) for x in got)
    want = plain(rows, matches, odds, sources, 1000)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and sorted(a[5]) == sorted(b[5]) and a[6] == b[6], (a, b)
    assert len(got) == len(want)


def test_linked_groups_equal_union_find(spark):
    r = random.Random(4)
    rows = [(i, f"p{r.randint(0, 150)}", r.choice([None, f"e{r.randint(0, 90)}"])) for i in range(260)]
    rows += [(1000 + i, f"chain{(i + 1) // 2}", f"link{i // 2}") for i in range(300)] + [(2000 + i, f"star{i}", "hub") for i in range(100)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, p, e in rows:
        a, b = root(p), root(e if e is not None else p)
        parent[a] = b
    got = RC.linked_groups(spark.createDataFrame(rows, "row_index long, pairing string, external_id string")).collect()
    groups, want = {}, {}
    for x in got:
        groups.setdefault(x.group, set()).add(x.row_index)
    for i, p, _ in rows:
        want.setdefault(root(p), set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
