import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kickmill.functions import goals as G
from kickmill.functions import names as N
from kickmill.functions import odds as O
from kickmill.functions import parse as P
from kickmill.operators import goalmodel as GM
from kickmill.operators import mapping as MP


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_numbers_and_dates(spark):
    whole = [P.whole_number(F.lit(x)) for x in ("2", "2.0", "2.5", "-1", "nan", "inf", "", None)]
    assert one(spark, *whole) == (2, 2, None, None, None, None, None, None)
    days = [P.day(F.lit(x)) for x in ("16/08/2025", "16/08/25", "05/02/99", "2025-08-16", "soon", None)]
    assert [str(x) for x in one(spark, *days)] == ["2025-08-16", "2025-08-16", "1999-02-05", "2025-08-16", "None", "None"]
    assert one(spark, *[P.time_of_day(F.lit(x)) for x in ("13:30", "9:05:00", "25:00", "noon")]) == ("13:30", "09:05", None, None)


def test_kickoff_is_utc_and_never_midnight(spark):
    date = F.lit("2025-08-16").cast("date")
    timed, untimed = one(spark, P.kickoff_utc(date, F.lit("13:30")), P.kickoff_utc(date, F.lit(None).cast("string")))
    assert str(timed) == "2025-08-16 11:30:00" and untimed is None
    key = P.dedupe_key(F.lit("E0"), F.lit(1), F.lit(2), date, F.lit(None).cast("timestamp_ntz"))
    assert one(spark, key) == ("E0|1|2|2025-08-16|NA",)


def test_names(spark):
    given = ["  Köln FC. ", "SAINT-ÉTIENNE", "Real  Madrid", None, ""]
    rows = spark.createDataFrame([(x,) for x in given], "n string").select(N.normalized(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["koln fc", "saint etienne", "real madrid", None, ""]
    assert N.closest("real madridd", ["real madrid", "arsenal"])[0] == "real madrid"
    assert N.closest("arsenal", ["aston villa"]) is None


@pytest.mark.parametrize("method", ["proportional", "power", "shin"])
@pytest.mark.parametrize("odds", [[1.90, 3.60, 4.20], [1.85, 1.95], [1.30, 5.50, 11.00]])
def test_fair_probabilities(spark, method, odds):
    p = one(spark, O.devig(method, F.array(*[F.lit(1 / o) for o in odds])))[0]
    assert sum(p) == pytest.approx(1, abs=1e-9)
    assert sorted(p, reverse=True) == p if odds == sorted(odds) else True


def test_fair_books_and_longshots(spark):
    for method in O.devig_methods():
        assert one(spark, O.devig(method, F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))))[0] == pytest.approx([0.5, 0.3, 0.2])
        assert one(spark, O.devig(method, F.array(F.lit(1 / 1.9), F.lit(1 / 1.9))))[0] == pytest.approx([0.5, 0.5])
    raw = F.array(*[F.lit(1 / o) for o in (1.30, 5.50, 11.00)])
    flat, shin, power = one(spark, *[O.devig(m, raw) for m in ("proportional", "shin", "power")])
    assert shin[2] < flat[2] and power[2] < flat[2]
    with pytest.raises(KeyError):
        O.devig("none", raw)
    with pytest.raises(ValueError):
        O.register_devig("shin")(lambda v: v)
    # three quotes of 1.01 have no power below the bracket's end
    assert one(spark, O.devig("power", F.array(*[F.lit(1 / 1.01)] * 3)))[0] is None


def test_low_score_correction(spark):
    lam, mu, rho = F.lit(2.0), F.lit(0.5), F.lit(0.2)
    got = one(spark, *[G.tau(F.lit(x), F.lit(y), lam, mu, rho) for x, y in ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0))])
    assert got == pytest.approx((0.8, 1.10, 1.40, 0.8, 1.0))


def test_collapsed_grid_equals_its_cells(spark):
    from kickmill.operators.goalmodel import grid_sums

    rates = [(1.4, 0.9, 0.15), (0.6, 2.2, -0.1), (3.0, 2.5, 0.0), (1.3, 1.1, 0.9)]
    df = spark.createDataFrame(rates, "lam double, mu double, rho double")
    got = [r[0] for r in df.select(G.collapsed(F.col("lam"), F.col("mu"), F.col("rho"))).collect()]
    want = grid_sums(*np.array(rates).T)
    for g, w in zip(got, want):
        assert tuple(g) == pytest.approx(tuple(w), abs=1e-12)
    cells = G.score_grid(df).groupBy("lam").agg(F.sum("w").alias("t"), F.sum(F.expr("IF(x > y, w, 0)")).alias("h")).collect()
    for r in cells:
        assert r.h / r.t == pytest.approx(next(w[0] for w, q in zip(want, rates) if q[0] == r.lam), abs=1e-12)


def test_profiles(tmp_path):
    p = MP.SEASON_FILES
    assert len(p.odds_columns) == 39 and len(p.league_code_map) == 18
    core = MP.core_columns(p)
    assert MP.fit(p, [*core, *p.odds_columns]).score == pytest.approx(1.0)
    assert MP.fit(p, [f" {c} " for c in core]).score == pytest.approx(0.7)
    assert MP.fit(p, core[:3]).score == pytest.approx(0.4 * 3 / 6) and MP.fit(p, core[:3]).missing == core[3:]
    assert MP.detect_profile(["x"]) == (None, 0.0)
    own = MP.parse_profile('{"name": "n", "source_name": "s", "date_col": "d", "home_col": "h", "away_col": "a", "fthg_col": "x", "ftag_col": "y", "fixed_league": ["k", "K", "C"], "odds_columns": {"O": {"bookmaker": "b", "market": "1x2", "selection": "home"}}}')
    assert own.odds_columns["O"].price_point is None and own.fixed_league == ("k", "K", "C")
    (tmp_path / "p.json").write_text('{"name": "n", "source_name": "s", "date_col": "d", "home_col": "h", "away_col": "a", "fthg_col": "x", "ftag_col": "y"}')
    assert MP.load_profile(tmp_path / "p.json").odds_columns == {} and MP.load_profile(str(tmp_path / "p.json")).fixed_league is None
    assert math.isclose(MP.fit(own, ["d", "h", "a", "x", "y", "O"]).score, 1.0)


def test_dates_are_read_once_a_text(spark):
    day = lambda x, first=True: None if (n := P.days_of(x, first)) is None else str(np.datetime64(n, "D"))
    for text, want in (("29/02/72", "1972-02-29"), ("29/02/70", None), ("0005/06/2020", "2020-06-05"), ("-2020-01-05", "-2020-01-05"), (" 5 Sept. 99 ", "1999-09-05"), ("20191399", None), ("2020 5 jan", "2020-01-05"), ("jan feb 5 2020", None), ("1st may 2020, 2pm\r", "2020-05-01")):
        assert day(text) == want
    assert (day("05/13/2020"), day("05/06/2020", False), day("13/06/2020", False)) == ("2020-05-13", "2020-05-06", "2020-06-13")
    rows = spark.createDataFrame([("5 jan 2020",)] * 3 + [(None,), ("nan",)], "t string").coalesce(1).select(P.day(F.col("t")).alias("d"))
    assert [r.d and str(r.d) for r in rows.collect()] == ["2020-01-05"] * 3 + [None] * 2


def test_rates_that_are_alike_are_solved_once(monkeypatch):
    rows = np.array([[0.45, 0.27, -0.05], [0.2, 0.3, 0.1], [0.4, 1e-9, 0.0]])
    calls = []
    misses = GM.rate_misses
    monkeypatch.setattr(GM, "rate_misses", lambda z, rho, target: calls.append(len(z)) or misses(z, rho, target))
    many = np.repeat(rows, 1000, 0)
    lam, mu = GM.solve_rates(*many.T)
    # three different rows; those solved leave, the impossible one stays
    assert max(calls) == 3 and calls[-1] == 1
    sums = GM.grid_sums(lam[[0, 1000]], mu[[0, 1000]], rows[:2, 2])
    assert np.allclose(sums[:, :2], rows[:2, :2], atol=1e-12) and np.isnan(lam[2000:]).all() and len(set(lam[:1000])) == 1


def test_slopes_of_the_grid():
    z, rho = np.log([[1.3, 1.1], [0.2, 3.0], [2.0, 2.0]]), np.array([0.1, -0.3, 0.9])
    f, slope = GM.rate_misses(z, rho, np.zeros((3, 2)))
    assert np.allclose(f, GM.grid_sums(*np.exp(z.T), rho)[:, :2], atol=1e-13)
    for j in range(2):
        d = np.zeros(2)
        d[j] = 1e-6
        assert np.allclose(slope[:, :, j], (GM.rate_misses(z + d, rho, 0)[0] - GM.rate_misses(z - d, rho, 0)[0]) / 2e-6, atol=1e-8)


def test_equal_prices_are_solved_once(spark, monkeypatch):
    import pandas as pd

    calls = []
    solve = O._solver(lambda p: calls.append(len(p)) or O.solve_shin(p)).func
    out = solve(pd.Series([[0.5, 0.3, 0.28], None, [0.6, 0.5], [0.5, 0.3, 0.28], [0.5, -1.0, 0.2]] * 50))
    assert sum(calls) == 2 and list(out.isna()[:5]) == [False, True, False, False, True]
    assert list(out[0]) == list(out[3]) and abs(sum(out[0]) - 1) < 1e-9
