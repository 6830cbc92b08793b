import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kickmill.operators import dataset as D
from kickmill.operators import evidence as E
from kickmill.operators import features as X
from kickmill.operators import goalmodel as GM
from kickmill.operators import metrics as M
from kickmill.operators import splits as S
from kickmill.operators import tabular as T

day = datetime.date.fromisoformat


def test_scores(spark):
    sels = ("home", "draw", "away")
    df = spark.createDataFrame([(0.5, 0.3, 0.2, "home"), (0.2, 0.3, 0.5, "away")], "p_home double, p_draw double, p_away double, outcome string")
    got = df.agg(M.log_loss(sels), M.brier(sels)).first()
    assert got[0] == pytest.approx(math.log(2)) and got[1] == pytest.approx(0.38)
    M.check_outcomes(df, sels)
    with pytest.raises(ValueError):
        M.check_outcomes(df.withColumn("outcome", F.lit("x")), sels)


def test_calibration_edges(spark):
    df = spark.createDataFrame([(p, 1 - p, "a") for p in (0.3, 0.6, 0.5, 0.5)], "p_a double, p_b double, outcome string")
    bins = {r.bin: r.n for r in M.calibration(df, ("a", "b")).collect()}
    assert len(bins) == 10 and bins[2] == 1 and bins[5] >= 4 and bins[0] == 0
    half = spark.createDataFrame([(0.5, 0.5, o) for o in "abab"], "p_a double, p_b double, outcome string")
    assert M.calibration_error(M.calibration(half, ("a", "b"))).first()[0] == 0


def test_betting(spark):
    df = spark.createDataFrame([(0.6, 0.4, 2.0, 2.0, "home"), (0.1, 0.9, 5.0, 1.2, "away")], "p_home double, p_away double, o_home double, o_away double, outcome string")
    value = M.simulate(df, ("home", "away")).first()
    assert (value.n_bets, value.profit, value.roi) == (2, 1.2, 0.6)
    every = M.simulate(df, ("home", "away"), "bet_all").first()
    assert (every.n_bets, every.profit, every.threshold) == (4, -0.8, None)
    none = M.simulate(df.withColumn("o_home", F.lit(None).cast("double")).withColumn("o_away", F.lit(None).cast("double")), ("home", "away"), "bet_all").first()
    assert (none.n_bets, none.roi, none.threshold) == (0, None, 0.02)


def test_form(spark):
    rows = [(1, "A", "B", "2025-01-01", 2, 1), (2, "C", "A", "2025-01-08", 0, 0), (3, "A", "D", "2025-01-15", 1, 3), (4, "B", "A", "2025-01-22", 2, 2)]
    ids = {"A": 1, "B": 2, "C": 3, "D": 4}
    df = spark.createDataFrame([(k, ids[h], ids[a], day(d), x, y) for k, h, a, d, x, y in rows], "match_id long, home_team_id long, away_team_id long, match_date date, ft_home int, ft_away int")
    got = X.team_form(df).filter("match_id = 4").first()
    assert got.away_form_pts_last5 == pytest.approx(4 / 3) and got.away_form_gf_last5 == 1 and got.away_form_ga_last5 == pytest.approx(4 / 3) and got.away_form_n_last5 == 3
    assert (got.home_form_pts_last5, got.home_form_gf_last5, got.home_form_ga_last5, got.home_form_n_last5) == (0, 1, 2, 1)
    first = X.team_form(df).filter("match_id = 1").first()
    assert first.home_form_pts_last5 is None and first.home_form_n_last5 == 0
    # a later result changes nothing earlier
    changed = df.withColumn("ft_home", F.when(F.col("match_id") == 4, 9).otherwise(F.col("ft_home")))
    assert X.team_form(changed).exceptAll(X.team_form(df)).count() == 0


def test_splits_and_guard(spark):
    rows = [(i, "E0", day("2025-08-01") + datetime.timedelta(i)) for i in range(10)] + [(100 + i, "SP1", day("2025-09-01") + datetime.timedelta(i)) for i in range(6)] + [(200, None, day("2025-01-01"))]
    df = spark.createDataFrame(rows, "match_id long, league_key string, match_date date")
    split = S.FractionSplit(0.7).assign(df)
    train = {r[0]: r[1] for r in split.filter("split = 'train'").groupBy("league_key").count().collect()}
    assert train == {"E0": 7, "SP1": 5}
    S.assert_no_leakage(split, "league_key")
    with pytest.raises(AssertionError):
        S.assert_no_leakage(split.withColumn("split", F.when(F.col("split") == "train", "test").otherwise("train")), "league_key")
    with pytest.raises(ValueError):
        S.FractionSplit(1.0)
    # five rows in four parts make three blocks, so two folds
    folds = S.WalkForward(3).folds(df.limit(5)).select("fold").distinct().count()
    assert folds == 2
    # the cuts of sorted keys are those of the windows
    more = df.unionByName(df.filter("league_key = 'E0'").withColumn("match_id", F.col("match_id") + 50))
    frac = S.FractionSplit(0.45)
    assert sorted(map(tuple, frac.by_cuts(more).select("match_id", "split").collect())) == sorted(map(tuple, frac.by_window(more).select("match_id", "split").collect()))


def test_goal_fit_recovers_rates(spark):
    rng = np.random.default_rng(42)
    attack, defense = rng.normal(0, 0.25, 8), rng.normal(0, 0.2, 8)
    attack -= attack[0]
    rows = []
    for k in range(40):
        for h in range(8):
            for a in range(8):
                if h != a:
                    rows.append(("L", h, a, int(rng.poisson(math.exp(attack[h] + defense[a] + 0.25))), int(rng.poisson(math.exp(attack[a] + defense[h]))), day("2024-01-01") + datetime.timedelta(k)))
    df = spark.createDataFrame(rows, "league_key string, home_team_id long, away_team_id long, ft_home int, ft_away int, match_date date")
    fit = {r.team_id: r for r in GM.fit(df).collect()}
    for h in range(8):
        for a in range(8):
            if h != a:
                true = math.exp(attack[h] + defense[a] + 0.25)
                got = math.exp(fit[h].attack + fit[a].defense + fit[h].home_advantage)
                assert abs(got - true) / true < 0.2
    assert abs(fit[0].rho) < 0.15 and fit[0].attack == 0.0 and fit[0].n_matches == len(rows)
    out = GM.GoalPredictor(GM.fit(df)).predict(spark.createDataFrame([("L", 0, 1), ("L", 0, 99), ("M", 0, 1)], "league_key string, home_team_id long, away_team_id long"), "1x2").collect()
    by = {(r.league_key, r.away_team_id): r.p_home for r in out}
    assert by["L", 1] > 0 and by["L", 99] is None and by["M", 1] is None
    with pytest.raises(Exception, match="two teams"):
        GM.fit(spark.createDataFrame([("L", 1, 1, 0, 0)], "league_key string, home_team_id long, away_team_id long, ft_home int, ft_away int")).collect()


def test_gradient():
    rng = np.random.default_rng(1)
    h, a = rng.integers(0, 4, 200), rng.integers(0, 4, 200)
    x, y, w = rng.poisson(1.2, 200).astype(float), rng.poisson(1.0, 200).astype(float), rng.random(200)
    theta = rng.normal(0, 0.1, 9)
    _, g = GM.likelihood(theta, h, a, x, y, w, 4)
    for i in range(9):
        d = np.zeros(9)
        d[i] = 1e-6
        num = (GM.likelihood(theta + d, h, a, x, y, w, 4)[0] - GM.likelihood(theta - d, h, a, x, y, w, 4)[0]) / 2e-6
        assert num == pytest.approx(g[i], rel=1e-4, abs=1e-4)


def test_implied_rates_round_trip():
    lam, mu = np.meshgrid(np.linspace(0.4, 3.5, 12), np.linspace(0.4, 2.2, 9))
    lam, mu = lam.ravel(), mu.ravel()
    rho = np.full(len(lam), -0.03)
    p = GM.grid_sums(lam, mu, rho)
    got = GM.solve_rates(p[:, 0], p[:, 1], rho)
    assert np.abs(got[0] - lam).max() < 1e-6 and np.abs(got[1] - mu).max() < 1e-6
    bad = GM.solve_rates(np.array([0.99]), np.array([0.99]), np.array([0.0]))
    assert np.isnan(bad[0]).all()


def test_blend(spark):
    base, other = (0.5, 0.3, 0.2), (0.6, 0.25, 0.15)
    cols = ", ".join(f"{p}_{s} double" for p in ("base", "f", "r") for s in ("home", "draw", "away"))
    df = spark.createDataFrame([(1, *base, *other, *other), (2, *base, None, None, None, *other), (3, None, 0.3, 0.2, *other, *other)], f"match_id long, {cols}")
    found = [E.Finding("f", "provisionally_promoted", "1x2"), E.Finding("r", "rejected", "1x2")]
    rows = {r.match_id: (r.p_home, r.p_draw, r.p_away) for r in E.blend(df, "1x2", found).collect()}
    logits = [math.log(b) + 0.25 * (math.log(o) - math.log(b)) for b, o in zip(base, other)]
    total = sum(map(math.exp, logits))
    assert rows[1] == pytest.approx([math.exp(v) / total for v in logits])
    assert rows[2] == pytest.approx(base) and rows[3] == (None, None, None)
    assert E.live(E.FINDINGS, "1x2") == []
    with pytest.raises(KeyError):
        E.weight(E.Finding("x", "famous", "1x2"))
    log = E.predictions_log(E.explain(df.filter("match_id < 3"), "1x2", found), "1x2", found)
    assert log.count() == 24 and log.columns == list(E.LOG_COLUMNS)


def test_features_are_allowed_by_name_only(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0)], "match_id long, home_form_pts_last5 double, secret double")
    assert X.resolve_columns(df, ["team_form"]) == ["home_form_pts_last5"]
    with pytest.raises(KeyError):
        X.resolve_columns(df, ["all"])
    with pytest.raises(ValueError):
        X.resolve_columns(df, ["odds_core"])
    with pytest.raises(ValueError):
        X.register_feature_group("team_form")(lambda f: f)


def test_tabular(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        x = rng.normal()
        rows.append((i, "E0" if i % 2 else "E1", float(x) if i % 7 else None, None, "train" if i < 300 else "test", "home" if x + rng.normal(0, 0.5) > 0.3 else "away" if x < -0.3 else "draw"))
    df = spark.createDataFrame(rows, "match_id long, league_key string, home_form_pts_last5 double, home_form_gf_last5 double, split string, target_1x2 string")
    model = T.TabularPredictor(["team_form"]).fit(df, ["1x2"])
    assert "home_form_gf_last5" not in model.stats
    out = model.predict(df.filter("split = 'test'").unionByName(df.limit(1).withColumn("league_key", F.lit("ZZ"))), "1x2").collect()
    known = [r for r in out if r.league_key != "ZZ"]
    hits = sum(max(("home", "draw", "away"), key=lambda s: r[f"p_{s}"]) == r.target_1x2 for r in known)
    assert hits / len(known) > 0.6
    assert next(r for r in out if r.league_key == "ZZ").p_home is None
    assert model.predict(df.limit(1), "ou_2.5").first().p_over is None


def test_content_hash(spark):
    df = spark.createDataFrame([(1, 0.1, "a"), (2, -0.0, None)], "match_id long, v double, s string")
    same = df.orderBy(F.desc("match_id")).select("s", "v", "match_id")
    assert D.content_hash(df) == D.content_hash(same)
    assert D.content_hash(df) != D.content_hash(df.withColumn("v", F.col("v") + 1e-6))
    assert D.content_hash(df) != D.content_hash(df.fillna({"s": ""}))


def test_dataset_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.5), (1, None)], "match_id long, v double")
    manifest = D.save(df, f"file://{tmp_path}", extra={"mode": "test"})
    back = D.load(spark, manifest["path"])
    assert D.content_hash(back) == manifest["content_hash"] and manifest["rows"] == {"rows_total": 2}


REGISTRY = """{"schema_version": "1.0", "findings": [
  {"finding_id": "a", "tier": "provisionally_promoted", "market": "1x2", "extra_columns": ["x"], "description": "d", "retrospective_anchor": "notes#a"},
  {"finding_id": "b", "tier": "promoted", "market": "1x2", "extra_columns": [], "description": "", "retrospective_anchor": ""},
  {"finding_id": "c", "tier": "rejected", "market": "1x2", "extra_columns": [], "description": "", "retrospective_anchor": ""},
  {"finding_id": "e", "tier": "promoted", "market": "ou_2.5", "extra_columns": [], "description": "", "retrospective_anchor": ""}]}"""


def test_registry(tmp_path):
    (tmp_path / "r.json").write_text(REGISTRY)
    found = E.load_registry(tmp_path / "r.json")
    assert [E.weight(f) for f in found] == [0.25, 1.0, 0.0, 1.0] and found[0].retrospective_anchor == "notes#a"
    assert [f.finding_id for f in E.live(found, "1x2")] == ["a", "b"]
    assert [f.finding_id for f in E.live(found, "1x2", promoted_only=True)] == ["b"]


def test_predictions_are_saved_in_order(spark, tmp_path):
    rows = [(2, "1x2", "value", "baseline", None, None, None, None, "home", 0.5), (1, "1x2", "value", "baseline", None, None, None, None, "home", None), (1, "1x2", "contribution", None, "b", "promoted", 1.0, "h", "home", 0.1), (1, "1x2", "contribution", None, "b", "promoted", 1.0, "h", "away", 0.1), (1, "1x2", "contribution", None, "a", "provisionally_promoted", 0.25, "g", "home", 0.1)]
    log = spark.createDataFrame(rows, "match_id long, market string, kind string, role string, finding_id string, tier string, weight double, model_hash string, selection string, value double")
    found = E.parse_registry(REGISTRY)
    m = E.save_predictions(log, found, f"file://{tmp_path}", "live")
    assert m["extra"]["model_hashes"] == {"a": "g", "b": "h"} and m["extra"]["mode"] == "live" and m["extra"]["tier_weights"] == E.TIER_WEIGHTS and m["rows"] == {"rows_total": 5}
    assert m["extra"]["findings_registry_snapshot"][0]["retrospective_anchor"] == "notes#a"
    back = E.load_predictions(spark, m["path"])
    assert back.columns == log.columns and D.content_hash(back) == D.content_hash(log.orderBy(F.rand(3))) == m["content_hash"] == D.load_manifest(spark, m["path"]).content_hash
    assert [(r.match_id, r.kind, r.finding_id, r.selection) for r in E.ordered_log(back).collect()] == [(1, "contribution", "a", "home"), (1, "contribution", "b", "away"), (1, "contribution", "b", "home"), (1, "value", None, "home"), (2, "value", None, "home")]
    changed = log.withColumn("value", F.when(F.col("match_id") == 2, 0.5000001).otherwise(F.col("value")))
    assert D.content_hash(changed) != m["content_hash"]


def test_datasets_are_saved_sorted(spark, tmp_path):
    df = spark.range(50).select((F.col("id") * 37 % 50).alias("match_id"), F.lit("E0").alias("league_key"), F.when(F.col("id") < 30, "train").otherwise("test").alias("split"), F.lit(1).alias("ht_home"), F.lit(None).cast("int").alias("ht_away")).repartition(4)
    for kind in ("parquet", "csv"):
        m = D.save(df, f"file://{tmp_path}", extra={"x": 1}, file_format=kind)
        back = D.load(spark, m["path"])
        assert back.count() == 50 and m["content_hash"] == D.content_hash(df) and m["file_format"] == kind
        assert m["rows"] == {"rows_total": 50, "rows_train": 30, "rows_test": 20, "rows_with_ht": 0, "per_league": {"E0": 50}}
    parts = [[r.match_id for r in spark.read.parquet(f).collect()] for f in sorted(map(str, (tmp_path).glob("dataset-*/data.parquet/part-*")))]
    assert sum(parts, []) == list(range(50))


def plain_loss(attack, defense, home, rho, cells):
    """The negative log-likelihood, score by score, without the factorials."""
    out = 0.0
    for h, a, x, y, w in cells:
        lam, mu = math.exp(attack[h] + defense[a] + home), math.exp(attack[a] + defense[h])
        tau = {(0, 0): 1 - lam * mu * rho, (1, 0): 1 + mu * rho, (0, 1): 1 + lam * rho, (1, 1): 1 - rho}.get((x, y), 1.0)
        out -= w * (math.log(max(tau, 1e-10)) + x * math.log(lam) - lam + y * math.log(mu) - mu)
    return out


def random_cells(seed, teams=4, n=250):
    rng = np.random.default_rng(seed)
    h = rng.integers(0, teams, n)
    a = (h + rng.integers(1, teams, n)) % teams
    return h, a, rng.poisson(1.4, n).astype(float), rng.poisson(1.1, n).astype(float), rng.uniform(0.2, 1.0, n)


def test_likelihood_by_hand():
    h, a, x, y, w = random_cells(3)
    theta = np.random.default_rng(4).normal(0, 0.1, 9)
    attack, defense = [0.0, *theta[:3]], theta[3:7]
    assert GM.likelihood(theta, h, a, x, y, w, 4)[0] == pytest.approx(plain_loss(attack, defense, theta[7], theta[8], list(zip(h, a, x, y, w))))


def test_fit_is_stationary():
    """No parameter can be moved to a better likelihood."""
    h, a, x, y, w = random_cells(5)
    _, attack, defense, home, rho = GM.fit_cells(h, a, x, y, w)
    cells = list(zip(h, a, x, y, w))
    best = plain_loss(attack, defense, home, rho, cells)
    for step in (1e-2, -1e-2):
        for i in range(4):
            moved = [np.where(np.arange(4) == i, v + step, v) for v in (attack, defense)]
            assert i == 0 or plain_loss(moved[0], defense, home, rho, cells) > best
            assert plain_loss(attack, moved[1], home, rho, cells) > best
        assert plain_loss(attack, defense, home + step, rho, cells) > best and plain_loss(attack, defense, home, rho + step, cells) > best


def test_goal_predictions_by_hand(spark):
    """Rates and grids of a fit, cell by cell."""
    h, a, x, y, _ = random_cells(6)
    df = spark.createDataFrame([("L", int(p), int(q), int(s), int(t), i) for i, (p, q, s, t) in enumerate(zip(h, a, x, y))], "league_key string, home_team_id long, away_team_id long, ft_home int, ft_away int, match_id long")
    params = {r.team_id: r for r in GM.fit(df).collect()}
    for r in GM.GoalPredictor(GM.fit(df)).predict(df, "1x2").collect():
        p, q = params[r.home_team_id], params[r.away_team_id]
        lam, mu = math.exp(p.attack + q.defense + p.home_advantage), math.exp(q.attack + p.defense)
        sums = dict.fromkeys(("home", "draw", "away"), 0.0)
        for s in range(11):
            for t in range(11):
                tau = {(0, 0): 1 - lam * mu * p.rho, (1, 0): 1 + mu * p.rho, (0, 1): 1 + lam * p.rho, (1, 1): 1 - p.rho}.get((s, t), 1.0)
                sums["home" if s > t else "draw" if s == t else "away"] += max(0.0, tau * math.exp(-lam - mu) * lam**s * mu**t / math.factorial(s) / math.factorial(t))
        total = sum(sums.values())
        assert (r.p_home, r.p_draw, r.p_away) == pytest.approx(tuple(v / total for v in sums.values()))


def test_incoherence_and_draw_residuals_by_hand(spark):
    rows = [("L", i % 4, (i + 1 + i // 4 % 3) % 4, i * 7 % 4, i * 5 % 3, i, day("2024-01-01") + datetime.timedelta(i), "train" if i < 60 else "test") for i in range(80)]
    df = spark.createDataFrame(rows, "league_key string, home_team_id long, away_team_id long, ft_home int, ft_away int, match_id long, match_date date, split string")
    p = {r.match_id: r.p_draw for r in GM.GoalPredictor(GM.fit(df.filter("split = 'train'"), 0.001)).predict(df, "1x2").collect()}
    own = {r[5]: (r[3] == r[4]) - p[r[5]] for r in rows if r[7] == "train"}
    got = {r.match_id: r for r in GM.draw_residuals(df).collect()}
    for r in rows:
        for team, value in ((r[1], got[r[5]].home_draw_residual), (r[2], got[r[5]].away_draw_residual)):
            rest = [own[q[5]] for q in rows if q[7] == "train" and team in (q[1], q[2]) and q[5] != r[5]]
            assert value == pytest.approx(sum(rest) / len(rest), abs=1e-6)
    rho = GM.fit(df.filter("split = 'train'"), 0.001).first().rho
    lam, mu = 1.6, 1.1
    fair = GM.grid_sums(np.array([lam]), np.array([mu]), np.array([rho]))[0]
    priced = df.withColumns({"devig_1x2_home_bet365_shin": F.lit(float(fair[0])), "devig_1x2_draw_bet365_shin": F.lit(float(fair[1])), "devig_ou_2_5_over_bet365_shin": F.lit(float(fair[3]) + 0.05)})
    assert all(r.incoherence_ou25 == pytest.approx(0.05, abs=1e-5) for r in GM.coherence(priced).collect())


def test_tabular_by_hand(spark):
    """Predictions follow from medians, means, deviations and the fitted weights; the fit's gradient vanishes."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        x = float(rng.normal())
        rows.append((i, "E0" if i % 3 else "E1", x if i % 5 else None, "home" if x + rng.normal(0, 0.7) > 0.3 else "away" if x < -0.3 else "draw"))
    df = spark.createDataFrame(rows, "match_id long, league_key string, home_form_pts_last5 double, target_1x2 string")
    model = T.TabularPredictor(["team_form"]).fit(df, ["1x2"])
    fitted, labels = model.models["1x2"]
    known = np.array([r[2] for r in rows if r[2] is not None])
    filled = np.array([np.median(known) if r[2] is None else r[2] for r in rows])
    z = np.stack([(filled - filled.mean()) / filled.std(), [r[1] == "E0" for r in rows], [r[1] == "E1" for r in rows]], 1)
    weights, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    scores = z @ weights.T + bias
    p = np.exp(scores - scores.max(1)[:, None])
    p /= p.sum(1)[:, None]
    for r in model.predict(df, "1x2").collect():
        assert [r[f"p_{s}"] for s in labels] == pytest.approx(p[r.match_id].tolist())
    y = np.array([[r[3] == s for s in labels] for r in rows], float)
    assert np.abs((p - y).T @ z / len(rows) + T.regularisation(1.0, len(rows)) * weights).max() < 1e-4


def test_large_league_fits_like_a_small_one(spark):
    rng = np.random.default_rng(7)
    rows = [("L" if h < 14 else "S", h, a, int(rng.poisson(1.5)), int(rng.poisson(1.1))) for h in range(18) for a in range(18) if h != a and (h < 14) == (a < 14) for _ in range(3)]
    df = spark.createDataFrame(rows, "league_key string, home_team_id long, away_team_id long, ft_home int, ft_away int")
    want = {(r.league_key, r.team_id): r for r in GM.fit(df).collect()}
    got = {(r.league_key, r.team_id): r for r in GM.fit(df, many_teams=10).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        for c in ("attack", "defense", "home_advantage", "rho"):
            assert got[k][c] == pytest.approx(r[c], abs=2e-4), (k, c)
        assert got[k].n_matches == r.n_matches
