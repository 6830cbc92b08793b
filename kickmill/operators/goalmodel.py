"""Goal-count models: fitting per league, prediction, market-implied rates, coherence and draw residuals."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickmill.functions import goals as G
from kickmill.markets import MARKETS, MAX_GOALS, mangled
from kickmill.operators.splits import global_row_number
from kickmill.session import shared_folder

PARAMS = "league_key string, team_id long, attack double, defense double, home_advantage double, rho double, n_matches double"


def score_cells(matches: DataFrame, xi: float = 0.0, reference=None) -> DataFrame:
    """The likelihood's sufficient statistics: summed weights by league, pairing and score.

    Their number is bounded by teams and scores, however many matches there are, so one task may fit a league.
    """
    if xi and "match_date" not in matches.columns:
        raise ValueError("decay needs match_date")
    keys = ["league_key", "home_team_id", "away_team_id", "ft_home", "ft_away"]
    if not xi:
        return matches.groupBy(*keys).agg(F.count("*").cast("double").alias("weight"), F.count("*").cast("double").alias("n"))
    last = matches.groupBy("league_key").agg(F.max("match_date").alias("_last")) if reference is None else None
    by_day = matches.groupBy(*keys, "match_date").agg(F.count("*").alias("c"))
    dated = by_day.join(last, "league_key") if last is not None else by_day.withColumn("_last", F.lit(reference))
    return dated.groupBy(*keys).agg(F.sum(F.col("c") * F.exp(-xi * F.datediff("_last", "match_date"))).alias("weight"), F.sum("c").cast("double").alias("n"))


def likelihood(theta: np.ndarray, h: np.ndarray, a: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, teams: int) -> tuple[float, np.ndarray]:
    """Weighted negative log-likelihood (without the constant factorials) and its gradient.

    theta: attack of teams 1.., defense of all teams, home advantage, rho; attack of team 0 is 0.
    """
    attack = np.append(0.0, theta[: teams - 1])
    defense, home, rho = theta[teams - 1 : 2 * teams - 1], theta[-2], theta[-1]
    lam, mu = np.exp(attack[h] + defense[a] + home), np.exp(attack[a] + defense[h])
    tau = np.ones(len(x))
    d_lam, d_mu, d_rho = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for at, value, dl, dm, dr in (((x == 0) & (y == 0), 1 - lam * mu * rho, -mu * rho, -lam * rho, -lam * mu), ((x == 1) & (y == 0), 1 + mu * rho, 0 * lam, rho + 0 * mu, mu), ((x == 0) & (y == 1), 1 + lam * rho, rho + 0 * lam, 0 * mu, lam), ((x == 1) & (y == 1), 1 - rho + 0 * lam, 0 * lam, 0 * mu, -1 + 0 * lam)):
        tau[at], d_lam[at], d_mu[at], d_rho[at] = value[at], dl[at], dm[at], dr[at]
    floor = tau < 1e-10
    tau = np.maximum(tau, 1e-10)
    loss = -np.sum(w * (np.log(tau) + x * np.log(lam) - lam + y * np.log(mu) - mu))
    for d in (d_lam, d_mu, d_rho):
        d[floor] = 0.0
    g_lam = -w * (lam * d_lam / tau + x - lam)
    g_mu = -w * (mu * d_mu / tau + y - mu)
    g_attack = np.bincount(h, g_lam, teams) + np.bincount(a, g_mu, teams)
    g_defense = np.bincount(a, g_lam, teams) + np.bincount(h, g_mu, teams)
    return float(loss), np.concatenate([g_attack[1:], g_defense, [g_lam.sum(), -np.sum(w * d_rho / tau)]])


class Dense:
    """Quasi-Newton steps with a full inverse: quadratic in the parameters."""

    def __init__(self, n: int):
        self.n = n
        self.forget()

    def forget(self) -> None:
        self.inverse = np.eye(self.n)

    def step(self, g: np.ndarray) -> np.ndarray:
        return -self.inverse @ g

    def learn(self, s: np.ndarray, y: np.ndarray) -> None:
        rho = 1 / (s @ y)
        left = np.eye(self.n) - rho * np.outer(s, y)
        self.inverse = left @ self.inverse @ left.T + rho * np.outer(s, s)


class Limited:
    """Quasi-Newton steps from the last few changes: linear in the parameters."""

    def __init__(self, memory: int = 20):
        self.memory = memory
        self.forget()

    def forget(self) -> None:
        self.pairs: list[tuple[np.ndarray, np.ndarray, float]] = []

    def step(self, g: np.ndarray) -> np.ndarray:
        q, used = g.copy(), []
        for s, y, rho in reversed(self.pairs):
            alpha = rho * (s @ q)
            q -= alpha * y
            used.append(alpha)
        if self.pairs:
            s, y, _ = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), alpha in zip(self.pairs, reversed(used)):
            q += s * (alpha - rho * (y @ q))
        return -q

    def learn(self, s: np.ndarray, y: np.ndarray) -> None:
        self.pairs = [*self.pairs[-self.memory + 1 :], (s, y, 1 / (s @ y))]


def minimise(f, start: np.ndarray, bound: np.ndarray, rounds: int = 500, tol: float = 1e-9, memory: Dense | Limited | None = None) -> np.ndarray:
    """Quasi-Newton descent inside the box [-bound, bound]."""
    x = start.copy()
    loss, g = f(x)
    memory = memory or Dense(len(x))
    for _ in range(rounds):
        held = ((x >= bound) & (g < 0)) | ((x <= -bound) & (g > 0))
        step = memory.step(np.where(held, 0.0, g))
        step[held] = 0.0
        if step @ g >= 0:
            memory.forget()
            step = np.where(held, 0.0, -g)
        size = min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        while size > 1e-12:
            new = np.clip(x + size * step, -bound, bound)
            new_loss, new_g = f(new)
            if new_loss <= loss + 1e-4 * (g @ (new - x)):
                break
            size /= 2
        else:
            break
        s, y = new - x, new_g - g
        done = abs(loss - new_loss) <= tol * max(1.0, abs(loss)) and np.abs(s).max() < 1e-7
        x, loss, g = new, new_loss, new_g
        if done:
            break
        if s @ y > 1e-12:
            memory.learn(s, y)
    return x


def start_and_bound(teams: int) -> tuple[np.ndarray, np.ndarray]:
    start, bound = np.zeros(2 * teams + 1), np.full(2 * teams + 1, 3.0)
    start[-2], bound[-1] = 0.1, 0.9
    return start, bound


def fit_cells(home: np.ndarray, away: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """(team ids, attack, defense, home advantage, rho)."""
    teams = np.unique(np.concatenate([home, away]))
    if len(teams) < 2:
        raise ValueError("a league needs two teams")
    h, a = np.searchsorted(teams, home), np.searchsorted(teams, away)
    n = len(teams)
    theta = minimise(lambda t: likelihood(t, h, a, x, y, w, n), *start_and_bound(n))
    return teams, np.append(0.0, theta[: n - 1]), theta[n - 1 : 2 * n - 1], float(theta[-2]), float(theta[-1])


#: Teams of a league from which on its likelihood is summed by many tasks.
MANY_TEAMS = 500
#: What the driver holds of such a league: two parameters a team.
MOST_TEAMS = 10_000_000
SUMS = "place int, g double"


def fit_large(cells: DataFrame, league) -> DataFrame:
    """The fit of one league of many teams: tasks sum the gradient over their cells, the driver takes limited-memory steps.

    A round sends the parameters (16 bytes a team) to the tasks and brings back as many sums, pre-aggregated by task; cells, up to
    teams x teams x scores of them, never leave their tasks.
    """
    shared_folder(cells.sparkSession)
    spark = cells.sparkSession
    own = cells.filter(F.col("league_key") == F.lit(league))
    teams = own.select(F.col("home_team_id").alias("team_id")).unionByName(own.select(F.col("away_team_id").alias("team_id"))).distinct()
    numbered = global_row_number(teams, ["team_id"]).select("team_id", (F.col("_n") - 1).cast("int").alias("i")).checkpoint()
    n = numbered.count()
    if n > MOST_TEAMS:
        raise ValueError(f"a league of {n} teams: more than {MOST_TEAMS} have no room on the driver")
    side = lambda s: numbered.select(F.col("team_id").alias(f"{s}_team_id"), F.col("i").alias(s))
    placed = own.join(side("home"), "home_team_id").join(side("away"), "away_team_id").select("home", "away", F.col("ft_home").cast("double").alias("x"), F.col("ft_away").cast("double").alias("y"), "weight").checkpoint()

    def value_and_gradient(theta: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast(theta)

        def partial(batches):
            total, loss = np.zeros(2 * n + 1), 0.0
            for b in batches:
                h, a, x, y, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("home", "away", "x", "y", "weight"))
                part, g = likelihood(sent.value, h, a, x, y, w, n)
                total += g
                loss += part
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1).astype(np.int32)), pa.array(np.append(total[full], loss))], ["place", "g"])

        sums = placed.mapInArrow(partial, SUMS).groupBy("place").agg(F.sum("g").alias("g")).toPandas()
        sent.unpersist()
        out = np.zeros(2 * n + 2)
        out[sums.place.to_numpy()] = sums.g.to_numpy()  # the loss has place -1, the last
        return float(out[-1]), out[:-1]

    theta = minimise(value_and_gradient, *start_and_bound(n), memory=Limited())
    rows = pd.DataFrame({"i": np.arange(n, dtype=np.int32), "attack": np.append(0.0, theta[: n - 1]), "defense": theta[n - 1 : 2 * n - 1]})
    matches = own.agg(F.sum("n")).first()[0]
    out = spark.createDataFrame(rows).join(numbered, "i")
    return out.select(F.lit(league).alias("league_key"), "team_id", "attack", "defense", F.lit(float(theta[-2])).alias("home_advantage"), F.lit(float(theta[-1])).alias("rho"), F.lit(float(matches)).alias("n_matches"))


def fit(matches: DataFrame, xi: float = 0.0, strict: bool = True, many_teams: int = MANY_TEAMS) -> DataFrame:
    """One row per league and team with the league's parameters; leagues with one team raise, or are left out.

    A league of up to ``many_teams`` teams is fitted by one task from its score cells; larger ones one after another by all tasks.
    """

    def per_league(key, cells):
        try:
            teams, attack, defense, home, rho = fit_cells(cells.home_team_id.to_numpy(), cells.away_team_id.to_numpy(), cells.ft_home.to_numpy(float), cells.ft_away.to_numpy(float), cells.weight.to_numpy(float))
        except ValueError:
            if strict:
                raise
            return pd.DataFrame({c.split()[0]: [] for c in PARAMS.split(", ")})
        return pd.DataFrame({"league_key": key[0], "team_id": teams, "attack": attack, "defense": defense, "home_advantage": home, "rho": rho, "n_matches": cells.n.sum()})

    cells = score_cells(matches, xi)
    teams = matches.select("league_key", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    large = [r[0] for r in teams.groupBy("league_key").agg(F.count_distinct("team_id").alias("n")).filter(F.col("n") > many_teams).select("league_key").collect()]
    if not large:
        return cells.groupBy("league_key").applyInPandas(per_league, PARAMS)
    shared_folder(matches.sparkSession)
    cells = cells.checkpoint()
    out = cells.filter(~F.col("league_key").isin(large)).groupBy("league_key").applyInPandas(per_league, PARAMS)
    for league in sorted(large):
        out = out.unionByName(fit_large(cells, league).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in PARAMS.split(", ")]))
    return out


def with_rates(frame: DataFrame, params: DataFrame) -> DataFrame:
    """lam, mu, rho of each match; null for unknown leagues and teams."""
    home = params.select("league_key", F.col("team_id").alias("home_team_id"), F.col("attack").alias("_ah"), F.col("defense").alias("_dh"), F.col("home_advantage").alias("_h"), F.col("rho").alias("rho"))
    away = params.select("league_key", F.col("team_id").alias("away_team_id"), F.col("attack").alias("_aa"), F.col("defense").alias("_da"))
    out = frame.join(home, ["league_key", "home_team_id"], "left").join(away, ["league_key", "away_team_id"], "left")
    return out.withColumns({"lam": F.exp(F.col("_ah") + F.col("_da") + F.col("_h")), "mu": F.exp(F.col("_aa") + F.col("_dh"))}).drop("_ah", "_dh", "_h", "_aa", "_da")


class GoalPredictor:
    """Predicts from fitted parameters, which are computed once, and abstains where a league or team was not seen."""

    name = "goals"

    def __init__(self, params: DataFrame):
        shared_folder(params.sparkSession)
        self.params = params.checkpoint()

    def predict(self, frame: DataFrame, market: str) -> DataFrame:
        if market not in MARKETS:
            raise KeyError(f"unsupported market {market!r}")
        grid = with_rates(frame, self.params).withColumn("_g", F.when(F.col("lam").isNotNull() & F.col("mu").isNotNull(), G.collapsed(F.col("lam"), F.col("mu"), F.col("rho"))))
        cells = {"home": F.col("_g.home"), "draw": F.col("_g.draw"), "away": F.col("_g.away"), "over": F.col("_g.over"), "under": 1 - F.col("_g.over")}
        return grid.withColumns({f"p_{s}": cells[s] for s in MARKETS[market]["selections"]}).drop("_g", "lam", "mu", "rho")


def grid_sums(lam: np.ndarray, mu: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """(rows, 4): home, draw, away, over for vectors of rates."""
    k = np.arange(MAX_GOALS + 1)
    log_fact = np.append(0.0, np.cumsum(np.log(k[1:])))
    px = np.exp(k * np.log(lam)[:, None] - lam[:, None] - log_fact)
    py = np.exp(k * np.log(mu)[:, None] - mu[:, None] - log_fact)
    grid = px[:, :, None] * py[:, None, :]
    grid[:, 0, 0] *= 1 - lam * mu * rho
    grid[:, 1, 0] *= 1 + mu * rho
    grid[:, 0, 1] *= 1 + lam * rho
    grid[:, 1, 1] *= 1 - rho
    grid = np.maximum(grid, 0)
    grid /= grid.sum((1, 2))[:, None, None]
    x, y = np.meshgrid(k, k, indexing="ij")
    return np.stack([grid[:, m].sum(1) for m in (x > y, x == y, x < y, x + y > 2)], 1)


def rate_misses(z: np.ndarray, rho: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 2): home and draw of the grids of logarithmic rates z, less the target; and (rows, 2, 2): their derivatives by z.

    Sums over the grid come from running sums of the goals' masses, so a row costs its goals, not its cells.
    """
    k = np.arange(MAX_GOALS + 1)
    log_fact = np.append(0.0, np.cumsum(np.log(k[1:])))
    rates = np.exp(z)
    lam, mu = rates.T
    px, py = (np.exp(k * z[:, j, None] - rates[:, j, None] - log_fact) for j in (0, 1))
    dx, dy = px * (k - lam[:, None]), py * (k - mu[:, None])
    below = lambda p: np.cumsum(p, 1) - p
    sums = []  # home, draw, all; and each by both rates
    for u, v in ((px, py), (dx, py), (px, dy)):
        sums.append([(u * below(v)).sum(1), (u * v).sum(1), u.sum(1) * v.sum(1)])
    # the four corrected cells, never below nothing
    for i, j, t, t_lam, t_mu in ((0, 0, 1 - lam * mu * rho, -lam * mu * rho, -lam * mu * rho), (1, 0, 1 + mu * rho, 0.0, mu * rho), (0, 1, 1 + lam * rho, lam * rho, 0.0), (1, 1, 1 - rho, 0.0, 0.0)):
        p, up = px[:, i] * py[:, j], t > 0
        p_lam, p_mu = dx[:, i] * py[:, j], px[:, i] * dy[:, j]
        for n, more in enumerate((p * np.maximum(t, 0) - p, np.where(up, p_lam * t + p * t_lam, 0.0) - p_lam, np.where(up, p_mu * t + p * t_mu, 0.0) - p_mu)):
            sums[n][2] = sums[n][2] + more
            if i >= j:
                sums[n][0 if i > j else 1] = sums[n][0 if i > j else 1] + more
    (home, draw, total), *by_rate = sums
    share = np.stack([home, draw], 1) / total[:, None]
    slope = np.stack([(np.stack([h, d], 1) - share * t[:, None]) / total[:, None] for h, d, t in by_rate], 2)
    return share - target, slope


def solve_rates(p_home: np.ndarray, p_draw: np.ndarray, rho: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Rates whose grid has these home and draw probabilities: damped Newton steps in logarithms; NaN where it fails.

    Rows that are alike are solved once, and a row that is solved takes no part in later rounds.
    """
    rows, back = np.unique(np.stack([p_home, p_draw, rho], 1), axis=0, return_inverse=True)
    target, rho = rows[:, :2], rows[:, 2]
    z = np.tile(np.log([1.3, 1.1]), (len(rows), 1))
    at, error = np.arange(len(rows)), np.zeros(len(rows))
    for turn in range(rounds + 1):
        f, slope = rate_misses(z[at], rho[at], target[at])
        error[at] = np.abs(f).max(1)
        todo = ~(error[at] < 1e-13)
        if turn == rounds or not todo.any():
            break
        at, f, slope = at[todo], f[todo], slope[todo]
        (a, b), (c, d) = slope[:, 0].T, slope[:, 1].T
        det = a * d - b * c
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.stack([(d * f[:, 0] - b * f[:, 1]) / det, (a * f[:, 1] - c * f[:, 0]) / det], 1)
        z[at] = np.clip(z[at] - np.clip(np.nan_to_num(step), -0.5, 0.5), -8, 4)
    bad = ~(error <= 1e-9)
    lam, mu = np.exp(z).T
    lam, mu = np.where(bad, np.nan, lam), np.where(bad, np.nan, mu)
    return lam[back], mu[back]


def implied_rates(p_home: Column, p_draw: Column, rho: Column) -> Column:
    """struct<lam, mu, over> of the rates that the market implies; null fields where there are none."""

    @F.pandas_udf("lam double, mu double, over double")
    def solve(h, d, r):
        out = np.full((len(h), 3), np.nan)
        good = (h.notna() & d.notna() & r.notna()).to_numpy()
        if good.any():
            asked = np.stack([x.to_numpy(float)[good] for x in (h, d, r)], 1)
            rows, back = np.unique(asked, axis=0, return_inverse=True)
            lam, mu = solve_rates(*rows.T)
            over, fine = np.full(len(rows), np.nan), np.isfinite(lam)
            over[fine] = grid_sums(lam[fine], mu[fine], rows[fine, 2])[:, 3]
            out[good] = np.stack([lam, mu, over], 1)[back]
        # missing, not NaN
        return pd.DataFrame({c: pd.array(np.ma.masked_invalid(v).filled(0), dtype="Float64") for c, v in zip(("lam", "mu", "over"), out.T)}).mask(np.isnan(out), pd.NA)

    return solve(p_home, p_draw, rho)


def coherence(frame: DataFrame, xi: float = 0.001, method: str = "shin", book: str = "bet365") -> DataFrame:
    """(match_id, incoherence_ou25): market over probability minus the one its own 1x2 prices imply.

    rho is fitted per league on training rows.  Null without the prices, the league's rho or a solution.
    """
    h, d, o = (f"devig_{mangled(m)}_{s}_{book}_{method}" for m, s in (("1x2", "home"), ("1x2", "draw"), ("ou_2.5", "over")))
    if any(c not in frame.columns for c in (h, d, o)):
        return frame.select("match_id", F.lit(None).cast("double").alias("incoherence_ou25"))
    rho = fit(frame.filter("split = 'train'"), xi, strict=False).select("league_key", "rho").distinct()
    rows = frame.join(rho, "league_key", "left").withColumn("_s", implied_rates(F.col(h), F.col(d), F.col("rho")))
    return rows.select("match_id", (F.col(o) - F.col("_s.over")).alias("incoherence_ou25"))


def residual_means(rows: DataFrame) -> DataFrame:
    """(match_id, home_draw_residual, away_draw_residual) from rows with ``split`` and training ``residual``.

    Training rows leave themselves out of their teams' means; a team with nothing else, or unseen, is null.
    """
    train = rows.filter("split = 'train'")
    sides = [train.select("league_key", F.col(f"{s}_team_id").alias("team_id"), "residual") for s in ("home", "away")]
    teams = sides[0].unionByName(sides[1]).groupBy("league_key", "team_id").agg(F.sum("residual").alias("total"), F.count("residual").alias("n"))
    out = rows
    for s in ("home", "away"):
        own = teams.select("league_key", F.col("team_id").alias(f"{s}_team_id"), F.col("total").alias(f"_t{s}"), F.col("n").alias(f"_n{s}"))
        out = out.join(own, ["league_key", f"{s}_team_id"], "left")
    value = lambda s: F.when(F.col("split") == "train", F.when(F.col(f"_n{s}") > 1, (F.col(f"_t{s}") - F.col("residual")) / (F.col(f"_n{s}") - 1))).otherwise(F.try_divide(F.col(f"_t{s}"), F.col(f"_n{s}")))
    return out.select("match_id", value("home").alias("home_draw_residual"), value("away").alias("away_draw_residual"))


def draw_residuals(frame: DataFrame, xi: float = 0.001) -> DataFrame:
    """How much more often than a goal model expects a team's training matches were drawn."""
    predicted = GoalPredictor(fit(frame.filter("split = 'train'"), xi)).predict(frame, "1x2")
    drawn = F.when(F.col("ft_home") == F.col("ft_away"), 1.0).otherwise(0.0)
    return residual_means(predicted.withColumn("residual", F.when(F.col("split") == "train", drawn - F.col("p_draw"))))
