"""The low-score corrected Poisson score grid as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickmill.markets import MAX_GOALS


def tau(x: Column, y: Column, lam: Column, mu: Column, rho: Column) -> Column:
    return F.when((x == 0) & (y == 0), 1 - lam * mu * rho).when((x == 1) & (y == 0), 1 + mu * rho).when((x == 0) & (y == 1), 1 + lam * rho).when((x == 1) & (y == 1), 1 - rho).otherwise(F.lit(1.0))


def poisson(x: int, rate: Column) -> Column:
    fact = 1.0
    for i in range(2, x + 1):
        fact *= i
    return F.exp(x * F.ln(rate) - rate) / F.lit(fact)


def cell(x: int, y: int, lam: Column, mu: Column, rho: Column) -> Column:
    """Unnormalised probability of the score x-y."""
    t = F.lit(1.0)
    if (x, y) == (0, 0):
        t = 1 - lam * mu * rho
    elif (x, y) == (1, 0):
        t = 1 + mu * rho
    elif (x, y) == (0, 1):
        t = 1 + lam * rho
    elif (x, y) == (1, 1):
        t = 1 - rho
    return F.greatest(poisson(x, lam) * poisson(y, mu) * t, F.lit(0.0))


def score_grid(rates: DataFrame, max_goals: int = MAX_GOALS) -> DataFrame:
    """One row per score 0..max_goals squared for each row of (..., lam, mu, rho), with its probability ``p``."""
    goals = F.sequence(F.lit(0), F.lit(max_goals))
    grid = rates.withColumn("x", F.explode(goals)).withColumn("y", F.explode(goals))
    x, y, lam, mu, rho = (F.col(c) for c in ("x", "y", "lam", "mu", "rho"))
    log_p = x * F.ln(lam) - lam - F.ln(F.factorial(x)) + y * F.ln(mu) - mu - F.ln(F.factorial(y))
    return grid.withColumn("w", F.greatest(F.exp(log_p) * tau(x, y, lam, mu, rho), F.lit(0.0)))


def collapsed(lam: Column, mu: Column, rho: Column, max_goals: int = MAX_GOALS) -> Column:
    """struct<home, draw, away, over>: the grid's sums, without making rows of its cells."""
    goals = F.sequence(F.lit(0), F.lit(max_goals))
    mass = lambda rate: F.transform(goals, lambda k: F.exp(k * F.ln(rate) - rate) / F.factorial(k))
    # both sides' masses are computed once: they are bound by a transform of one element
    both = F.array(F.struct(mass(lam).alias("px"), mass(mu).alias("py")))
    return F.get(F.transform(both, lambda m: _collapsed(m["px"], m["py"], lam, mu, rho, goals)), F.lit(0))


def _collapsed(px: Column, py: Column, lam: Column, mu: Column, rho: Column, goals: Column) -> Column:
    # outer products reduce to running sums; only four cells need the correction
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    below = lambda p: F.transform(goals, lambda k: F.aggregate(F.slice(p, 1, k), F.lit(0.0), lambda s, v: s + v))
    whole = lambda p: F.aggregate(p, F.lit(0.0), lambda s, v: s + v)
    p = lambda a, i: F.get(a, F.lit(i))
    fix = {(0, 0): -lam * mu * rho, (1, 0): mu * rho, (0, 1): lam * rho, (1, 1): -rho}
    extra = {k: F.greatest(p(px, k[0]) * p(py, k[1]) * (1 + v), F.lit(0.0)) - p(px, k[0]) * p(py, k[1]) for k, v in fix.items()}
    home = dot(px, below(py)) + extra[1, 0]
    away = dot(py, below(px)) + extra[0, 1]
    draw = dot(px, py) + extra[0, 0] + extra[1, 1]
    under = sum((p(px, i) * p(py, j) for i in range(3) for j in range(3) if i + j <= 2), F.lit(0.0)) + sum(extra.values(), F.lit(0.0))
    mass_all = whole(px) * whole(py) + sum(extra.values(), F.lit(0.0))
    return F.struct((home / mass_all).alias("home"), (draw / mass_all).alias("draw"), (away / mass_all).alias("away"), ((mass_all - under) / mass_all).alias("over"))
