"""Implied probabilities, overround and margin removal."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from kickmill.markets import LEAST_ODDS

Devig = Callable[[Column], Column]
_methods: dict[str, Devig] = {}


def register_devig(name: str):
    """Register a builder: array of raw implied probabilities -> array of fair ones that add up to 1 (null where impossible)."""

    def add(build: Devig) -> Devig:
        if name in _methods:
            raise ValueError(f"margin removal {name!r} is already registered")
        _methods[name] = build
        return build

    return add


def devig_methods() -> list[str]:
    return sorted(_methods)


def implied(odds: Column) -> Column:
    """1 / odds; null below 1."""
    return F.when(odds >= 1.0, F.lit(1.0) / odds)


def raw_probabilities(*odds: Column) -> Column:
    """Implied probabilities of a whole market; null unless every selection is quoted at a sane price."""
    usable = odds[0] >= LEAST_ODDS
    for o in odds[1:]:
        usable = usable & (o >= LEAST_ODDS)
    return F.when(usable, F.array(*[F.lit(1.0) / o for o in odds]))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def overround(values: Column) -> Column:
    return total(values) - 1.0


def devig(method: str, values: Column, strict: bool = False) -> Column:
    """Fair probabilities by a registered method.

    ``values``: raw implied probabilities.  Null, non-positive or unsolvable input gives null, or an error if strict.
    """
    if method not in _methods:
        raise KeyError(f"no margin removal is called {method!r}")
    usable = values.isNotNull() & F.forall(values, lambda p: p > 0)
    fair = F.when(usable, _methods[method](values))
    fair = F.when(F.abs(total(fair) - 1.0) <= 1e-6, fair)
    if strict:
        return F.when(values.isNull() | fair.isNotNull(), fair).otherwise(F.raise_error(F.lit(f"{method}: no fair probabilities")))
    return fair


@register_devig("proportional")
def proportional(values: Column) -> Column:
    return F.transform(values, lambda p: p / total(values))


def bisect(f, low: np.ndarray, high: np.ndarray, rounds: int = 200, tol: float = 1e-12) -> np.ndarray:
    """Roots of a vectorised f between low and high; NaN where the signs agree."""
    low, high = low.astype(float).copy(), high.astype(float).copy()
    f_low, f_high = f(low), f(high)
    none = np.sign(f_low) * np.sign(f_high) > 0
    for _ in range(rounds):
        mid = (low + high) / 2
        f_mid = f(mid)
        if np.all((np.abs(f_mid) < tol) | (high - low < tol) | none):
            break
        right = np.sign(f_mid) == np.sign(f_low)
        low, high = np.where(right, mid, low), np.where(right, high, mid)
    out = (low + high) / 2
    out[none] = np.nan
    return out


def power_exponents(p: np.ndarray) -> np.ndarray:
    """k with sum(p ** k) = 1 for each row."""
    s = p.sum(1)
    out = np.ones(len(p))
    at = np.flatnonzero(np.abs(s - 1) > 1e-12)
    q, over = p[at], s[at] > 1
    out[at] = bisect(lambda k: (q ** k[:, None]).sum(1) - 1, np.where(over, 1.0, 0.05), np.where(over, 10.0, 1.0))
    return out


def shin_fair(p: np.ndarray, z: np.ndarray) -> np.ndarray:
    s = p.sum(1)[:, None]
    z = z[:, None]
    return (np.sqrt(z**2 + 4 * (1 - z) * p**2 / s) - z) / (2 * (1 - z))


def solve_power(p: np.ndarray) -> np.ndarray:
    return p ** power_exponents(p)[:, None]


def solve_shin(p: np.ndarray) -> np.ndarray:
    """Shin's insider share by bisection; books without a margin are scaled."""
    out = p / p.sum(1)[:, None]
    at = np.flatnonzero(p.sum(1) > 1 + 1e-12)
    q = p[at]
    z = bisect(lambda z: shin_fair(q, z).sum(1) - 1, np.zeros(len(q)), np.full(len(q), 0.999))
    out[at] = shin_fair(q, z)
    return out


def _solver(solve):
    @F.pandas_udf("array<double>")
    def apply(values):
        import pandas as pd

        sizes = values.map(lambda v: -1 if v is None else len(v))
        out = np.full(len(values), None, object)
        for n in sorted(set(sizes) - {-1, 0}):
            at = np.flatnonzero((sizes == n).to_numpy())
            # equal prices are solved once a batch
            p, back = np.unique(np.stack(values.iloc[at].to_list()).astype(float), axis=0, return_inverse=True)
            good = np.isfinite(p).all(1) & (p > 0).all(1)
            fair = np.full(p.shape, np.nan)
            fair[good] = solve(p[good])
            total = fair.sum(1)[:, None]
            fair = np.where(np.abs(total - 1) <= 1e-6, fair / total, np.nan)
            cells = np.empty(len(fair), object)
            cells[:] = [row if np.isfinite(row).all() else None for row in fair]
            out[at] = cells[back]
        return pd.Series(out, index=values.index)

    return apply


@register_devig("power")
def power(values: Column) -> Column:
    return _solver(solve_power)(values)


@register_devig("shin")
def shin(values: Column) -> Column:
    return _solver(solve_shin)(values)
