"""Markets, bookmakers and column names."""

from __future__ import annotations

#: market -> selections in order and the label column.
MARKETS = {
    "1x2": {"selections": ("home", "draw", "away"), "target": "target_1x2"},
    "ou_2.5": {"selections": ("over", "under"), "target": "target_ou_2_5"},
}
#: Bookmakers in the order in which quotes are preferred.
BOOKMAKERS = ("bet365", "market_avg")
DEVIG_METHODS = ("proportional", "power", "shin")
DIVERGENCE_METHOD = "shin"
WINDOWS = (5, 10)
MAX_GOALS = 10
LEAST_ODDS = 1.01


def mangled(market: str) -> str:
    return market.replace(".", "_")


def odds_col(market: str, selection: str, bookmaker: str) -> str:
    return f"odds_{mangled(market)}_{selection}_{bookmaker}"


def odds_columns() -> list[str]:
    return [odds_col(m, s, b) for m, meta in MARKETS.items() for b in BOOKMAKERS for s in meta["selections"]]
