"""Predictors and the backtest harness."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickmill.markets import MARKETS, mangled
from kickmill.operators import frame as R
from kickmill.operators import metrics as M
from kickmill.session import shared_folder


class Predictor(Protocol):
    """frame -> frame with ``p_<selection>`` columns added; null means the predictor abstains."""

    name: str

    def predict(self, frame: DataFrame, market: str) -> DataFrame: ...


class MarketBaseline:
    """The market's own fair probabilities: first book's, else the second's, cell by cell."""

    def __init__(self, method: str = "proportional", books: tuple[str, str] = ("bet365", "market_avg")):
        self.method, self.books, self.name = method, books, f"market_{method}"

    def predict(self, frame: DataFrame, market: str) -> DataFrame:
        sels = MARKETS[market]["selections"]
        cells = {s: F.coalesce(*[F.col(f"devig_{mangled(market)}_{s}_{b}_{self.method}") for b in self.books]) for s in sels}
        total = reduce(lambda a, b: a + b, cells.values())
        off = F.abs(total - 1) > 1e-6
        return frame.withColumns({f"p_{s}": F.when(off, F.try_divide(c, total)).otherwise(c) for s, c in cells.items()})


def scored(predictor: Predictor, frame: DataFrame, market: str, split: str = "test") -> DataFrame:
    """Rows of the split that have a label and whose prediction is whole, with best odds."""
    if market not in MARKETS:
        raise KeyError(f"no market is called {market!r}")
    sels = MARKETS[market]["selections"]
    rows = frame.filter(F.col("split") == split) if "split" in frame.columns else frame
    out = predictor.predict(rows, market)
    if missing := [s for s in sels if f"p_{s}" not in out.columns]:
        raise ValueError(f"prediction lacks {missing}")
    out = out.withColumns({f"o_{s}": c for s, c in R.best_odds(market).items()}).withColumn("outcome", F.col(MARKETS[market]["target"]))
    whole = reduce(lambda a, b: a & b, [F.col(f"p_{s}").isNotNull() for s in sels])
    return out.filter(whole & F.col("outcome").isNotNull()).select("match_id", "league_key", "match_date", "outcome", *[f"p_{s}" for s in sels], *[f"o_{s}" for s in sels])


def report(predictor: Predictor, frame: DataFrame, market: str, split: str = "test", threshold: float = 0.02) -> DataFrame:
    """One row: sizes, log loss, Brier, and both betting modes, of rows that are predicted once."""
    sels = MARKETS[market]["selections"]
    shared_folder(frame.sparkSession)
    rows = scored(predictor, frame, market, split).checkpoint()
    base = rows.agg(F.count("*").alias("n"), F.round(M.log_loss(sels), 5).alias("log_loss"), F.round(M.brier(sels), 5).alias("brier"))
    value = M.simulate(rows, sels, "value_threshold", threshold).select(F.col("n_bets").alias("value_bets"), F.col("roi").alias("value_roi"))
    every = M.simulate(rows, sels, "bet_all").select(F.col("n_bets").alias("all_bets"), F.col("roi").alias("all_roi"))
    # three single rows
    key = F.lit(1).alias("_k")
    joined = base.select(key, "*").join(F.broadcast(value.select(key, "*")), "_k").join(F.broadcast(every.select(key, "*")), "_k").drop("_k")
    return joined.select(F.lit(predictor.name).alias("predictor"), F.lit(market).alias("market"), "*")


def comparison(reports: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), reports)
