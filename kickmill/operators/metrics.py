"""Scores of probability frames, and flat-stake betting.

A scored frame has ``p_<selection>`` columns, ``outcome`` and, for betting, ``o_<selection>``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edges of ten probability bins; sums of tenths are not what ``p * 10`` would cut at.
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)


def _sum(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def probability_of_outcome(selections: Sequence[str]) -> Column:
    return reduce(lambda rest, s: F.when(F.col("outcome") == s, F.col(f"p_{s}")).otherwise(rest), selections, F.lit(None).cast("double"))


def check_outcomes(scored: DataFrame, selections: Sequence[str]) -> None:
    """Every outcome must be one of the selections."""
    odd = scored.filter(~F.col("outcome").isin(*selections) | F.col("outcome").isNull()).select("outcome").limit(1).collect()
    if odd:
        raise ValueError(f"outcome {odd[0][0]!r} is none of {list(selections)}")


def log_loss(selections: Sequence[str]) -> Column:
    return F.avg(-F.ln(F.least(F.greatest(probability_of_outcome(selections), F.lit(1e-12)), F.lit(1.0))))


def brier(selections: Sequence[str]) -> Column:
    return F.avg(_sum([F.pow(F.col(f"p_{s}") - F.when(F.col("outcome") == s, 1.0).otherwise(0.0), F.lit(2.0)) for s in selections]))


def long_form(scored: DataFrame, selections: Sequence[str], odds: bool = False) -> DataFrame:
    """One row per selection: selection, p, won (and o)."""
    own = [F.struct(F.lit(s).alias("selection"), F.col(f"p_{s}").alias("p"), (F.col("outcome") == s).alias("won"), *([F.col(f"o_{s}").alias("o")] if odds else [])) for s in selections]
    return scored.select(*[c for c in scored.columns if c[:2] not in ("p_", "o_")], F.explode(F.array(*own)).alias("_x")).select("*", "_x.*").drop("_x")


def bin_of(p: Column, edges: Sequence[float] = EDGES) -> Column:
    return _sum([F.when(p >= e, 1).otherwise(0) for e in edges[1:]])


def calibration(scored: DataFrame, selections: Sequence[str]) -> DataFrame:
    """Ten bins (bin, n, mean_p, hit_rate) over all selections, empty ones included; means to 4 places."""
    rows = long_form(scored, selections).filter(F.col("p").isNotNull()).withColumn("bin", bin_of(F.col("p")))
    found = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("won").cast("double")).alias("hit_rate"))
    every = scored.sparkSession.range(len(EDGES)).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(found), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "hit_rate")


def calibration_error(table: DataFrame) -> DataFrame:
    """Expected calibration error from unrounded means, to 6 places."""
    return table.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("hit_rate"))) / F.sum("n"), 6).alias("ece"))


def simulate(scored: DataFrame, selections: Sequence[str], mode: str = "value_threshold", threshold: float = 0.02, stake: float = 1.0) -> DataFrame:
    """One row of counts, profit, roi and hit rate; unquoted or unpredicted selections are never bet on."""
    rows = long_form(scored, selections, odds=True)
    quoted = F.col("p").isNotNull() & F.col("o").isNotNull()
    if mode == "value_threshold":
        quoted = quoted & (F.col("p") * F.col("o") > 1.0 + threshold)
    elif mode != "bet_all":
        raise ValueError(f"unknown mode {mode!r}")
    gain = F.when(F.col("won"), (F.col("o") - 1.0) * stake).otherwise(-stake)
    sums = rows.agg(F.count(F.when(quoted, 1)).alias("n_bets"), F.coalesce(F.sum(F.when(quoted, gain)), F.lit(0.0)).alias("_g"), F.count(F.when(quoted & F.col("won"), 1)).alias("_h"))
    none = F.col("n_bets") == 0
    # without bets the threshold is reported in any mode
    told = F.lit(threshold) if mode == "value_threshold" else F.when(none, F.lit(threshold))
    staked = F.col("n_bets") * F.lit(stake)
    return sums.select(F.lit(mode).alias("mode"), told.alias("threshold"), "n_bets", staked.alias("staked"), F.round("_g", 4).alias("profit"), F.when(~none, F.round(F.round("_g", 4) / staked, 6)).alias("roi"), F.when(~none, F.round(F.col("_h") / F.col("n_bets"), 6)).alias("hit_rate"))
