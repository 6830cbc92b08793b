"""The flat match frame: completed matches with one column per quoted price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickmill.markets import MARKETS, odds_col, odds_columns


def completed(matches: DataFrame) -> DataFrame:
    """Matches with both final scores; the test is pushed into the scan."""
    return matches.filter(F.col("ft_home").isNotNull() & F.col("ft_away").isNotNull())


def pivot_odds(odds: DataFrame) -> DataFrame:
    """Quotes without a price point as columns, the earliest stored non-null price of each."""
    name = F.concat(F.lit("odds_"), F.regexp_replace("market", r"\.", "_"), F.lit("_"), F.col("selection"), F.lit("_"), F.col("bookmaker"))
    plain = odds.filter(F.col("price_point").isNull()).withColumn("_name", name)
    # min_by ignores rows whose order is null only, so null prices are dropped before; pivot() would shuffle every quote, then every match
    own = lambda c, value: F.when(F.col("_name") == c, F.col(value))
    return plain.filter(F.col("decimal_odds").isNotNull()).groupBy("match_id").agg(*[F.min_by(own(c, "decimal_odds"), own(c, "id")).alias(c) for c in odds_columns()])


def with_leagues(matches: DataFrame, leagues: DataFrame) -> DataFrame:
    """``league_key`` and ``league_name`` of the league, its id as text where it is unknown."""
    known = leagues.select(F.col("id").alias("league_id"), F.col("canonical_key").alias("_key"), F.col("name").alias("_name"))
    out = matches.join(known, "league_id", "left")
    text = F.col("league_id").cast("string")
    return out.withColumns({"league_key": F.coalesce("_key", text), "league_name": F.coalesce("_name", text)}).drop("_key", "_name")


def flat_frame(matches: DataFrame, odds: DataFrame) -> DataFrame:
    has_ht = F.col("ht_home").isNotNull() & F.col("ht_away").isNotNull()
    return completed(matches).withColumn("has_ht", has_ht).join(pivot_odds(odds), "match_id", "left")


def best_odds(market: str) -> dict[str, Column]:
    """Per selection the first bookmaker's price that is there, cell by cell."""
    return {s: F.coalesce(F.col(odds_col(market, s, "bet365")), F.col(odds_col(market, s, "market_avg"))) for s in MARKETS[market]["selections"]}
