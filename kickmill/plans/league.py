"""The match domain on the TPC-H-like tables: deterministic integer and double arithmetic that SQL can repeat.

Orders become matches of five leagues and 24 teams, with half-time scores and two books' prices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kickmill.operators import dataset as D
from kickmill.operators import frame as R

MATCHES_SQL = """
  SELECT o_orderkey AS match_id, substr(o_orderpriority, 1, 1) AS league_key, concat('League ', substr(o_orderpriority, 1, 1)) AS league_name,
    CAST(o_orderdate AS DATE) AS match_date, o_custkey % 24 AS home_team_id, (o_custkey % 24 + 1 + o_orderkey % 23) % 24 AS away_team_id,
    (o_orderkey + CAST(floor(o_totalprice) AS BIGINT)) % 5 AS ft_home, (o_orderkey * 3 + CAST(floor(o_totalprice) AS BIGINT)) % 4 AS ft_away,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % ((o_orderkey + CAST(floor(o_totalprice) AS BIGINT)) % 5 + 1) END AS ht_home,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % ((o_orderkey * 3 + CAST(floor(o_totalprice) AS BIGINT)) % 4 + 1) END AS ht_away,
    CASE WHEN o_orderkey % 9 <> 0 THEN concat(CAST(12 + o_orderkey % 9 AS VARCHAR{n}), ':30') END AS kickoff_time,
    1 + o_custkey % 7 AS wa, 1 + o_orderkey % 5 AS wb, 1 + o_orderkey % 11 AS wc
  FROM orders
"""
#: Margin of each book; which orders it doesn't quote.
BOOK_RULES = {"bet365": (1.05, 13), "market_avg": (1.08, 10)}


def price_sql(book: str, market: str, selection: str) -> str:
    margin, gap = BOOK_RULES[book]
    own = {"home": "wa", "draw": "wb", "away": "wc", "over": "wa", "under": "wb"}[selection]
    whole = "(wa + wb + wc)" if market == "1x2" else "(wa + wb)"
    # sevenths of a point on top keep every price above 1.01
    return f"CASE WHEN match_id % {gap} <> 0 THEN CAST({whole} AS DOUBLE) / (CAST({margin} AS DOUBLE) * CAST({own} AS DOUBLE)) END"


def prices() -> dict[str, str]:
    from kickmill.markets import BOOKMAKERS, MARKETS, odds_col

    return {odds_col(m, s, b): price_sql(b, m, s) for m, meta in MARKETS.items() for b in BOOKMAKERS for s in meta["selections"]}


#: Flat frame for DuckDB.
FRAME_CTE = "m AS (" + MATCHES_SQL.replace("{n}", "") + "), f AS (SELECT m.*, " + ", ".join(f"{e} AS {n}" for n, e in prices().items()) + " FROM m)"


def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, _, _ = MATCHES_SQL.rpartition("FROM orders")
    columns = head.strip().removeprefix("SELECT ")
    return orders_view(spark, sf_dir).selectExpr(*split_columns(columns.replace("{n}", "(10)").replace("VARCHAR(10)", "STRING")))


def split_columns(text: str) -> list[str]:
    out, depth, own = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(own.strip())
            own = ""
        else:
            own += c
    return [*out, own.strip()]


def odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored quotes in long form, ids in a fixed order, plus closing quotes that the flat frame must not see."""
    from kickmill.markets import BOOKMAKERS, MARKETS, odds_col

    rows = matches(spark, sf_dir).withColumns({n: F.expr(e) for n, e in prices().items()})
    entries, k = [], 0
    for m, meta in MARKETS.items():
        for b in BOOKMAKERS:
            for s in meta["selections"]:
                for phase, factor in ((None, 1.0), ("closing", 0.98)):
                    entries.append(F.struct((F.col("match_id") * 100 + k).alias("id"), F.lit(b).alias("bookmaker"), F.lit(m).alias("market"), F.lit(s).alias("selection"), (F.col(odds_col(m, s, b)) * factor).alias("decimal_odds"), F.lit(None).cast("double").alias("line"), F.lit(phase).cast("string").alias("price_point")))
                    k += 1
    return rows.select("match_id", F.explode(F.array(*entries)).alias("_o")).select("_o.id", "match_id", "_o.bookmaker", "_o.market", "_o.selection", "_o.decimal_odds", "_o.line", "_o.price_point").filter("decimal_odds IS NOT NULL")


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.flat_frame(matches(spark, sf_dir), odds(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_labels(flat(spark, sf_dir))


def season_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw text rows of a season file, faults included: missing names, odd dates, bad scores, copies."""
    m = matches(spark, sf_dir).withColumns({n: F.expr(e) for n, e in prices().items()})
    text = lambda c: F.col(c).cast("string")
    k = F.col("match_id")
    out = m.select(
        (k * 2).alias("row_index"),
        F.when(k % 29 != 0, F.concat(F.lit("E"), F.col("league_key"))).alias("Div"),
        F.when(k % 31 == 0, "soon").when(k % 3 == 0, F.date_format("match_date", "dd/MM/yy")).otherwise(F.date_format("match_date", "dd/MM/yyyy")).alias("Date"),
        F.col("kickoff_time").alias("Time"),
        F.when(k % 37 != 0, F.concat(F.lit("Team "), text("home_team_id"))).alias("HomeTeam"),
        F.when(k % 41 == 0, F.concat(F.lit("team "), text("home_team_id"))).otherwise(F.concat(F.lit("Team "), text("away_team_id"))).alias("AwayTeam"),
        F.when(k % 43 == 0, "abandoned").when(k % 5 == 0, F.concat(text("ft_home"), F.lit(".0"))).otherwise(text("ft_home")).alias("FTHG"),
        text("ft_away").alias("FTAG"),
        F.when(k % 17 == 0, "9").otherwise(text("ht_home")).alias("HTHG"),
        F.when(k % 19 != 0, text("ht_away")).alias("HTAG"),
        text("odds_1x2_home_bet365").alias("B365H"),
        text("odds_1x2_draw_bet365").alias("B365D"),
        F.when(k % 23 == 0, "0.5").otherwise(text("odds_1x2_away_bet365")).alias("B365A"),
        text("odds_ou_2_5_over_market_avg").alias("Avg>2.5"),
        text("odds_ou_2_5_under_market_avg").alias("Avg<2.5"),
    )
    return out


def dense_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of few pairings and one day a month, a third of them without a time; names that are not alike."""
    k, name = F.col("match_id"), lambda c, at: F.repeat(F.char(F.lit(at) + F.col(c) % 3), F.lit(6))
    return matches(spark, sf_dir).select(
        (k * 2).alias("row_index"), F.concat(F.lit("E"), F.col("league_key")).alias("Div"), F.date_format(F.trunc("match_date", "month"), "dd/MM/yyyy").alias("Date"),
        F.when(k % 3 != 0, F.concat((12 + k % 2).cast("string"), F.lit(":30"))).alias("Time"), name("home_team_id", 97).alias("HomeTeam"), name("away_team_id", 107).alias("AwayTeam"), (k % 2).cast("string").alias("FTHG"), F.lit("0").alias("FTAG"),
    )
