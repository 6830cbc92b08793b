"""Season-file rows to typed rows: one reject reason at most, warnings, and quotes unpivoted in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickmill.functions import parse as P
from kickmill.markets import LEAST_ODDS
from kickmill.operators.mapping import MappingProfile

QUOTE = "struct<bookmaker:string,market:string,selection:string,decimal_odds:double,line:double,price_point:string>"


def quotes(profile: MappingProfile, columns: list[str]) -> tuple[Column, Column]:
    """(quotes, warnings about dropped prices) of a row; absent columns and prices are skipped in silence.

    The cells become one array that one expression parses, so the plan stays small however many columns a profile has.
    A quote whose line column is absent means nothing, but a price below the least is still told.
    """
    there = [(name, spec) for name, spec in profile.odds_columns.items() if name in columns]
    if not there:
        return F.expr(f"cast(array() as array<{QUOTE}>)"), F.expr("cast(array() as array<string>)")
    text = lambda name: F.col(f"`{name}`").cast("string") if name in columns else F.lit(None).cast("string")
    cells = F.array(*[F.struct(F.lit(i).alias("i"), text(name).alias("price"), text(spec.line_col).alias("line")) for i, (name, spec) in enumerate(there)])
    meta = F.array(*[F.struct(F.lit(name).alias("column"), F.lit(bool(spec.line_col)).alias("lined"), F.lit(spec.bookmaker).alias("bookmaker"), F.lit(spec.market).alias("market"), F.lit(spec.selection).alias("selection"), F.lit(spec.price_point).cast("string").alias("price_point")) for name, spec in there])
    parsed = F.transform(cells, lambda c: F.struct(F.get(meta, c["i"]).alias("m"), P.number(c["price"]).alias("price"), P.number(c["line"]).alias("line")))
    good = F.filter(parsed, lambda c: (c["price"] >= LEAST_ODDS) & (~c["m"]["lined"] | c["line"].isNotNull()))
    found = F.transform(good, lambda c: F.struct(c["m"]["bookmaker"].alias("bookmaker"), c["m"]["market"].alias("market"), c["m"]["selection"].alias("selection"), c["price"].alias("decimal_odds"), F.when(c["m"]["lined"], c["line"]).alias("line"), c["m"]["price_point"].alias("price_point")))
    low = F.transform(F.filter(parsed, lambda c: c["price"] < LEAST_ODDS), lambda c: F.concat(F.lit("odds "), c["m"]["column"], F.lit("="), c["price"].cast("string"), F.lit(" below 1.01 dropped")))
    return found, low


def overround_warnings(odds: Column) -> Column:
    """Per bookmaker and price point with three 1x2 quotes: implied probabilities outside [1, 1.25]."""
    trio = F.filter(odds, lambda o: o["market"] == "1x2")
    keys = F.array_distinct(F.transform(trio, lambda o: F.struct(o["bookmaker"].alias("b"), o["price_point"].alias("p"))))

    def judge(key):
        own = F.filter(trio, lambda o: (o["bookmaker"] == key["b"]) & o["price_point"].eqNullSafe(key["p"]))
        s = F.aggregate(own, F.lit(0.0), lambda acc, o: acc + 1.0 / o["decimal_odds"])
        label = F.concat(key["b"], F.coalesce(F.concat(F.lit("/"), key["p"]), F.lit("")))
        return F.when((F.size(own) == 3) & ~s.between(1.0, 1.25), F.concat(F.lit("1x2 probabilities of "), label, F.lit(" add up to "), F.format_number(s, 3)))

    return F.filter(F.transform(keys, judge), lambda x: x.isNotNull())


def validate(raw: DataFrame, profile: MappingProfile) -> DataFrame:
    """``raw`` (all text, with ``row_index``) as typed rows with ``error`` (null: accepted), ``odds`` and ``warnings``."""
    cols = raw.columns
    cell = lambda name: F.col(f"`{name}`") if name and name in cols else F.lit(None).cast("string")
    home, away = P.present(cell(profile.home_col)), P.present(cell(profile.away_col))
    date = P.day(cell(profile.date_col), profile.dayfirst)
    fth, fta = P.whole_number(cell(profile.fthg_col)), P.whole_number(cell(profile.ftag_col))
    hth, hta = P.whole_number(cell(profile.hthg_col)), P.whole_number(cell(profile.htag_col))
    error = F.when(home.isNull() | away.isNull(), "missing team name").when(F.lower(home) == F.lower(away), "identical teams").when(date.isNull(), "bad date").when(fth.isNull() | fta.isNull(), "bad full-time score")
    partial = hth.isNull() != hta.isNull()
    impossible = (hth > fth) | (hta > fta)
    keep = ~partial & ~F.coalesce(impossible, F.lit(False))
    odds, low = quotes(profile, cols)
    ht_warning = F.when(partial, F.lit("half-time score incomplete")).when(impossible, F.lit("half-time score above full-time score"))
    out = raw.select("row_index", error.alias("error"), P.present(cell(profile.league_col)).alias("league_raw"), home.alias("home_raw"), away.alias("away_raw"), date.alias("match_date"), P.time_of_day(cell(profile.time_col)).alias("kickoff_time"), fth.alias("ft_home"), fta.alias("ft_away"), F.when(keep, hth).alias("ht_home"), F.when(keep, hta).alias("ht_away"), P.present(cell(profile.external_id_col)).alias("external_id"), odds.alias("odds"), low.alias("_low"), ht_warning.alias("_ht"))
    warnings = F.concat(F.filter(F.array("_ht"), lambda x: x.isNotNull()), F.col("_low"), overround_warnings(F.col("odds")))
    accepted = F.col("error").isNull()
    return out.withColumn("warnings", F.when(accepted, warnings)).withColumn("odds", F.when(accepted, F.col("odds"))).drop("_low", "_ht")


def unpivoted(validated: DataFrame) -> DataFrame:
    """One row per quote of the accepted rows."""
    return validated.filter("error IS NULL").select("row_index", F.explode("odds").alias("_o")).select("row_index", "_o.*")
