"""Outcome labels of a match from its scores; null where a score is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_label(home: Column, away: Column, names: tuple[str, str, str]) -> Column:
    return F.when(home > away, names[0]).when(home == away, names[1]).when(home < away, names[2])


def label_1x2(home: Column, away: Column) -> Column:
    return sign_label(home, away, ("home", "draw", "away"))


def label_ou(home: Column, away: Column, line: float = 2.5) -> Column:
    return F.when(home + away > line, "over").when(home + away <= line, "under")


def label_btts(home: Column, away: Column) -> Column:
    return F.when((home > 0) & (away > 0), "yes").when(home.isNotNull() & away.isNotNull(), "no")


def label_htft(ht_home: Column, ht_away: Column, ft_home: Column, ft_away: Column) -> Column:
    """One of nine pairs like ``1/X``."""
    names = ("1", "X", "2")
    # concat, unlike concat_ws, is null as soon as one side is
    return F.concat(sign_label(ht_home, ht_away, names), F.lit("/"), sign_label(ft_home, ft_away, names))
