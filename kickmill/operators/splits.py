"""Temporal splits, folds and the leakage guard."""

from __future__ import annotations

import datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kickmill.session import shared_folder


#: Rows of a group that one task may sort; cuts that are sent to every task.
IN_ONE_TASK, MOST_CUTS = 5_000_000, 100_000


class Split(Protocol):
    def assign(self, frame: DataFrame) -> DataFrame: ...

    def describe(self) -> dict: ...


class CutoffSplit:
    """Before the cutoff: train."""

    def __init__(self, cutoff: datetime.date):
        self.cutoff = cutoff

    def assign(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn("split", F.when(F.col("match_date") < F.lit(self.cutoff), "train").otherwise("test"))

    def describe(self) -> dict:
        return {"strategy": "cutoff", "cutoff": self.cutoff.isoformat(), "date_col": "match_date"}


class FractionSplit:
    """The first ``ceil(n * fraction)`` rows of each group by (date, id) train; rows without a group test.

    Each group's last training row is its cut, found from (group, date, id) alone; the frame itself stays where it is.  Groups of up
    to ``IN_ONE_TASK`` rows count their dates, and only the date of the cut is sorted.  Beyond that all ids are, over range partitions.
    """

    def __init__(self, fraction: float, group: str = "league_key", date: str = "match_date", key: str = "match_id"):
        if not 0 < fraction < 1:
            raise ValueError("fraction must lie between 0 and 1")
        self.fraction, self.group, self.date, self.key = fraction, group, date, key

    def describe(self) -> dict:
        return {"strategy": "group_fraction", "train_frac": self.fraction, "group_col": self.group, "date_col": self.date}

    def assign(self, frame: DataFrame) -> DataFrame:
        shared_folder(frame.sparkSession)
        keys = self.keys(frame).checkpoint()
        largest = keys.groupBy("_g").count().agg(F.max("count")).first()[0] or 0
        return self.cut(frame, self.cuts_by_date(keys) if largest <= IN_ONE_TASK else self.cuts_by_range(keys))

    def keys(self, frame: DataFrame) -> DataFrame:
        return frame.filter(F.col(self.group).isNotNull()).select(F.col(self.group).alias("_g"), F.col(self.date).alias("_d"), F.col(self.key).alias("_k"))

    def cuts_by_date(self, keys: DataFrame) -> DataFrame:
        days = keys.groupBy("_g", "_d").agg(F.count("*").alias("_c"))
        whole = Window.partitionBy("_g")
        days = days.withColumns({"_upto": F.sum("_c").over(whole.orderBy("_d")), "_last": F.ceil(F.sum("_c").over(whole) * F.lit(self.fraction))})
        cut = days.filter((F.col("_upto") >= F.col("_last")) & (F.col("_upto") - F.col("_c") < F.col("_last"))).select(F.col("_g").alias("_cg"), F.col("_d").alias("_cd"), (F.col("_last") - F.col("_upto") + F.col("_c")).alias("_left")).checkpoint()
        same = (F.col("_g") == F.col("_cg")) & F.col("_d").eqNullSafe(F.col("_cd"))
        on_day = keys.join(F.broadcast(cut) if cut.limit(MOST_CUTS + 1).count() <= MOST_CUTS else cut, same)
        placed = on_day.withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy("_k")))
        return placed.filter("_n = _left").select("_g", F.struct("_d", "_k").alias("_cut")).checkpoint()

    def by_cuts(self, frame: DataFrame) -> DataFrame:
        return self.cut(frame, self.cuts_by_range(self.keys(frame)))

    def cuts_by_range(self, keys: DataFrame) -> DataFrame:
        numbered = global_row_number(keys, ["_g", "_d", "_k"])
        ends = numbered.groupBy("_g").agg((F.min("_n") - 1 + F.ceil(F.count("*") * F.lit(self.fraction))).alias("_n"))
        return numbered.join(ends, ["_g", "_n"]).select("_g", F.struct("_d", "_k").alias("_cut"))

    def cut(self, frame: DataFrame, cuts: DataFrame) -> DataFrame:
        if cuts.limit(MOST_CUTS + 1).count() <= MOST_CUTS:
            cuts = F.broadcast(cuts)
        out = frame.join(cuts, frame[self.group] == cuts["_g"], "left")
        own = F.struct(F.col(self.date).alias("_d"), F.col(self.key).alias("_k"))
        return out.withColumn("split", F.when(own <= F.col("_cut"), "train").otherwise("test")).drop("_g", "_cut")

    def by_window(self, frame: DataFrame) -> DataFrame:
        rows = Window.partitionBy(self.group)
        # the cut is the group's k-th (date, id): counts come from partial sums, positions from one sort
        position = F.row_number().over(rows.orderBy(self.date, self.key))
        size = F.count(F.lit(1)).over(rows)
        train = F.col(self.group).isNotNull() & (position <= F.ceil(size * F.lit(self.fraction)))
        return frame.withColumn("split", F.when(train, "train").otherwise("test"))


class WalkForward:
    """Blocks of ``ceil(n / (k + 1))`` rows by (date, id); fold i tests block i and trains on all, or the one, before."""

    def __init__(self, k: int, expanding: bool = True, date: str = "match_date", key: str = "match_id"):
        if k < 1:
            raise ValueError("at least one fold")
        self.k, self.expanding, self.date, self.key = k, expanding, date, key

    def blocks(self, frame: DataFrame) -> DataFrame:
        """``block`` from 0.  Row numbers come from sorted partitions and their sizes, not from one task."""
        n = frame.count()
        size = max(1, -(-n // (self.k + 1)))
        numbered = global_row_number(frame, [self.date, self.key])
        return numbered.withColumn("block", F.floor((F.col("_n") - 1) / size).cast("int")).drop("_n")

    def folds(self, frame: DataFrame) -> DataFrame:
        """A row per fold and role of each row: (..., fold, split)."""
        rows = self.blocks(frame)
        last = F.lit(self.k)
        later = F.sequence(F.col("block") + 1, last) if self.expanding else F.array(F.col("block") + 1)
        train = F.when(F.col("block") < self.k, F.transform(later, lambda f: F.struct(f.alias("fold"), F.lit("train").alias("split")))).otherwise(F.expr("cast(array() as array<struct<fold:int,split:string>>)"))
        test = F.when(F.col("block") >= 1, F.array(F.struct(F.col("block").alias("fold"), F.lit("test").alias("split")))).otherwise(F.expr("cast(array() as array<struct<fold:int,split:string>>)"))
        out = rows.withColumn("_r", F.explode(F.concat(train, test))).select(*rows.columns, "_r.fold", "_r.split")
        # fewer blocks than k + 1 give fewer folds
        most = rows.agg(F.max("block")).first()[0] or 0
        return out.filter(F.col("fold") <= most).drop("block")


def global_row_number(frame: DataFrame, order: list[str]) -> DataFrame:
    """``_n``: 1.. in the given total order.  Rows are range-partitioned, numbered locally and offset by partition sizes.

    The placed rows are checkpointed: sampled range bounds may differ between two runs of one plan.
    """
    shared_folder(frame.sparkSession)
    placed = frame.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id()).checkpoint()
    sizes = placed.groupBy("_p").count()
    before = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return placed.join(F.broadcast(before), "_p").withColumn("_n", local + F.col("_before")).drop("_p", "_before")


def leaks(frame: DataFrame, scope: str | None = None, date: str = "match_date") -> DataFrame:
    """Scopes whose latest training date lies after their earliest test date."""
    when = lambda s: F.when(F.col("split") == s, F.col(date))
    keys = [scope] if scope else []
    out = frame.groupBy(*keys).agg(F.max(when("train")).alias("last_train"), F.min(when("test")).alias("first_test"))
    return out.filter(F.col("last_train") > F.col("first_test"))


def assert_no_leakage(frame: DataFrame, scope: str | None = None) -> None:
    if (found := leaks(frame, scope).limit(1).collect()):
        raise AssertionError(f"training rows lie after test rows: {found[0].asDict()}")


def decay_weight(date: Column, reference: Column, xi: float) -> Column:
    """exp(-xi * days before the reference)."""
    return F.exp(-xi * F.datediff(reference, date)) if xi else F.lit(1.0)
