"""Rolling windows of few rows back, for keys that may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kickmill.session import shared_folder


def rolled(rows: DataFrame, key: str, order: Sequence[str], back: int, columns: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """rows with ``columns(window)``, where the window runs over a key in the given total order and frames reach ``back`` rows back at most.

    Rows are range-partitioned by key and order, so a key of many rows lies in several partitions.  Each part of a key gets the last
    ``back`` rows before it from the parts before: the last rows of every part are numbered along the key, and a part asks for the
    ``back`` numbers before its first.  Null keys are one key; rows of equal order may come in any order, as in a plain window.
    """
    shared_folder(rows.sparkSession)
    part, turn, first, halo = "_part", "_turn", "_first", "_halo"
    # sampled bounds may differ between two runs of one plan
    placed = rows.withColumn("_key", F.col(key)).repartitionByRange(F.col(key).asc(), *[F.col(c).asc() for c in order]).withColumn(part, F.spark_partition_id()).checkpoint()
    last = Window.partitionBy("_key", part).orderBy(*[F.desc(c) for c in order])
    tails = placed.withColumn(turn, F.row_number().over(last)).filter(F.col(turn) <= back)
    # at most ``back`` rows a part and key
    along = Window.partitionBy("_key").orderBy(part, F.desc(turn))
    tails = tails.withColumn(turn, F.row_number().over(along)).checkpoint()
    parts = tails.groupBy("_key", part).agg(F.min(turn).alias(first)).filter(F.col(first) > 1)
    asked = parts.select(F.col("_key").alias("_k"), F.col(part).alias("_p"), F.explode(F.sequence(F.greatest(F.lit(1), F.col(first) - back), F.col(first) - 1)).alias("_t"))
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col(turn) == F.col("_t"))
    before = tails.join(asked, same).withColumn(part, F.col("_p")).withColumn(halo, F.lit(True)).drop("_k", "_p", "_t", turn)
    both = placed.withColumn(halo, F.lit(False)).unionByName(before)
    window = Window.partitionBy("_key", part).orderBy(*order)
    return both.withColumns(columns(window)).filter(~F.col(halo)).drop("_key", part, halo)
