"""Tabular classifiers on MLlib with train-only preprocessing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickmill.markets import MARKETS
from kickmill.operators.features import resolve_columns
from kickmill.operators.medians import exact_medians


def regularisation(c: float, n: int) -> float:
    """MLlib's regParam for the inverse strength C of a sum-of-losses objective over n rows."""
    return 1.0 / (c * n)


def preprocess_stats(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """Per column (median, mean, population deviation) of the imputed training values; all-null columns are left out."""
    medians = exact_medians(train, columns)
    kept = [c for c in columns if medians[c] is not None]
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c]))).alias(c) for c in kept]
    stats = train.select(*filled).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(kept)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(kept)]).first()
    return {c: (float(medians[c]), float(stats[f"m{i}"]), float(stats[f"s{i}"]) or 1.0) for i, c in enumerate(kept)}


def known_leagues(train: DataFrame) -> DataFrame:
    """The leagues of the training rows."""
    return train.filter(F.col("league_key").isNotNull()).select("league_key").distinct()


def scaled(stats: dict[str, tuple[float, float, float]]) -> dict[str, Column]:
    return {c: (F.coalesce(F.col(c).cast("double"), F.lit(median)) - mean) / deviation for c, (median, mean, deviation) in stats.items()}


def logistic(n: int, c: float = 1.0) -> LogisticRegression:
    return LogisticRegression(family="multinomial", regParam=regularisation(c, n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8)


class TabularPredictor:
    """One classifier per market on allowed feature columns and one-hot leagues; abstains on unseen leagues."""

    def __init__(self, groups: Sequence[str], extra_columns: Sequence[str] = (), estimator: Callable[[int], object] = logistic, name: str = "tabular"):
        self.groups, self.extra, self.estimator, self.name = groups, list(extra_columns), estimator, name
        self.models: dict[str, tuple[object, list[str]]] = {}

    def fit(self, frame: DataFrame, markets: Sequence[str] = tuple(MARKETS)) -> TabularPredictor:
        """Fit on the frame's training rows (all rows, if it has no split).

        ``ValueError`` without any feature column, ``KeyError`` for extra columns that the frame doesn't have.
        """
        if absent := [c for c in self.extra if c not in frame.columns]:
            raise KeyError(f"extra columns not in the frame: {', '.join(absent)}")
        train = frame.filter("split = 'train'") if "split" in frame.columns else frame
        columns = (resolve_columns(train, self.groups) if self.groups else []) + self.extra
        if not columns:
            raise ValueError("no feature columns: neither groups nor extra columns name any")
        self.stats = preprocess_stats(train, columns)
        # each becomes a column of the model, so there are few
        self.leagues = sorted(r[0] for r in known_leagues(train).collect())
        for market in markets:
            target = MARKETS[market]["target"]
            rows = train.filter(F.col(target).isNotNull())
            labels = [s for s in MARKETS[market]["selections"] if rows.filter(F.col(target) == s).limit(1).count()]
            if len(labels) < 2:
                continue
            number = F.array_position(F.array(*[F.lit(s) for s in labels]), F.col(target)) - 1
            data = self._assembled(rows).select("features", number.cast("double").alias("label"))
            self.models[market] = (self.estimator(rows.count()).fit(data), labels)
        return self

    def _assembled(self, frame: DataFrame) -> DataFrame:
        numeric = {f"_x{i}": c for i, c in enumerate(scaled(self.stats).values())}
        hot = {f"_l{i}": F.coalesce((F.col("league_key") == k).cast("double"), F.lit(0.0)) for i, k in enumerate(self.leagues)}
        out = frame.withColumns(numeric | hot)
        return VectorAssembler(inputCols=[*numeric, *hot], outputCol="features").transform(out).drop(*numeric, *hot)

    def predict(self, frame: DataFrame, market: str) -> DataFrame:
        sels = MARKETS[market]["selections"]
        if market not in self.models:
            return frame.withColumns({f"p_{s}": F.lit(None).cast("double") for s in sels})
        model, labels = self.models[market]
        out = model.transform(self._assembled(frame))
        p = vector_to_array("probability")
        seen = F.col("league_key").isin(*self.leagues)
        cells = {f"p_{s}": F.when(seen, F.get(p, F.lit(labels.index(s))) if s in labels else F.lit(0.0)) for s in sels}
        return out.withColumns(cells).drop("features", "rawPrediction", "probability", "prediction")
