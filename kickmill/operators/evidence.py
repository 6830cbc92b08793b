"""Findings, their weights, and the evidence-weighted blend with its log."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickmill.markets import MARKETS
from kickmill.operators import dataset as D

# A finding's weight by its tier.
TIER_WEIGHTS = {"rejected": 0.0, "not_confirmed": 0.0, "provisionally_promoted": 0.25, "promoted": 1.0}


class Finding(NamedTuple):
    """A registry entry; the names are those of the JSON format."""

    finding_id: str
    tier: str
    market: str
    extra_columns: Sequence[str] = ()
    description: str = ""
    retrospective_anchor: str = ""


def weight(finding: Finding) -> float:
    """By tier; a KeyError for a tier that has none."""
    if (known := TIER_WEIGHTS.get(finding.tier)) is None:
        raise KeyError(f"finding {finding.finding_id!r} is of tier {finding.tier!r}, which has no weight")
    return known


def parse_registry(text: str) -> list[Finding]:
    """The findings of a registry's JSON text."""
    return [Finding(**entry) for entry in json.loads(text)["findings"]]


def load_registry(path: str | Path) -> list[Finding]:
    return parse_registry(Path(path).read_text(encoding="utf-8"))


#: The registry as shipped: nothing is live.
FINDINGS = (Finding("coherence_1x2", "not_confirmed", "1x2", ("incoherence_ou25",)),)


def live(findings: Sequence[Finding], market: str, promoted_only: bool = False) -> list[Finding]:
    """Findings of the market that carry weight; the others are left out, not multiplied by zero."""
    least = TIER_WEIGHTS["promoted"] if promoted_only else 0.0
    return [f for f in findings if f.market == market and weight(f) > 0.0 and weight(f) >= least]


def registry_rows(spark, findings: Sequence[Finding]) -> DataFrame:
    rows = [(f.finding_id, f.tier, f.market, list(f.extra_columns), weight(f), weight(f) > 0.0) for f in findings]
    return spark.createDataFrame(rows, "finding_id string, tier string, market string, extra_columns array<string>, weight double, is_live boolean")


def logit(p: Column) -> Column:
    return F.when(p.isNotNull(), F.ln(F.greatest(p, F.lit(1e-10))))


def with_softmax(frame: DataFrame, logits: dict[str, Column], out: str) -> DataFrame:
    """Adds ``<out><s>`` of each logit; null for all as soon as one is null.

    In steps, as columns: inside one expression each logit would be computed anew wherever it stands.
    """
    own, up = {s: f"_logit_{s}" for s in logits}, {s: f"_exp_{s}" for s in logits}
    frame = frame.withColumns({own[s]: c for s, c in logits.items()})
    cols = [F.col(c) for c in own.values()]
    some, top = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols]), F.greatest(*cols)
    frame = frame.withColumns({up[s]: F.when(some, F.exp(F.col(own[s]) - top)) for s in logits})
    total = reduce(lambda a, b: a + b, [F.col(c) for c in up.values()])
    return frame.withColumns({f"{out}{s}": F.col(up[s]) / total for s in logits}).drop(*own.values(), *up.values())


def delta(base: Column, with_finding: Column) -> Column:
    """What a finding adds in log space; null where it abstains."""
    return logit(with_finding) - logit(base)


def blend(frame: DataFrame, market: str, findings: Sequence[Finding], base: str = "base_", out: str = "p_") -> DataFrame:
    """Log opinion pool of ``base_<s>`` and ``<finding_id>_<s>`` columns: base + sum of weight * delta.

    An abstaining finding adds nothing; a base with any null makes the whole row null.
    """
    sels = MARKETS[market]["selections"]
    logits = {}
    for s in sels:
        own = logit(F.col(f"{base}{s}"))
        for f in live(findings, market):
            own = own + F.lit(weight(f)) * F.coalesce(delta(F.col(f"{base}{s}"), F.col(f"{f.finding_id}_{s}")), F.lit(0.0))
        logits[s] = own
    return with_softmax(frame, logits, out)


def explain(frame: DataFrame, market: str, findings: Sequence[Finding]) -> DataFrame:
    """Base, canonical and counterfactual (promoted findings only) probabilities and every live finding's deltas."""
    sels = MARKETS[market]["selections"]
    out = blend(frame, market, findings, out="canonical_")
    out = blend(out, market, live(findings, market, promoted_only=True), out="promoted_only_")
    return out.withColumns({f"delta_{f.finding_id}_{s}": delta(F.col(f"base_{s}"), F.col(f"{f.finding_id}_{s}")) for f in live(findings, market) for s in sels})


class Canonical:
    """The blended predictor: a baseline and one model per live finding."""

    name = "canonical"

    def __init__(self, baseline, findings: Sequence[Finding], fit_finding: Callable[[DataFrame, Finding], object]):
        self.baseline, self.findings, self.fit_finding = baseline, findings, fit_finding
        self.models: dict[str, object] = {}

    def fit(self, frame: DataFrame, market: str) -> Canonical:
        self.models = {f.finding_id: self.fit_finding(frame, f) for f in live(self.findings, market)}
        return self

    def predict(self, frame: DataFrame, market: str) -> DataFrame:
        sels = MARKETS[market]["selections"]
        rename = lambda df, to: df.withColumnsRenamed({f"p_{s}": f"{to}{s}" for s in sels})
        out = rename(self.baseline.predict(frame, market), "base_")
        for f in live(self.findings, market):
            own = rename(self.models[f.finding_id].predict(frame, market), f"{f.finding_id}_").select("match_id", *[f"{f.finding_id}_{s}" for s in sels])
            out = out.join(own, "match_id", "left")
        return blend(out, market, self.findings)


LOG_COLUMNS = ("match_id", "market", "kind", "role", "finding_id", "tier", "weight", "model_hash", "selection", "value")
ORDER = ("match_id", "market", "kind", "role", "finding_id", "selection")


def predictions_log(explained: DataFrame, market: str, findings: Sequence[Finding], hashes: dict[str, str] | None = None) -> DataFrame:
    """Long log: three roles and each live finding's raw deltas, by selection; a match's rows come in the log's order."""
    sels = MARKETS[market]["selections"]
    names = ("kind", "role", "finding_id", "tier", "weight", "model_hash", "selection")
    rows = [(("value", role, None, None, None, None, s), f"{prefix}{s}") for role, prefix in (("baseline", "base_"), ("canonical", "canonical_"), ("promoted_only", "promoted_only_")) for s in sels]
    rows += [(("contribution", None, f.finding_id, f.tier, weight(f), (hashes or {}).get(f.finding_id), s), f"delta_{f.finding_id}_{s}") for f in live(findings, market) for s in sels]
    rows.sort(key=lambda r: [(v is not None, v or "") for n, v in zip(names, r[0]) if n in ORDER])
    # only the values are copied out of a match; what else a row has follows from its number
    out = explained.select("match_id", F.lit(market).alias("market"), F.posexplode(F.array(*[F.col(value) for _, value in rows])).alias("_i", "value"))
    told = {n: F.get(F.array(*[F.lit(r[0][k]).cast("double" if n == "weight" else "string") for r in rows]), F.col("_i")) for k, n in enumerate(names)}
    return out.withColumns(told).select(*LOG_COLUMNS)


def ordered_predictions(explained: DataFrame, market: str, findings: Sequence[Finding], hashes: dict[str, str] | None = None) -> DataFrame:
    """The log in its order.  Matches are sorted before they become rows; only where an id repeats all rows are."""
    if explained.groupBy("match_id").count().filter("count > 1").isEmpty():
        return predictions_log(explained.orderBy("match_id"), market, findings, hashes)
    return ordered_log(predictions_log(explained, market, findings, hashes))


def ordered_log(log: DataFrame) -> DataFrame:
    """The log in its order: six keys, nulls first."""
    return log.orderBy(*ORDER)


def model_hashes(log: DataFrame) -> DataFrame:
    """(finding_id, model_hash): one row per finding that contributed."""
    return log.filter("kind = 'contribution'").select("finding_id", "model_hash").dropDuplicates(["finding_id"])


def save_predictions(log: DataFrame, findings: Sequence[Finding], folder: str, mode: str = "backtest", order: Callable[[DataFrame], DataFrame] = ordered_log) -> dict:
    """Write the log and a manifest that keeps what its values rest on: registry, tier weights and model hashes.

    The log is computed once, for writing.  One that is in its order needs no ``order``.
    """

    def meta(back: DataFrame) -> dict:
        hashes = {r.finding_id: r.model_hash for r in model_hashes(back).collect()}  # at most one per registered finding
        return {"mode": mode, "tier_weights": TIER_WEIGHTS, "findings_registry_snapshot": [f._asdict() | {"extra_columns": list(f.extra_columns)} for f in findings], "model_hashes": hashes}

    return D.save(log, folder, "prediction", meta, order=order)


def load_predictions(spark, path: str) -> DataFrame:
    return D.load(spark, path)
