import pytest

from kickmill.plans.queries import ORACLES, QUERIES
from tests.oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], SMALL)


@pytest.mark.parametrize("name", ["goal_model_fit", "goal_model_predictions", "coherence_feature", "backtest_report", "import_report"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_no_nan_survives(spark):
    from pyspark.sql import functions as F

    df = QUERIES["dataset"](spark, SMALL)
    doubles = [c for c, t in df.dtypes if t == "double"]
    found = df.agg(*[F.count_if(F.isnan(c)).alias(c) for c in doubles]).first()
    assert not any(found)
    # identity (9 less the unused kickoff), 4 targets, 49 price features, 20 form features, split, 10 prices are among them
    assert len([c for c in df.columns if c.startswith(("imp_", "ovr_", "devig_", "div_"))]) == 49
    assert len([c for c in df.columns if "_form_" in c]) == 20
