"""Range-split windows, medians by selection, free-form dates and times, errors of the tabular predictor, the entry's guard."""

import math
import os
import random
import shutil
import statistics
import subprocess
import sys
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kickmill.functions import parse as P
from kickmill.operators import features as X
from kickmill.operators import tabular as T
from kickmill.operators.medians import exact_medians
from kickmill.operators.rolling import rolled

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("partitions, back", [(1, 3), (7, 1), (40, 5)])
def test_rolled_equals_a_plain_window(spark, partitions, back):
    r = random.Random(back)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), r.randint(0, 50), i, r.choice([None, float(i)])) for i in range(400)] + [("one", 1, 1000, 2.0)]
    df = spark.createDataFrame(rows, "k string, t int, id long, v double")
    columns = lambda w: {"m": F.avg("v").over(w.rowsBetween(-back, -1)), "n": F.count(F.lit(1)).over(w.rowsBetween(-back, -1))}
    want = df.withColumns(columns(Window.partitionBy("k").orderBy("t", "id"))).collect()
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = rolled(df, "k", ["t", "id"], back, columns)
        assert out.columns == df.columns + ["m", "n"]
        assert sorted(map(str, out.collect())) == sorted(map(str, want))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_form_of_a_hot_team(spark):
    r = random.Random(1)
    matches = spark.createDataFrame([(i, date(2024, 1, 1 + r.randint(0, 27)), r.randint(0, 2), 3, r.randint(0, 4), r.randint(0, 4)) for i in range(120)], "match_id long, match_date date, home_team_id long, away_team_id long, ft_home int, ft_away int")
    own = X.appearances(matches)
    assert sorted(map(str, X.rolling_form(own, hot_rows=50).select(*X.rolling_form(own).columns).collect())) == sorted(map(str, X.rolling_form(own).collect()))


def test_medians_by_selection(spark):
    r = random.Random(2)
    for n in (0, 1, 2, 7, 250):
        columns = {"a": [r.gauss(0, 1) for _ in range(n)], "b": [float(r.randint(0, 3)) for _ in range(n)], "c": [r.choice([None, math.nan, 5.0, -1e300, 1e300]) for _ in range(n)], "d": [1e-9 * r.random() + 1 for _ in range(n)], "e": [None] * n}
        df = spark.createDataFrame(list(zip(*columns.values())), "a double, b double, c double, d double, e double")
        got = exact_medians(df, list(columns), bins=5)
        for name, values in columns.items():
            values = [v for v in values if v is not None and not math.isnan(v)]
            want = statistics.median(values) if values else None
            assert got[name] == want or math.isclose(got[name], want, rel_tol=1e-15), (n, name)
    assert exact_medians(spark.createDataFrame([(3,), (4,)], "x int"), ["x"]) == {"x": 3.5} and exact_medians(df, []) == {}


DATES = {
    "17/08/2025": "2025-08-17", "08/17/2025": "2025-08-17", "5/6/2025": "2025-06-05", "17 August 2025": "2025-08-17", "Aug 17, 2025": "2025-08-17", "17-Aug-25": "2025-08-17", "17th Sept. 1998": "1998-09-17", "Sunday, 17 August 2025": "2025-08-17",
    "2025/08/17": "2025-08-17", "20250817": "2025-08-17", "2025-08-17T14:30:00Z": "2025-08-17", "2025-08-17 14:30:00.25+02:00": "2025-08-17", "17.08.2025 14.30": "2025-08-17", "Aug 17 2025 2pm": "2025-08-17", "2025 Aug 17": "2025-08-17", "1 May 99": "1999-05-01", "2025-17-08": "2025-08-17",
    "31/02/2025": None, "soon": None, "17 Foo 2025": None, "Aug 2025": None, "1 Aug Sep 2025": None, "x2025-08-17": None, "": None, "nan": None, "99999999": None, "12": None, "17 August 20255": None, "1/2/3/4": None, "marching 1 2025": None,
}
TIMES = {"14:00": "14:00", "9:05:30": "09:05", "2pm": "14:00", "2:30 PM": "14:30", "12am": "00:00", "12.15 p.m.": "12:15", "14.30": "14:30", "14h30": "14:30", "2025-08-17T14:30:00Z": "14:30", "14:30+02:00": "14:30", "25:00": None, "13pm": None, "14": None, "0am": None, "late": None, "14:60": None, None: None}


def test_free_form_dates_and_times(spark):
    got = {r.t: r.d for r in spark.createDataFrame([(t,) for t in DATES], "t string").select("t", P.day(F.col("t")).cast("string").alias("d")).collect()}
    assert got == DATES
    got = {r.t: r.d for r in spark.createDataFrame([(t,) for t in TIMES], "t string").select("t", P.time_of_day(F.col("t")).alias("d")).collect()}
    assert got == TIMES
    american = spark.createDataFrame([("5/6/2025",), ("17/8/2025",), ("8-9-25 1pm",)], "t string").select(P.day(F.col("t"), dayfirst=False).cast("string")).collect()
    assert [r[0] for r in american] == ["2025-05-06", "2025-08-17", "2025-08-09"]


def test_tabular_errors(spark):
    frame = spark.createDataFrame([], "match_id long, league_key string, target_1x2 string")
    with pytest.raises(ValueError):
        T.TabularPredictor([]).fit(frame)
    with pytest.raises(KeyError):
        T.TabularPredictor([], ["not_there"]).fit(frame)


@pytest.mark.parametrize("left_out", [["kickmill/llm", "corpus_pipeline.py"], ["kickmill/llm"], ["corpus_pipeline.py"]])
def test_entry_without_the_optional_part(tmp_path, left_out):
    for name in ("kickmill", "__spark_entry__.py", "corpus_pipeline.py"):
        src = os.path.join(ROOT, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=lambda d, names: ["llm"] if "kickmill/llm" in left_out and os.path.basename(d) == "kickmill" else ["__pycache__"])
        elif os.path.exists(src) and name not in left_out:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op') and n[2].isdigit() for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True).stdout.split()
    has_llm = os.path.isdir(os.path.join(ROOT, "kickmill/llm")) and "kickmill/llm" not in left_out
    assert int(out[0]) > 70 and out[1:] == [str(False), str(has_llm)]


def test_split_and_pivot_leave_rows_in_place(spark):
    """The wide frame is not dealt by its few groups, and quotes are shuffled once."""
    from kickmill.operators import frame as R
    from kickmill.operators import splits as S
    from kickmill.markets import odds_col

    rows = [(i, "AB"[i % 2] if i % 7 else None, f"2024-01-{1 + i % 3:02d}" if i % 5 else None) for i in range(90)]
    frame = spark.createDataFrame(rows, "match_id long, league_key string, d string").selectExpr("match_id", "league_key", "CAST(d AS DATE) AS match_date")
    split = S.FractionSplit(0.6)
    out = split.assign(frame)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, out.collect())) == sorted(map(str, split.by_window(frame).collect()))
    quotes = [(1, 2, "bet365", "1x2", "home", 2.0, None), (2, 2, "bet365", "1x2", "home", 3.0, None), (3, 2, "bet365", "1x2", "home", 1.5, "closing"), (4, 3, "bet365", "1x2", "draw", None, None), (5, 4, "other", "1x2", "home", 2.0, None)]
    wide = R.pivot_odds(spark.createDataFrame(quotes, "id long, match_id long, bookmaker string, market string, selection string, decimal_odds double, price_point string"))
    home = odds_col("1x2", "home", "bet365")
    assert {r.match_id: r[home] for r in wide.collect()} == {2: 2.0, 4: None}
    assert wide._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2
