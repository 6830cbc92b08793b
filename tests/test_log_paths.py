"""How the predictions log is made, ordered and hashed."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from kickmill.operators import dataset as D
from kickmill.operators import evidence as E
from kickmill.plans import queries as Q

FOUND = (E.Finding("f", "provisionally_promoted", "1x2"), E.Finding("d", "promoted", "1x2"))


def explained(spark, ids):
    cols = {f"{p}_{s}": (F.rand(i + 3 * k) + 0.1) / 4 for k, p in enumerate(("base", "f", "d")) for i, s in enumerate(("home", "draw", "away"))}
    rows = spark.createDataFrame([(i,) for i in ids], "match_id long").repartition(3).withColumns(cols)
    return E.explain(rows.localCheckpoint(), "1x2", FOUND)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_matches_are_sorted_before_they_become_rows(spark):
    ids = list(range(60))
    random.Random(1).shuffle(ids)
    frame = explained(spark, ids)
    log = E.ordered_predictions(frame, "1x2", FOUND, {"f": "x"})
    assert 0 <= plan(log).index("Generate") < plan(log).index("Sort")
    assert log.collect() == E.ordered_log(E.predictions_log(frame, "1x2", FOUND, {"f": "x"})).collect()


def test_repeated_ids_are_in_order_too(spark):
    frame = explained(spark, [3, 1, 2, 1, 3, 1])
    log = E.ordered_predictions(frame, "1x2", FOUND)
    key = lambda r: [(r[c] is not None, "" if r[c] is None else r[c]) for c in E.ORDER]
    rows = log.collect()
    assert len(rows) == 6 * 15 and rows == sorted(rows, key=key)


def test_matches_are_read_once(spark):
    assert "Join" not in plan(Q._blend_input(spark, "/root/testdata/sf0.001"))


def test_log_is_computed_for_writing_only(spark, tmp_path):
    frame, seen = explained(spark, range(40)), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    log = E.predictions_log(frame, "1x2", FOUND, {"f": "x", "d": "y"})
    m = E.save_predictions(log.mapInArrow(count, log.schema), FOUND, f"file://{tmp_path}", order=lambda log: log)
    assert seen.value == log.count() and m["extra"]["model_hashes"] == {"f": "x", "d": "y"}


def test_saved_rows_are_hashed_in_even_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "FILE_ROWS", 10)
    log = E.predictions_log(explained(spark, range(40)), "1x2", FOUND)
    m = E.save_predictions(log, FOUND, f"file://{tmp_path}")
    back = lambda: spark.read.parquet(m["filename"])
    assert len(back().inputFiles()) >= 60
    plain, least = back().rdd.getNumPartitions(), 3 * spark.sparkContext.defaultParallelism
    with D.even_tasks(spark):
        assert back().rdd.getNumPartitions() >= least > plain
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None
    group, tracker = "hash", spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, group)
    assert D.content_hash(back()) == m["content_hash"] == D.content_hash(log)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= least


def test_content_hash_adds_up_row_hashes(spark):
    rng = random.Random(2)
    doubles = [0.1, -0.0, 0.12345678905, 1.00000000005, 2.5e-300, 7e22, float("nan"), float("inf"), float("-inf"), None, *[rng.uniform(-1, 1) * 10 ** rng.randrange(-20, 15) for _ in range(300)]]
    df = spark.createDataFrame([(i, v, rng.choice(["a", "", None]), v if i % 3 else None) for i, v in enumerate(doubles)], "b long, v double, s string, a float").repartition(3)
    for rows in (df, df.filter("false")):
        hashes = [r[0] for r in rows.select(D.row_hash(rows)).collect()]
        parts = [sum(int(h[15 * i : 15 * i + 15], 16) for h in hashes) if hashes else None for i in range(4)]
        assert D.content_hash(rows) == hashlib.sha256(json.dumps([["a", "b", "s", "v"], str(len(hashes)), *map(str, parts)]).encode()).hexdigest()
