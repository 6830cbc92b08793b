"""Model-ready datasets: labels, features, split, raw prices, manifest and content hash."""

from __future__ import annotations

import datetime
import hashlib
import json
import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickmill.functions import labels as L
from kickmill.operators import features as X
from kickmill.operators import splits as S

SCHEMA_VERSION = "2.1"
#: A written file has at most so many rows: ten million rows of a log may be 20 MB in one row group, which one task has to read.
FILE_ROWS = 2_000_000
IDENTITY = ("match_id", "league_key", "league_name", "home_team_id", "away_team_id", "match_date", "kickoff_utc", "ft_home", "ft_away")


def with_labels(frame: DataFrame) -> DataFrame:
    h, a, hh, ha = (F.col(c) for c in ("ft_home", "ft_away", "ht_home", "ht_away"))
    return frame.withColumns({"target_1x2": L.label_1x2(h, a), "target_ou_2_5": L.label_ou(h, a), "target_btts": L.label_btts(h, a), "target_htft": L.label_htft(hh, ha, h, a)})


def build(frame: DataFrame, groups: Sequence[str] = ("odds_core", "team_form"), split: S.Split | None = None, guard: bool = True) -> DataFrame:
    """Identity, targets, feature groups, split and raw prices; rows are sorted only when written."""
    # split and guard need no feature, so they are done before any is computed
    base = (split or S.FractionSplit(0.7)).assign(with_labels(frame))
    if guard:
        S.assert_no_leakage(base, "league_key")
    out = X.with_features(base, groups)
    return out.select(*[c for c in out.columns if c != "split"], "split")


def manifest_stats(dataset: DataFrame) -> DataFrame:
    """Rows in all, by split, with half-time scores, and by league (as a map)."""
    leagues = dataset.groupBy("league_key").count()
    per = leagues.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("league_key", "count")))).alias("per_league"))
    base = dataset.agg(F.count("*").alias("rows_total"), F.count_if(F.col("split") == "train").alias("rows_train"), F.count_if(F.col("split") == "test").alias("rows_test"), F.count_if(F.col("ht_home").isNotNull() & F.col("ht_away").isNotNull()).alias("rows_with_ht"))
    return base.withColumn("per_league", per.scalar())


def cell_text(name: str, kind: str) -> Column:
    """A value as hashed: doubles to ten significant digits, null as a sign of its own."""
    c = F.col(f"`{name}`")
    if kind in ("double", "float"):
        # adding 0.0 removes the sign of zero
        return F.coalesce(F.format_string("%.9e", c + F.lit(0.0)), F.lit("~"))
    return F.coalesce(c.cast("string"), F.lit("~"))


def row_hash(df: DataFrame) -> Column:
    kinds = dict(df.dtypes)
    return F.sha2(F.concat_ws("\x1f", *[cell_text(c, kinds[c]) for c in sorted(df.columns)]), 256)


def double_text(v: float) -> str:
    """A double as ``cell_text`` has it (Java before 19 takes some doubles above 1e18 for the next lower digits)."""
    if not math.isfinite(v):
        return "NaN" if v != v else "Infinity" if v > 0 else "-Infinity"
    digits, _, exponent = f"{v:.10e}".partition("e")
    if digits.endswith("5") and float(f"{digits}e{exponent}") == v:
        # what is written with eleven digits, 5 being the last, is rounded up, whatever its binary value is
        v = float(f"{digits[:-1]}6e{exponent}")
    return f"{v:.9e}"


def digit_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells, as texts or doubles -> the number of rows (as digit -1) and the sums of the 64 digits of their hashes, once a task."""
    n, sums = 0, np.zeros((32, 2), np.int64)
    for batch in batches:
        texts = []
        for c in batch.columns:
            if pa.types.is_floating(c.type):
                # what is alike in a batch is formatted once
                d = c.dictionary_encode()
                c = pa.array(map(double_text, d.dictionary.to_pylist()), pa.string()).take(d.indices).fill_null("null")
            texts.append(c.cast(pa.binary()))
        rows = pc.binary_join_element_wise(*texts, b"\x1f").cast(pa.large_binary())
        ends, text = np.frombuffer(rows.buffers()[1], np.int64, len(rows) + 1).tolist(), memoryview(rows.buffers()[2])
        own = np.frombuffer(b"".join([hashlib.sha256(text[i:j]).digest() for i, j in zip(ends, ends[1:])]), np.uint8).reshape(-1, 32)
        n += len(own)
        sums += np.stack([(own >> 4).sum(0, dtype=np.int64), (own & 15).sum(0, dtype=np.int64)], 1)
    if n:
        yield pa.RecordBatch.from_pydict({"digit": pa.array(range(-1, 64), pa.int32()), "total": pa.array([n, *sums.ravel().tolist()], pa.int64())})


@contextmanager
def even_tasks(spark) -> Iterator[None]:
    """Files read inside are dealt to about four tasks a core; by bytes alone it may be one more task than cores, which doubles the time."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, max(int(before or 0), 4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def content_hash(df: DataFrame) -> str:
    """Hash of the rows in any order: row hashes are added up in four 15-digit parts, then hashed with the column names.

    The hashes are those of ``row_hash``, computed by batches; their hexadecimal digits are what is added up, as wide
    decimals take longer than all the rest.
    """
    kinds = dict(df.dtypes)
    cells = []
    for number, names in groupby(sorted(df.columns), lambda c: kinds[c] in ("double", "float")):
        # neighbours that are texts go as one
        cells += [F.col(f"`{c}`") + F.lit(0.0) for c in names] if number else [F.concat_ws("\x1f", *[cell_text(c, kinds[c]) for c in names])]
    sums = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).mapInArrow(digit_sums, "digit int, total long").groupBy("digit").agg(F.sum("total").alias("total"))
    with even_tasks(df.sparkSession):
        total = {r.digit: r.total for r in sums.collect()}  # 65 rows
    parts = [sum(total[15 * i + k] * 16 ** (14 - k) for k in range(15)) for i in range(4)] if total else [None] * 4
    return hashlib.sha256(json.dumps([sorted(df.columns), str(total.get(-1, 0)), *map(str, parts)]).encode()).hexdigest()


@dataclass(frozen=True)
class Manifest:
    """What a saved table holds.  ``kind`` is dataset or prediction; ``extra`` is what only one of them has."""

    schema_version: str
    kind: str
    id: str
    created_at: str
    content_hash: str
    file_format: str
    filename: str
    columns: list[str]
    rows: dict
    extra: dict

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)


def save(df: DataFrame, folder: str, kind: str = "dataset", extra: dict | Callable[[DataFrame], dict] | None = None, order: Callable[[DataFrame], DataFrame] = lambda df: df.orderBy("match_id"), file_format: str = "parquet") -> dict:
    """Write the sorted rows and a JSON manifest under an id of UTC time and hash; returns the manifest and the path.

    Rows are hashed and counted as read back, so the manifest tells what was written; ``extra`` may be a function of them.
    """
    now = datetime.datetime.now(datetime.timezone.utc)
    path = f"{folder.rstrip('/')}/{kind}-{now:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    filename = f"{path}/data.{file_format}"
    spark = df.sparkSession
    order(df).write.option("header", True).option("maxRecordsPerFile", FILE_ROWS).format(file_format).save(filename)
    back = spark.read.schema(df.schema).option("header", True).format(file_format).load(filename)
    digest = content_hash(back)
    counted = json.loads(row_counts(back).select(F.to_json(F.struct("*"))).first()[0])
    extra = extra(back) if callable(extra) else extra or {}
    manifest = Manifest(SCHEMA_VERSION, kind, f"{now:%Y%m%dT%H%M%S}-{digest[:8]}", now.isoformat(timespec="seconds"), digest, file_format, filename, df.columns, counted, extra)
    spark.createDataFrame([(manifest.to_json(),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return asdict(manifest) | {"path": path}


def row_counts(df: DataFrame) -> DataFrame:
    """Manifest counts of a dataset; of other tables their rows."""
    if {"split", "league_key", "ht_home", "ht_away"} <= set(df.columns):
        return manifest_stats(df)
    return df.agg(F.count("*").alias("rows_total"))


def load_manifest(spark, path: str) -> Manifest:
    return Manifest(**json.loads(spark.read.text(f"{path.rstrip('/')}/manifest").first()[0]))


def load(spark, path: str) -> DataFrame:
    """A saved table with its manifest, a Parquet or CSV folder or file."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return load(spark, load_manifest(spark, path).filename)


def save_dataset(frame: DataFrame, folder: str, groups: Sequence[str] = ("odds_core", "team_form"), split: S.Split | None = None, guard: bool = True) -> dict:
    """Build from the flat frame and save, with groups and split in the manifest."""
    split = split or S.FractionSplit(0.7)
    if frame.isEmpty():
        raise ValueError("there are no completed matches")
    return save(build(frame, groups, split, guard), folder, "dataset", {"feature_groups": X.describe(groups, frame), "split": split.describe()})


def model_fingerprint(predictions: DataFrame) -> str:
    """A model's hash is the hash of what it predicts."""
    return content_hash(predictions)
