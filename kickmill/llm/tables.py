"""Intermediate tables in the shared folder, and names that no column has."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from kickmill.session import shared_folder


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/kickmill-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kickmill_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete stored tables that no later step reads."""
    for df in tables:
        if path := getattr(df, "_kickmill_path", None):
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python ``rows`` at a time: Spark's default of 10,000 costs an executor some 100 MB a task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def unused(columns: Iterable[str], name: str) -> str:
    """name, with as many underscores as no column has (names differ in more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
