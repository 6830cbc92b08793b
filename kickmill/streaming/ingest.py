"""Season files as a stream: each new file is imported once, in the order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kickmill.operators.mapping import PROFILES, MappingProfile, detect_profile
from kickmill.sources.readers import read_table
from kickmill.sources.store import Store, import_files

#: Files that one plan imports at most; more are imported by several plans, in order.
MOST_FILES = 200


def import_folder(spark: SparkSession, folder: str, store: Store, checkpoint: str, profiles: tuple[MappingProfile, ...] = PROFILES) -> StreamingQuery:
    """Import every file of the folder that no earlier run has seen; ends when none is left.

    The checkpoint remembers files; a batch that runs again finds its rows stored and only counts duplicates.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "modificationTime")

    def each(batch: DataFrame, _: int) -> None:
        alike: list[tuple] = []  # files of one profile that follow one another are imported in one plan

        def imported() -> None:
            if alike:
                import_files(batch.sparkSession, store, [(raw, name) for raw, name, _ in alike], alike[0][2])
                alike.clear()

        for row in batch.orderBy("modificationTime", "path").collect():  # names of new files
            raw = read_table(batch.sparkSession, row.path)
            profile, score = detect_profile([c for c in raw.columns if c != "row_index"], profiles)
            if profile is None or score < 0.7:
                raise ValueError(f"no profile fits {row.path}")
            if alike and (alike[0][2] != profile or len(alike) == MOST_FILES):
                imported()
            alike.append((raw, row.path.rsplit("/", 1)[-1], profile))
        imported()

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event counts and value sums by window and type, with late rows up to the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
