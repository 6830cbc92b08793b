"""The corpus pipeline: language ID, near duplicates, repeated passages, contamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kickmill.llm.decontaminate import drop_contaminated
from kickmill.llm.jaccard_join import jaccard_components
from kickmill.llm.language_id import UNKNOWN, identify
from kickmill.llm.packing import pieces_with_digests
from kickmill.llm.substring_dedup import dedup_substrings
from kickmill.llm.tables import discard, stored
from kickmill.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is less certain go; clean text of a learned language scores above 0.9.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or of no certain language go; a missing ``lang`` is filled in.

    So null and empty texts go.  Null ids and repeated rows are judged like all others; an empty table stays empty.
    """
    out = identify(docs)
    known = out.filter((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays.

    Rows without a doc_id or without words are linked with nothing and stay.  Different texts of one doc_id are different documents; of
    the rows of a group with the smallest doc_id the least text (by its SHA-1) stays, of equal ones the least in the other columns.
    An empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    keyed = docs.filter(~alone).withColumn("sha", F.unhex(F.sha1("text")))
    found = stored(jaccard_components(keyed, carry=["sha"]).select("doc_id", "sha", "group_id"), "found")
    # linked rows: one of each group, however many share its least id; the others have a text of their own
    chosen = found.filter(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.min(F.struct("doc_id", "sha")).alias("s")).select("s.doc_id", "s.sha")
    kept = keyed.join(chosen.unionByName(found.filter(F.col("group_id").isNull()).select("doc_id", "sha")), ["doc_id", "sha"])
    times = found.groupBy("doc_id", "sha").agg(F.count("*").alias("times")).filter("times > 1").drop("times")
    again = kept.join(times, ["doc_id", "sha"], "left_semi").groupBy("doc_id", "sha").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("r"))
    again = again.select("doc_id", "r.text", "r.lang", "r.source", "r.n_chars")
    return kept.join(times, ["doc_id", "sha"], "left_anti").select(*COLUMNS).unionByName(again.select(*COLUMNS)).unionByName(docs.filter(alone))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the 13-word windows that an earlier document holds; every document stays.

    Null text becomes empty.  Rows with a null doc_id keep their text; rows with equal doc_ids don't cut each other.
    An empty table stays empty.
    """
    out = dedup_substrings(docs, carry=["lang", "source"], joined=False)
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least a twentieth of their words in benchmark windows go.

    Texts without words, null ones too, stay.  Ids play no part; repeated rows are judged alike; an empty table or benchmark changes nothing.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens.

    Null and empty texts are one token, the end; null ids are kept; repeated rows are packed each; an empty table gives none.
    """
    # executors still hold memory of the stages before
    return pieces_with_digests(docs, remembered=150_000)


def _shipped(stage):
    def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship(spark), docs, sf_dir)

    return apply


STAGES = [(f.__name__, _shipped(f)) for f in (language_id, near_duplicates, repeated_passages, contamination, packing)]

#: SQL can't express the first stage; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
            discard(before)
    return docs
