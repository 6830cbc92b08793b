"""Season files: resilient CSV, optional Excel, all cells as text with clean headers and a row number."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clean_header(name: str) -> str:
    return name.replace("﻿", "").strip()


def sniff_delimiter(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_csv(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """A file (or a folder of files); its first kilobytes tell the delimiter, all of it the encoding: UTF-8 with or without a mark, else Latin-1.

    ``row_index`` counts data rows from 0 in file order.  A file of up to ``range_bytes`` (by default what Spark reads in one task)
    is read by one task; larger ones and folders are read by ranges, with the same rows and numbers.
    """
    limit = range_bytes if range_bytes is not None else spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    sizes = spark.read.format("binaryFile").load(path).select("length").limit(2).collect()
    if len(sizes) != 1 or sizes[0].length > limit:
        return read_ranges(spark, path)
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65536).alias("b"), F.is_valid_utf8(F.col("content").cast("string")).alias("u")).first()
    encoding = "UTF-8" if head.u else "ISO-8859-1"
    start = bytes(head.b).rsplit(b"\n", 1)[0] or bytes(head.b)
    # a character may be cut at the end
    text = start.decode("utf-8-sig", "ignore") if head.u else start.decode("latin-1").removeprefix("\xef\xbb\xbf")
    delimiter = sniff_delimiter(text[:8192])
    header = [clean_header(c) for c in next(csv.reader(io.StringIO(text), delimiter=delimiter))]
    schema = ", ".join(f"`c{i}` string" for i in range(len(header)))
    raw = spark.read.csv(path, header=True, enforceSchema=True, schema=schema, sep=delimiter, encoding=encoding, multiLine=True, escape='"')
    # a single file read whole keeps its order in one partition
    numbered = raw.withColumn("row_index", F.monotonically_increasing_id())
    return numbered.toDF(*header, "row_index")


def quote_states(line: Column, delimiter: str) -> tuple[Column, Column]:
    """Whether a quoted cell is open behind the line, if none (first) or one (second) was open before it."""
    d = re.escape(delimiter)
    quoted = r'"[^"]*+(?:""[^"]*+)*+'
    opens = rf'(?:(?:{quoted}"[^{d}]*|[^"{d}][^{d}]*|){d})*{quoted}$'
    closed = F.regexp_extract(line, r'^[^"]*+(?:""[^"]*+)*+"', 0)
    rest = F.substring(line, F.char_length(closed) + 1, F.char_length(line))
    plain = ~F.contains(line, F.lit('"'))
    return F.when(plain, False).otherwise(F.rlike(line, F.lit("^" + opens))), F.when(plain | (closed == ""), True).otherwise(F.rlike(rest, F.lit(f"^[^{d}]*{d}{opens}")))


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_csv``, by many tasks: a task takes the lines of a range of bytes, and where records begin follows from quotes.

    A line maps "a quoted cell is open" to itself, to its opposite or to a constant.  These maps are composed inside each range, for
    both cases before it; the ranges' maps and counts of records, a row for each, are folded in file order on the driver, as
    Spark's list of ranges is.  Then each range knows how it begins and its first record's number.  Only records of several lines are
    put together by a shuffle.  In a folder every file has a header, and files follow one another by name.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    top = [r.value for r in lines.filter("b = 0").orderBy("f", "i").select("value").limit(50).collect()]
    text = "\n".join(x.removesuffix("\r") for x in top).removeprefix("\ufeff")
    delimiter = sniff_delimiter(text[:8192])
    in_range = Window.partitionBy("f", "b").orderBy("i")
    so_far = in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if0, if1 = quote_states(F.regexp_replace("value", "\r$", ""), delimiter)
    states = lines.withColumns({"if0": if0, "if1": if1}).withColumn("turns", F.sum((F.col("if0") & ~F.col("if1")).cast("long")).over(so_far))
    states = states.withColumn("fixed", F.last(F.when(F.col("if0") == F.col("if1"), F.struct(F.col("if0").cast("long").alias("open"), "turns")), ignorenulls=True).over(so_far))
    behind = lambda before: F.coalesce(F.pmod(F.col("fixed.open") + F.col("turns") - F.col("fixed.turns"), F.lit(2)), F.pmod(before + F.col("turns"), F.lit(2)))
    filled = F.rlike("value", F.lit(r"[^\r]"))
    ends = {f"e{k}": behind(F.lit(k)) for k in (0, 1)}
    states = states.withColumns(ends).withColumns({f"s{k}": filled & (F.lag(f"e{k}", 1, k).over(in_range) == 0) for k in (0, 1)})
    of_range = states.groupBy("f", "b").agg(*[F.max_by(f"e{k}", "i").alias(f"e{k}") for k in (0, 1)], *[F.count_if(f"s{k}").alias(f"n{k}") for k in (0, 1)], F.min(F.is_valid_utf8("value")).alias("valid"))
    ranges, file, is_open, record, headers = [], None, 0, 0, []
    found = sorted(of_range.collect(), key=lambda r: (r.f, r.b))
    for r in found:
        if r.f != file:
            file, is_open = r.f, 0
            headers.append(record)
        ranges.append((r.f, r.b, is_open, record, len(headers), headers[-1]))
        record += (r.n0, r.n1)[is_open]
        is_open = (r.e0, r.e1)[is_open]
    utf8 = all(r.valid for r in found)
    known = spark.createDataFrame(ranges, "f string, b long, is_open int, base long, files long, header long")
    pick = lambda c: F.when(F.col("is_open") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    placed = states.join(known, ["f", "b"]).withColumns({"starts": pick("s"), "open": pick("e")})
    placed = placed.withColumn("record", F.col("base") - 1 + F.sum(F.col("starts").cast("long")).over(so_far))
    value = F.col("value") if utf8 else F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    placed = placed.select("f", "b", "i", "record", "files", "header", "starts", "open", F.regexp_replace(value, "\r$", "").alias("line"))
    single = F.col("starts") & (F.col("open") == 0)
    # lines between records are blank, and hang on to the record before unless that is complete
    several = placed.filter(~single)
    joined = several.groupBy("record").agg(F.min("files").alias("files"), F.min("header").alias("header"), F.max(F.col("starts").cast("int")).alias("begun"), F.array_sort(F.collect_list(F.struct("f", "b", "i", "line"))).alias("l"))
    joined = joined.filter("begun = 1").select("record", "files", "header", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("line"))
    records = placed.filter(single).select("record", "files", "header", "line").unionByName(joined)
    first = text if utf8 else "\n".join(r.line for r in placed.filter((F.col("files") == 1) & (F.col("b") == 0)).orderBy("i").select("line").limit(50).collect())
    header = [clean_header(c) for c in next(csv.reader(io.StringIO(first.removeprefix("\xef\xbb\xbf").lstrip("\n")), delimiter=delimiter))] if first else []
    schema = ", ".join(f"`c{i}` string" for i in range(len(header)))
    cells = records.filter("record > header").select(F.from_csv("line", schema, {"sep": delimiter, "escape": '"'}).alias("c"), (F.col("record") - F.col("files")).alias("row_index"))
    return cells.select(*[F.col(f"c.c{i}") for i in range(len(header))], "row_index").toDF(*header, "row_index")


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading Excel files needs openpyxl, which is not installed") from e
    import pandas as pd

    frame = pd.read_excel(path, sheet_name=0, dtype=str)
    frame.columns = [clean_header(str(c)) for c in frame.columns]
    frame["row_index"] = range(len(frame))
    return spark.createDataFrame(frame)


def read_table(spark: SparkSession, path: str, filename: str | None = None) -> DataFrame:
    """By the file name's suffix."""
    name = (filename or path).lower()
    if name.endswith((".xlsx", ".xls", ".xlsm")):
        return read_excel(spark, path)
    if name.endswith((".csv", ".txt")):
        return read_csv(spark, path)
    raise ValueError(f"unsupported file type: {filename or path}")


def preview(raw: DataFrame, profiles=None, rows: int = 10) -> dict:
    """First rows, row count and the best profile; applied by itself from a score of 0.7."""
    from kickmill.operators import mapping as M

    best, score = M.detect_profile([c for c in raw.columns if c != "row_index"], profiles or M.PROFILES)
    return {"head": raw.orderBy("row_index").limit(rows), "rows": raw.count(), "profile": best, "score": score, "auto_apply": score >= M.AUTO_APPLY}
