"""Benchmark decontamination with DataFrame functions only.

The benchmark's windows of ``k`` words (an item of fewer words is one window) form a hash set: an array of
buckets, at most ``MAX_WINDOWS`` windows, that every task holds as a constant.  A document is scanned in place, without a shuffle:

1. Any ``k`` consecutive words contain one of the ``g``-grams that begin at every ``s``-th word (g + s = k + 1).
   Only these are hashed and looked up among the benchmark's g-grams (letters folded further, a superset).
2. Around a hit the s windows that contain it are compared with the benchmark's windows as strings.
3. Verified windows give hit words, items and spans; spans or whole documents can be removed.

A larger benchmark takes the same steps by joins on the g-gram's hash and on the window.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickmill.llm.tables import unused

#: Windows, counted once for each item that has them, that may be held by every task; about 100 bytes each.
MAX_WINDOWS = 200_000
#: What separates words before and after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP + "+"), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def gram_of(length: int) -> tuple[int, int]:
    """(g, s): g-grams at every s-th word meet every run of ``length`` words."""
    g = (length + 2) // 2
    return g, length - g + 1


def gram_hash(words: Column, at: Column, g: int) -> Column:
    return F.xxhash64(F.lower(F.array_join(F.slice(words, at, g), " ")))


def windows(benchmark: DataFrame, item_col: str, text_col: str, k: int) -> DataFrame:
    """Distinct windows (length, win, items) of the benchmark."""
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words_of(ascii_lower(F.col(text_col))).alias("words"))
    items = items.filter(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(k)))
    each = items.select("item", "length", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1), lambda s: F.array_join(F.slice("words", s, F.col("length")), " "))).alias("win"))
    return each.groupBy("length", "win").agg(F.array_sort(F.collect_set("item")).alias("items"))


def constant(rows: DataFrame, hash_col: str, value: Column, kind: str) -> tuple[Column, int]:
    """An array of buckets as a constant expression; a value lies in bucket pmod(hash, size)."""
    spark = rows.sparkSession
    size = 1 << max(4, math.ceil(math.log2(rows.count() + 1)))
    held = rows.select(F.pmod(F.col(hash_col), F.lit(size)).cast("int").alias("slot"), value.alias("v")).groupBy("slot").agg(F.collect_list("v").alias("vs"))
    slots = spark.range(size).select(F.col("id").cast("int").alias("slot")).join(held, "slot", "left").select(F.struct("slot", F.coalesce("vs", F.expr(f"cast(array() as array<{kind}>)")).alias("vs")).alias("x"))
    packed = slots.agg(F.to_json(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["vs"]))).first()[0]
    return F.from_json(F.lit(packed), f"array<array<{kind}>>"), size


def spread(hits: Column) -> Column:
    """Words that the windows (start, length), in any order, cover."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        end = F.greatest(acc["end"], (x["start"] + x["length"]).cast("long"))
        return F.struct(end.alias("end"), (acc["n"] + end - F.least(end, F.greatest(acc["end"], x["start"].cast("long")))).alias("n"))

    return F.aggregate(F.array_sort(hits), zero, step, lambda acc: acc["n"])


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 13, max_windows: int = MAX_WINDOWS, out_col: str = "scan") -> DataFrame:
    """``docs`` with a column ``out_col``: struct<n_words, n_hit, items, hits array<struct<start, length>>>.

    ``start`` counts words from 1.  Words are maximal runs of letters, digits and non-ASCII
    characters after A-Z are lower-cased.  Null or empty text has no words.  Items without words or
    with a null id match nothing; equal items are all reported.  A table without rows gives no rows; an empty
    benchmark leaves every document clean.  Repeated rows are reported alike; null ids are kept.  All columns of ``docs``
    are kept, whatever their names; one named like ``out_col`` is replaced.  Very long texts are scanned whole, in memory that grows
    with their words.
    """
    known = windows(benchmark, item_col, item_text_col, k).cache()
    try:
        lengths = sorted(r[0] for r in known.select("length").distinct().collect())  # at most k values
        if (known.agg(F.sum(F.size("items"))).first()[0] or 0) > max_windows:
            return _scan_by_joins(docs, known, text_col, lengths, out_col)
        tables = []
        for length in lengths:
            own = known.filter(F.col("length") == length)
            g, _ = gram_of(length)
            grams = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(length - g + 1)), lambda p: gram_hash(F.split("win", " "), p, g))).alias("h")).distinct()
            wins = own.withColumn("h", F.xxhash64("win"))
            tables.append((length, *constant(grams, "h", F.col("h"), "bigint"), *constant(wins, "h", F.struct(F.col("win").alias("w"), F.col("items").alias("i")), "struct<w:string,i:array<string>>")))
    finally:
        known.unpersist()

    def found(words: Column) -> Column:
        n = F.size(words)
        every = [F.expr("cast(array() as array<struct<start:int,length:int,items:array<string>>>)")]
        for length, grams, n_grams, wins, n_wins in tables:
            g, s = gram_of(length)
            asked = F.transform(F.sequence(F.lit(1), n - g + 1, F.lit(s)), lambda p: F.struct(p.alias("p"), gram_hash(words, p, g).alias("h")))  # noqa: B023
            near = F.filter(asked, lambda x: F.array_contains(F.get(grams, F.pmod(x["h"], F.lit(n_grams)).cast("int")), x["h"]))  # noqa: B023
            starts = F.flatten(F.transform(near, lambda x: F.sequence(F.greatest(F.lit(1), x["p"] - (s - 1)), F.least(x["p"], n - length + 1), F.lit(1))))  # noqa: B023
            look = lambda a: let(ascii_lower(F.array_join(F.slice(words, a, length), " ")), lambda w: F.struct(a.alias("start"), F.lit(length).alias("length"), F.flatten(F.transform(F.filter(F.get(wins, F.pmod(F.xxhash64(w), F.lit(n_wins)).cast("int")), lambda e: e["w"] == w), lambda e: e["i"])).alias("items")))  # noqa: E731, B023
            every.append(F.when(n >= length, F.filter(F.transform(starts, look), lambda x: F.size(x["items"]) > 0)).otherwise(every[0]))
        return F.concat(*every)

    def report(words: Column) -> Column:
        return let(found(words), lambda hits: summary(F.size(words), hits))

    return docs.withColumn(out_col, let(words_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), report))


def summary(n: Column, hits: Column, items: Column | None = None) -> Column:
    spans = F.transform(hits, lambda x: F.struct(x["start"].cast("int").alias("start"), x["length"].cast("int").alias("length")))
    if items is None:
        items = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda x: x["items"]))))
    return F.struct(n.cast("long").alias("n_words"), spread(spans).alias("n_hit"), items.alias("items"), spans.alias("hits"))


def _scan_by_joins(docs: DataFrame, known: DataFrame, text_col: str, lengths: list[int], out_col: str) -> DataFrame:
    """The same for a benchmark too large to hold: g-grams and windows are joined by their values.  Equal texts are scanned once.

    Windows with the same items share a number; a text's items are looked up by its distinct numbers, so a benchmark text that very
    many items repeat costs a list of them for each text, not for each window.
    """
    key, found, listed = unused([*docs.columns, out_col], "_text"), unused([*docs.columns, out_col], "_found"), unused([*docs.columns, out_col], "_items")
    known = known.withColumn("set", F.sha1(F.to_json("items")))
    sets = known.groupBy("set").agg(F.first("items").alias("items"))
    known = known.drop("items")
    rows = docs.withColumn(key, F.sha1(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    texts = rows.select(F.col(key).alias("_row"), words_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("words")).dropDuplicates(["_row"])
    parts = []
    for length in lengths:
        g, s = gram_of(length)
        own = known.filter(F.col("length") == length)
        grams = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(length - g + 1)), lambda p: gram_hash(F.split("win", " "), p, g))).alias("h")).distinct()  # noqa: B023
        asked = texts.filter(F.size("words") >= length).select("_row", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - g + 1, F.lit(s)), lambda p: F.struct(p.alias("p"), gram_hash(F.col("words"), p, g).alias("h")))).alias("x")).select("_row", "x.p", "x.h")  # noqa: B023
        near = asked.join(grams, "h", "left_semi").groupBy("_row").agg(F.collect_list("p").alias("ps"))
        first = lambda p: F.sequence(F.greatest(F.lit(1), p - (s - 1)), F.least(p, F.size("words") - length + 1), F.lit(1))  # noqa: E731, B023
        wins = texts.join(near, "_row").select("_row", F.explode(F.transform(F.flatten(F.transform("ps", first)), lambda a: F.struct(a.alias("start"), ascii_lower(F.array_join(F.slice("words", a, length), " ")).alias("win")))).alias("x")).select("_row", "x.start", "x.win")  # noqa: B023
        parts.append(wins.join(own, "win").select("_row", F.struct("start", "length").alias("hit"), "set"))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    items = hits.select("_row", "set").distinct().join(sets, "set").groupBy(F.col("_row").alias(key)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(listed))
    hits = hits.groupBy(F.col("_row").alias(key)).agg(F.collect_list("hit").alias(found)).join(items, key)
    none = F.expr("cast(array() as array<struct<start:int,length:int>>)")
    n = F.size(words_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return rows.join(hits, key, "left").withColumn(out_col, summary(n, F.coalesce(F.col(found), none), F.coalesce(F.col(listed), F.expr("cast(array() as array<string>)")))).drop(key, found, listed)


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words lies in benchmark windows."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without contaminated documents; the rest is unchanged.

    Null and empty texts stay; null ids, repeated rows, very long texts, columns and empty tables are treated as by ``scan``.
    """
    own = unused(docs.columns, "scan")
    out = scan(docs, benchmark, out_col=own, **options)
    return out.filter(~is_contaminated(F.col(f"{own}.n_hit"), F.col(f"{own}.n_words"))).drop(own)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` whose texts lose every hit word with the separators that follow it.

    A null text stays null, a text without hits stays as it is; the rest is treated as by ``scan``.
    """
    own = unused(docs.columns, "scan")
    out = scan(docs, benchmark, text_col=text_col, out_col=own, **options)
    text = F.col(text_col).cast("string")
    lead = F.regexp_extract(text, f"^{GAP}*", 0)
    pieces = F.regexp_extract_all(text, F.lit(f"{WORD}+{GAP}*"), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists(F.col(f"{own}.hits"), lambda h: (i + 1 >= h["start"]) & (i + 1 < h["start"] + h["length"])))
    cut = F.when(F.col(f"{own}.n_hit") > 0, F.concat(lead, F.array_join(kept, ""))).otherwise(text)
    return out.withColumn(text_col, cut).drop(own)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contract query: 13-word windows of ``benchmark`` in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = scan(docs, benchmark).select("doc_id", "scan")
    n_words, n_hit, items = F.col("scan.n_words"), F.col("scan.n_hit"), F.col("scan.items")
    return out.select("doc_id", n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), is_contaminated(n_hit, n_words).alias("contaminated"))


OP7_SQL = r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT item, least(len(w), 13) AS l, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
dw AS (
  SELECT doc_id, l, s, array_to_string(w[s : s + l - 1], ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
hit AS (SELECT dw.doc_id, dw.s, dw.l, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.l = bw.l),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.joined, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AND 20 * coalesce(cover.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""
