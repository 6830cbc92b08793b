"""Names that resemble each other: an exact similarity join, and a pool of names that grows in order of first sight.

The measure is that of ``difflib``: twice the matched characters over both lengths.  Matched characters keep their order, so two names
of that ratio differ by at most ``(1 - cutoff) * (both lengths)`` deletions and insertions.  One name is cut into one chunk more than
that; each deletion or insertion spoils one chunk at most, so some chunk is in the other name whole, shifted by no more than the
rest allows.  An equi-join on (length, number of the chunk, chunk) therefore finds all pairs; bounds on the shift are in its keys,
a bound on common characters, from 128 bits a name, is part of the join, so other candidates are never written; what is left is
measured in both directions.  No list of names goes through the driver.
"""

from __future__ import annotations

import difflib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kickmill.session import shared_folder

SIGNED = "name string, place long, n long, s0 long, s1 long"
PAIRS = "name string, candidate string, similarity double, recorded double"


def bags(names: list[str]) -> np.ndarray:
    """How often characters of each of 64 groups are in each name."""
    points = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(names)), [len(n) for n in names])
    return np.bincount(row * 64 + points % 64, minlength=64 * len(names)).reshape(-1, 64)


def signature(batches):
    """Adds 128 bits to names (name, place, n): a character's first, second, ... occurrence flips one bit each.

    Names that differ by so many deletions and insertions differ by at most as many bits.
    """
    for batch in batches:
        names = batch.column(0).to_pylist()
        points = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(names)), [len(n) for n in names])
        order = np.lexsort((points, row))
        points, row = points[order], row[order]
        first = np.flatnonzero(np.append(True, (points[1:] != points[:-1]) | (row[1:] != row[:-1]))) if len(row) else row
        turn = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        bit = (points * 37 + turn * 59) % 128
        bits = np.zeros(2 * len(names), np.uint64)
        np.bitwise_xor.at(bits, 2 * row + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(bits[i::2].view(np.int64)) for i in (0, 1))], ["name", "place", "n", "s0", "s1"])


def measured(batches, cutoff: float):
    """Of candidate pairs those at or above the cutoff, as the search (candidate, name) sees it; recorded is the ratio of (name, candidate)."""
    for batch in batches:
        names, others = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        total = np.array([len(a) + len(b) for a, b in zip(names, others)])
        common = np.minimum(bags(names), bags(others)).sum(axis=1)
        out = []
        for i in np.flatnonzero(2.0 * common >= cutoff * total - 1e-9).tolist():
            ratio = difflib.SequenceMatcher(None, others[i], names[i]).ratio()
            if ratio >= cutoff:
                out.append((names[i], others[i], ratio, round(difflib.SequenceMatcher(None, names[i], others[i]).ratio(), 4)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["name", "candidate", "similarity", "recorded"])


def similar_pairs(names: DataFrame, pool: DataFrame, cutoff: float = 0.92) -> DataFrame:
    """All (name, candidate, similarity, recorded) of ``names.name`` and another ``pool.name`` with a ratio of at least ``cutoff``.

    Where both sides have a column ``place``, the candidate's must be smaller.  Names are compared as they are.  Null names match
    nothing; equal names are no pair; repeated names count once (with their least place); the empty name resembles no other.
    A cutoff of two thirds or less leaves no chunk that must survive: then candidates are names with a common character.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("cutoff must be above 0 and at most 1")
    ordered = "place" in names.columns and "place" in pool.columns
    place = F.min("place") if ordered else F.lit(0)
    sides = []
    for df in (names, pool):
        one = df.filter(F.col("name").isNotNull() & (F.col("name") != "")).groupBy("name").agg(place.cast("long").alias("place"))
        sides.append(one.select("name", "place", F.char_length("name").cast("long").alias("n")).mapInArrow(signature, SIGNED))
    most = 2 * (1 - cutoff) / cutoff
    if most < 1:
        own = f"""transform(sequence(0L, floor({most!r} * n + 1e-9)), i -> named_struct('n', n, 'i', i, 'c',
            substring(name, CAST(i * (n div (floor({most!r} * n + 1e-9) + 1)) AS INT) + 1, CAST(n div (floor({most!r} * n + 1e-9) + 1) AS INT))))"""
        # lengths of names that can resemble this one; for each the chunks' places there, and here where the shift leaves enough
        q, d = f"(x div (floor({most!r} * x + 1e-9) + 1))", f"floor({1 - cutoff!r} * (x + n) + 1e-9)"
        theirs = f"""flatten(transform(sequence(CAST(ceil({cutoff / (2 - cutoff)!r} * n - 1e-9) AS BIGINT), CAST(floor({(2 - cutoff) / cutoff!r} * n + 1e-9) AS BIGINT)), x ->
            flatten(transform(sequence(0L, floor({most!r} * x + 1e-9)), i ->
              transform(filter(sequence(greatest(0L, i * {q} - {d}), greatest(0L, i * {q} + {d})), p -> p + {q} <= n AND abs(p - i * {q}) + abs(n - x - p + i * {q}) <= {d}),
                p -> named_struct('n', x, 'i', i, 'c', substring(name, CAST(p AS INT) + 1, CAST({q} AS INT))))))))"""
        keys = [own, theirs]
    else:
        keys = ["transform(array_distinct(split(name, '')), c -> named_struct('n', 0L, 'i', 0L, 'c', c))"] * 2
    left, right = (s.select("name", "place", "n", "s0", "s1", F.explode(F.array_distinct(F.expr(k))).alias("k")).select("*", "k.n", "k.i", "k.c").drop("k").toDF(*(f"{x}{c}" for c in ("name", "place", "n", "s0", "s1", "kn", "ki", "kc"))) for x, s, k in zip("ab", sides, keys))
    apart = F.bit_count(F.col("as0").bitwiseXOR(F.col("bs0"))) + F.bit_count(F.col("as1").bitwiseXOR(F.col("bs1")))
    near = apart <= F.floor(F.lit(1 - cutoff) * (F.col("an") + F.col("bn")) + 1e-9)
    same = (F.col("akn") == F.col("bkn")) & (F.col("aki") == F.col("bki")) & (F.col("akc") == F.col("bkc"))
    found = left.hint("merge").join(right, same & near & (F.col("aname") != F.col("bname")))
    if ordered:
        found = found.filter("bplace < aplace")
    return found.select(F.col("aname").alias("name"), F.col("bname").alias("candidate")).distinct().mapInArrow(lambda batches: measured(batches, cutoff), PAIRS)


def first_come(places: DataFrame, pairs: DataFrame) -> DataFrame:
    """The names (name, place) that join the pool: in order of place those that resemble none that joined before.

    ``pairs`` are (name, candidate) with the candidate earlier, or outside ``places``: then the name never joins.  Decided in rounds,
    each for all names at once: a name joins when no earlier one that it resembles is open, and goes when one has joined.  Random
    orders take a logarithmic number of rounds.
    """
    shared_folder(places.sparkSession)
    inside = pairs.join(places.select(F.col("name").alias("candidate"), F.lit(True).alias("_in")), "candidate", "left")
    outside = inside.filter("_in IS NULL").select("name").distinct()
    free = places.join(outside, "name", "left_anti")
    links = inside.filter("_in").select("name", "candidate").join(free.select("name"), "name", "left_semi").join(free.select(F.col("name").alias("candidate")), "candidate", "left_semi").checkpoint()
    joined = free.join(links.select("name").distinct(), "name", "left_anti").select("name")
    while links.limit(1).count():
        # candidates that have no open link of their own have joined
        now = links.select(F.col("candidate").alias("name")).distinct().join(links.select("name").distinct(), "name", "left_anti")
        gone = links.join(now.withColumnRenamed("name", "candidate"), "candidate", "left_semi").select("name").distinct().checkpoint()
        rest = links.join(gone, "name", "left_anti")
        kept = rest.join(gone.withColumnRenamed("name", "candidate"), "candidate", "left_anti").checkpoint()
        # names that lost their last earlier neighbour, all of which have gone, join, too
        joined = joined.unionByName(rest.select("name").distinct().join(kept.select("name").distinct(), "name", "left_anti")).checkpoint()
        links = kept
    return free.join(joined, "name", "left_semi").select("name", "place")


def best_of(pairs: DataFrame) -> DataFrame:
    """For each name the candidate of the greatest similarity, of equal ones the last in the alphabet."""
    order = Window.partitionBy("name").orderBy(F.desc("similarity"), F.desc("candidate"))
    return pairs.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
