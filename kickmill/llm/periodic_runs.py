"""Periodic runs of words: a passage repeated at least so many times in a row, found by probing a harmonic grid.

For every period p the words at jp and (j + 1)p are compared, for the texts of a whole batch at once: N/p comparisons, so
N (1 + 1/2 + 1/3 + ...) in all.  A run of four periods holds three such equalities in a row, so only grid points that begin three
are extended, word by word in chunks to both sides.  Grid points inside a run of a divisor of p are skipped: what they find is
that run again.  Periods are taken in ascending order, so a stretch is first met at its smallest period.

Texts don't depend on one another: there is no shuffle, and a task that runs again finds the same.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickmill.llm.chunks import release
from kickmill.llm.tables import small_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS_SCHEMA = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("text", pa.string())])
RUNS_TYPE = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"
#: Characters whose words are looked at together (or one longer text).
TOGETHER = 2_000_000

Prepare = Callable[[int | None, list[str]], list[str]]


class Numbers(dict):
    """Words get the next number when first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def reach(words: np.ndarray, at: int, period: int, step: int) -> int:
    """How many words on from ``at`` (step 1) or before it (step -1) equal those a period later, compared in growing chunks."""
    here, far = 0, len(words) - period - at if step > 0 else at
    size = 32
    while here < far:
        n = min(size, far - here)
        lo = at + here if step > 0 else at - here - n
        same = words[lo : lo + n] == words[lo + period : lo + period + n]
        if not same.all():
            return here + int(np.argmin(same if step > 0 else same[::-1]))
        here += n
        size = min(2 * size, 1 << 14)
    return here


def grid_runs(words: np.ndarray, ends: np.ndarray, sizes: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) in the numbered words of several texts.

    Texts are in descending order of size, each with a number of its own behind it that no word has; ``ends`` are the places of
    these.  ``times`` is at least 4: only then three grid points in a row lie in every run.
    """
    runs: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int]] = set()
    owner, period_of = np.full(len(words), -1, np.int64), [0]
    active = len(sizes)
    for p in range(1, int(sizes[0]) // times + 1 if len(sizes) else 0):
        while active and sizes[active - 1] < times * p:
            active -= 1
        if not active:
            break
        own = words[: ends[active - 1] + 1]
        grid = own[::p]
        same = grid[1:] == grid[:-1]
        points = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * p
        if not len(points):
            continue
        if runs:  # both points in a run of a divisor
            a = owner[points]
            points = points[~((a >= 0) & (a == owner[points + p]) & (p % np.array(period_of)[a] == 0))]
        for shift in (p // 2, p // 3, p + p // 2, 2 * p // 3):  # a run's first grid point has two periods of the run ahead
            if len(points) > 4:
                points = points[own[points + shift] == own[points + shift + p]]
        beyond = -1
        for at in points.tolist():
            if at < beyond:
                continue
            lo, beyond = at - reach(own, at, p, -1), at + reach(own, at, p, 1)
            length = beyond - lo + p
            if length >= max(least, times * p) and (lo, length) not in seen:
                seen.add((lo, length))
                owner[lo : lo + length] = len(runs)
                if len(period_of) <= len(runs):
                    period_of.append(0)
                period_of[len(runs)] = p
                runs.append((lo, length, p))
    return runs


def runs_of(texts: list[list[str]], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period), by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    order = [i for i in order if len(texts[i]) >= max(least, times)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not order:
        return out
    number = Numbers()
    parts = []
    for k, i in enumerate(order):
        parts += [np.fromiter(map(number.__getitem__, texts[i]), np.int64, len(texts[i])), np.array([-1 - k])]
    sizes = np.array([len(texts[i]) for i in order])
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    for start, length, period in sorted(grid_runs(np.concatenate(parts), ends, sizes, least, times), key=lambda r: (r[0], r[2])):
        k = int(np.searchsorted(ends, start))
        out[order[k]].append((start - int(begins[k]), length, period))
    return out


def groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most TOGETHER characters, or one text."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > TOGETHER:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """Words joined by spaces, without those in a run after its first period."""
    if not runs:
        return " ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return " ".join(compress(words, keep.tolist()))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4, prepare: Prepare | None = None) -> DataFrame:
    """One row per document: id_col, n_words, runs (start, length, period in words; by start, then period), and text collapsed.

    A run is a stretch of consecutive words with smallest period q (words q apart are the same) and at least ``least`` and ``times`` x q
    (``times`` from 4 on) words, which no neighbouring word extends.  ``text`` has the words joined by single spaces, without those that
    some run contains after its first q words.  ``prepare(id, words)`` may change the words before.

    Null and empty texts have no words, no runs and an empty text; a null id is kept.  Repeated rows give a row each.  Very long
    texts are taken whole, a text at a time, at about 100 bytes of memory a word.  An empty table gives an empty result.  Other
    columns are ignored, whatever their names.
    """
    if times < 4:
        raise ValueError("times must be at least 4")

    def per_batch(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sizes = [n or 0 for n in batch.column(2).to_pylist()]
            for lo, hi in groups(sizes):
                words = [WORD.findall(t) if t else [] for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                if prepare is not None:
                    words = [prepare(i, w) for i, w in zip(ids[lo:hi], words)]
                found = runs_of(words, least, times)
                rows = [[dict(zip(("start", "length", "period"), r)) for r in f] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi], pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array(rows, pa.list_(RUN)), pa.array(list(map(collapsed, words, found)), pa.string())], schema=RUNS_SCHEMA
                )
            release()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("size", F.char_length("text"))
    return rows.mapInArrow(per_batch, RUNS_TYPE).withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The contract's change: of every tenth id (by its checksum) the words from some place on repeat those there."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents, changed as the contract says; the longest run and digests of all of them."""
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), prepare=planted)
    # the greatest length, then the smallest start, then the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("finer"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.finer")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.finer")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
