"""Lookups between chunks of rows and buckets of keys.

A *chunk* is a set of rows (a few MB of text) that one Python call scans.  A scan asks about many
64-bit keys: it sorts and de-duplicates them, splits them over *buckets* and sends one packed blob
to each bucket.  A bucket sees the blobs of all chunks, answers with one code per key, and the
answers go back to the chunk, whose rows are grouped a second time (Spark reuses that exchange).

A key that occurs in a third of all rows still costs a bucket one entry per chunk, not per row, so
hot keys need no cap.  All steps are pure functions of the rows: a lost executor recomputes them.

There are at most as many blobs as entries.  While chunks x buckets is smaller they save Spark most of the cost of a row
per key; far beyond that (tens of TB) blobs of few entries remain, which is a plain shuffle by key.  Rows that are equal in
the columns that deal chunks (id and text) share a chunk, whatever their number.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickmill.llm.textscan import mix

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None

ODD = np.uint64(0x9FB21C651E98DF25)
BLOB = "chunk int, bucket int, blob binary"
ANSWER = BLOB + ", more binary"
ANSWER_ARROW = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary()), ("more", pa.binary())])
BLOB_ARROW = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])


def layout(rows: DataFrame, text: str, chunk_mb: float = 4.0, bucket_mb: float = 8.0) -> tuple[int, int]:
    """Numbers of chunks and buckets for these rows: one pass over text lengths."""
    total = rows.agg(F.sum(F.octet_length(F.col(text)).cast("long") + 64)).first()[0] or 0
    # from 1000 chunks on they grow, up to 16 MB, so that chunks x buckets stays small
    each = min(16e6, max(chunk_mb * 1e6, total / 1000))
    return max(1, round(total / each)), max(8, round(total / (bucket_mb * 1e6)) * 2)


def in_chunks(rows: DataFrame, n_chunks: int, *by: str) -> DataFrame:
    return rows.withColumn("chunk", F.pmod(F.xxhash64(*[F.col(c) for c in by]), F.lit(n_chunks)).cast("int"))


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Ranges of keys, which must be spread evenly: entries sorted by key are sorted by bucket."""
    return ((keys >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def together(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal combinations are adjacent, the same for any order of rows, and where each begins."""
    h = columns[0]
    for c in columns[1:]:
        h = mix(h + c * ODD)
    order = np.argsort(h)
    at = heads(*[c[order] for c in columns])
    if len(at) != len(heads(h[order])):  # different combinations of one hash
        order = np.lexsort(columns[::-1])
        at = heads(*[c[order] for c in columns])
    return order, at


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and how often each is there."""
    keys = np.sort(keys)
    at = heads(keys)
    return keys[at], np.diff(np.append(at, len(keys))).astype(np.int32)


def totals(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each entry the sum over all entries of its key."""
    order, at = together(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(np.add.reduceat(n[order].astype(np.int64), at) if len(at) else at, np.diff(np.append(at, len(keys))))
    return out


def least_of(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(values, at) if len(at) else values[:0]


def ask(chunk: int, keys: np.ndarray, columns: list[np.ndarray], n_buckets: int) -> pa.Table:
    """Blobs for the entries, which must be sorted by (bucket, key); columns have one item per entry."""
    edges = np.searchsorted(bucket_of(keys, n_buckets), np.arange(n_buckets + 1))
    full = np.flatnonzero(np.diff(edges))
    blobs = [np.int64(edges[b + 1] - edges[b]).tobytes() + b"".join(c[edges[b] : edges[b + 1]].tobytes() for c in columns) for b in full]
    return pa.table([pa.array(np.full(len(full), chunk, np.int32)), pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], schema=BLOB_ARROW)


def unpack(blob: bytes, dtypes: list) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for t in dtypes:
        out.append(np.frombuffer(blob, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def answer(requests: DataFrame, dtypes: list, decide: Callable[..., tuple[np.ndarray, list[np.ndarray]]]) -> DataFrame:
    """decide(*columns of all blobs of a bucket, chunk of each entry) -> one uint8 per entry, and columns; by chunk go back
    the codes, and the columns of entries of code 1.
    """

    def per_bucket(table):
        # in the order of chunks, as blobs may arrive in another one when a task runs again
        chunks, blobs = table.column("chunk").to_numpy(), table.column("blob").to_pylist()
        sort = np.argsort(chunks)
        chunks, parts = chunks[sort], [unpack(blobs[i], dtypes) for i in sort]
        sizes = np.array([len(p[0]) for p in parts])
        codes, columns = decide(*[np.concatenate([p[i] for p in parts]) for i in range(len(dtypes))], np.repeat(chunks, sizes))
        codes = codes.astype(np.uint8)
        ends = np.cumsum(sizes)
        own = [slice(e - n, e) for e, n in zip(ends, sizes)]
        more: list[bytes | None] = [None] * len(own)
        if columns:
            more = [np.int64((codes[o] == 1).sum()).tobytes() + b"".join(c[o][codes[o] == 1].tobytes() for c in columns) for o in own]
        release()
        bucket = pa.array(np.full(len(own), table.column("bucket")[0].as_py(), np.int32))
        return pa.table([pa.array(chunks), bucket, pa.array([codes[o].tobytes() for o in own], pa.binary()), pa.array(more, pa.binary())], schema=ANSWER_ARROW)

    return requests.groupBy("bucket").applyInArrow(per_bucket, ANSWER)


def codes_in_order(answers: pa.Table) -> np.ndarray:
    """The codes of a chunk's entries, in the order in which it asked."""
    if not answers.num_rows:
        return np.zeros(0, np.uint8)
    order = np.argsort(answers.column("bucket").to_numpy())
    blobs = answers.column("blob").to_pylist()
    return np.frombuffer(b"".join(blobs[i] for i in order), np.uint8)


def more_in_order(answers: pa.Table, dtypes: list) -> list[np.ndarray]:
    """The further columns for a chunk's entries of code 1, in the order in which it asked."""
    order = np.argsort(answers.column("bucket").to_numpy()) if answers.num_rows else []
    blobs = answers.column("more").to_pylist()
    parts = [unpack(blobs[i], dtypes) for i in order]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate(dtypes)]


def release() -> None:
    """Give memory that is free in this worker back, for the other workers and the JVM of its executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def heads(*sorted_columns: np.ndarray) -> np.ndarray:
    """Positions at which a new combination begins."""
    if not len(sorted_columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(sorted_columns[0]), bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def runs(at: np.ndarray, n: int) -> np.ndarray:
    """For each of n items the number of the run that began last."""
    return np.repeat(np.arange(len(at)), np.diff(np.append(at, n)))
