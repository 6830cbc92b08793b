"""Removal of long repeated byte strings with a run-length Burrows-Wheeler index.

1. *Partitioning.*  Each window of ``width`` bytes is reached through its anchor, the ``GRAM`` bytes of least hash in it;
   equal windows have equal anchors.  Consecutive windows with one anchor form a *stretch* of text.  Chunks of documents
   send the hashes of stretches to buckets, which tell which occur again as a whole and name one holder of each.  Holders
   send their anchors with the number of stretches, so an anchor's bucket tells how many different ones share it.
2. *Index.*  Only the latter are sent as text, each distinct one once.  Stretches of a frequent anchor are first cut by the
   anchor's place in the window into *items*, keyed by the bytes that all windows of an item share; so items
   of a frequent phrase go to many buckets.  A bucket works in parts of at most ``PART`` bytes: it builds the Burrows-Wheeler
   transform of a part, compresses it into runs, and samples at the two ends of each run (and at the starts of items) the suffix
   and its longest common prefix with the neighbouring suffix (irreducible values).
3. *Matching statistics* then stream over the text: the longest match of position i with any other position is the
   largest of sample(j) - (i - j) for j <= i.  Windows whose match reaches ``width`` are marked.
4. The marks go back to the documents, where covered bytes are cut out.

Whole stretches are equal if two independent 64-bit hashes are (one of them BLAKE2b); all else is decided by comparing bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kickmill.llm import chunks as C
from kickmill.llm.textscan import BASE, BASE_INVERSE, BYTE_CODE, U64, blocks, buffers, mix, powers

#: Bytes of an anchor; windows that are scanned together; bits of a position there.
GRAM, SEGMENT, POSITION_BITS = 64, 1 << 19, 24
#: Between items; no byte of UTF-8 text.
SEPARATOR = 0xFF
#: Bytes that are indexed at once: about 150 bytes of memory each.
PART = 1 << 20
#: Different stretches of an anchor that are not cut; each doubling cuts once more, up to MOST_CUTS times before they are sent.
UNCUT, MOST_CUTS = 512, 6


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i : i + width]) for every i, by minima from both ends of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


@dataclass
class Items:
    """Stretches or parts of them: ``key``, the anchor's ``place`` in the text, ``count`` of windows, whether ``asked`` about, first byte ``at``."""

    key: np.ndarray
    place: np.ndarray
    count: np.ndarray
    asked: np.ndarray
    at: np.ndarray

    def blobs(self, data: np.ndarray, width: int, n_buckets: int) -> tuple[np.ndarray, list[bytes]]:
        """(bucket, blob): number, keys, places, counts, asked, texts."""
        edges = np.searchsorted(C.bucket_of(self.key, n_buckets), np.arange(n_buckets + 1))
        full = np.flatnonzero(np.diff(edges))
        blobs = []
        for b in full:
            own = slice(edges[b], edges[b + 1])
            texts = [data[x:y].tobytes() for x, y in zip(self.at[own].tolist(), (self.at[own] + self.count[own] + width - 1).tolist())]
            blobs.append(b"".join([np.int64(len(texts)).tobytes(), *(c[own].tobytes() for c in (self.key, self.place, self.count, self.asked)), *texts]))
        return full, blobs


class Stretches:
    """Stretches of a chunk: ``start`` (first window, byte in ``data``), ``count`` of windows, ``anchor`` and ``path`` hashes."""

    def __init__(self, table: pa.Table, width: int):
        self.width = width
        self.data, self.offsets = buffers(table.column("text"))
        data, gram = self.data, min(GRAM, width)
        end = np.repeat(self.offsets[1:], np.diff(self.offsets)) if len(data) < (64 << 20) else None
        start, count, anchor, path, place = [], [], [], [], []
        for lo, hi in self.ranges():
            own = data[lo : hi + width - 1]
            total = np.zeros(len(own) + 1, U64)
            np.cumsum(BYTE_CODE[own] * powers(BASE, len(own)), out=total[1:])
            grams = mix((total[gram:] - total[:-gram]) * powers(BASE_INVERSE, len(own) + 1)[: len(own) - gram + 1])
            key = (grams >> U64(POSITION_BITS) << U64(POSITION_BITS)) | np.arange(len(grams), dtype=U64)
            at = (window_minimum(key, width - gram + 1) & U64((1 << POSITION_BITS) - 1)).astype(np.int64)
            ends = end[lo:hi] if end is not None else self.offsets[np.searchsorted(self.offsets, np.arange(lo, hi), side="right")]
            inside = np.flatnonzero(np.arange(lo, hi) + width <= ends)
            if not len(inside):
                continue
            a = at[inside]
            begin = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (inside[1:] != inside[:-1] + 1))))
            n = np.diff(np.append(begin, len(inside)))
            s = inside[begin]
            e = s + n - 1 + width
            start.append(lo + s)
            count.append(n)
            anchor.append(mix(grams[a[begin]]))  # least hashes, spread again
            path.append(mix(mix((total[e] - total[s]) * powers(BASE_INVERSE, len(own) + 1)[s]) + (a[begin] - s).astype(U64)))
            place.append(a[begin] - s)
        join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
        self.start, self.count, self.anchor, self.path, self.place = join(start, np.int64), join(count, np.int64), join(anchor, U64), join(path, U64), join(place, np.int64)
        order, at = C.together(self.path, self.anchor)
        sort = np.argsort(self.path[order[at]])
        self.lead, self.times = order[at][sort], np.diff(np.append(at, len(order)))[sort]
        number = np.empty(len(sort), np.int64)
        number[sort] = np.arange(len(sort))
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = number[C.runs(at, len(order))]

    def ranges(self):
        """Ranges of windows.  They are cut at documents, and inside long ones relative to their start, never by the order of rows."""
        for a, b in blocks(self.offsets, SEGMENT):
            last = int(self.offsets[b]) - self.width + 1
            step = SEGMENT if b == a + 1 else max(1, last - int(self.offsets[a]))
            for lo in range(int(self.offsets[a]), last, step):
                yield lo, min(lo + step, last)

    def second_hash(self) -> np.ndarray:
        """BLAKE2b of each entry's bytes, independent of ``path``."""
        data, at = self.data.tobytes(), self.start[self.lead]
        ends = at + self.count[self.lead] + self.width - 1
        return np.frombuffer(b"".join([blake2b(data[a:b], digest_size=8).digest() for a, b in zip(at.tolist(), ends.tolist())]), U64)

    def anchors(self, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The anchors of the stretches that are held here (codes 0 and 2), and their numbers."""
        return C.counted(self.anchor[self.lead[paths % 2 == 0]])

    def codes(self, paths: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Of each entry, from the buckets' answers: 0 unique, 1 repeated; for holders 2 + 2 x cuts to be indexed, plus 1 if repeated."""
        out = (paths > 0).astype(np.uint8)
        held = np.flatnonzero(paths % 2 == 0)
        if len(held):
            told = cuts[np.searchsorted(self.anchors(paths)[0], self.anchor[self.lead[held]])].astype(np.uint8)
            out[held] += np.where(told > 0, 2 * told, 0).astype(np.uint8)
        return out

    def items(self, codes: np.ndarray, n_buckets: int) -> Items:
        """What goes to the index, by bucket: stretches of codes 2, 3 (uncut), 4, 5 (cut in 2), 6, 7 (cut in 4), ...; odd codes don't ask."""
        gram, data = min(GRAM, self.width), self.data.tobytes()
        entry = np.flatnonzero(codes >= 2)
        lead, cuts = self.lead[entry], (codes[entry] - 2) // 2
        parts = [(entry[cuts == 0], np.zeros((cuts == 0).sum(), np.int64), self.count[lead[cuts == 0]], self.anchor[lead[cuts == 0]])]
        for level in np.unique(cuts[cuts > 0]):
            own, n_places = entry[cuts == level], self.width - gram + 1
            at, n, place = self.start[self.lead[own]], self.count[self.lead[own]], self.place[self.lead[own]]
            edges = np.arange((1 << int(level)) + 1) * n_places >> int(level)
            for low, high in zip(edges[:-1], edges[1:] - 1):  # the anchor's place in the window
                a, b = np.clip(place - high, 0, n), np.clip(place - low + 1, 0, n)
                some = np.flatnonzero(a < b)
                begin, end = (at + place - low)[some], (at + place - high + self.width)[some]
                keys = [blake2b(data[x:y], digest_size=8, salt=b"%d" % low).digest() for x, y in zip(begin.tolist(), end.tolist())]
                parts.append((own[some], a[some], b[some], np.frombuffer(b"".join(keys), U64)))
        entry, first, last, key = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(C.bucket_of(key, n_buckets), kind="stable")
        entry, first, last, key = entry[order], first[order], last[order], key[order]
        lead = self.lead[entry]
        return Items(key, (self.place[lead] - first).astype(np.int32), (last - first).astype(np.int32), (codes[entry] % 2 == 0).astype(np.uint8), self.start[lead] + first)

    def repeated(self, codes: np.ndarray, items: Items, marks: np.ndarray) -> np.ndarray:
        """For each byte the number of repeated windows that start there (0 or 1)."""
        hit = np.zeros(len(self.data) + 1, np.int8)
        if not len(self.entry):
            return hit
        at = np.flatnonzero((codes % 2 == 1)[self.entry])  # repeated as a whole
        n = self.count[at]
        hit[np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())] = 1
        asked = items.asked == 1
        n = items.count[asked].astype(np.int64)
        place = np.repeat(items.at[asked] - np.cumsum(n) + n, n) + np.arange(n.sum())
        hit[place[marks == 1]] = 1
        return hit


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling from 8-byte keys; only ties are sorted again.  Texts have less than 2**31 bytes."""
    n = len(text)
    key = np.zeros(n, U64)
    for i in range(min(8, n)):
        key[: n - i] |= text[i:].astype(U64) << U64(56 - 8 * i)
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    del key
    step = 8
    rank = np.empty(n, np.int32)
    tied = np.arange(n)
    while True:
        # of a tie: its first row
        head = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
        rank[order[tied]] = head[tied]
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            return order
        suffix = order[tied]
        further = suffix.astype(np.int64) + step
        # what ends before is less, the shorter the less
        both = (head[tied].astype(U64) << U64(32)) | np.where(further < n, rank[np.minimum(further, n - 1)] + 9, np.minimum(n - suffix, 8)).astype(U64)
        del head, further
        resorted = np.argsort(both)
        order[tied] = suffix[resorted]
        both = both[resorted]
        new[tied[1:]] = both[1:] != both[:-1]
        new[tied[0]] = True
        step *= 2


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes a and b, up to ``most`` (rounded up to whole words)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), "<u8", padded.data, strides=(1,))
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(a != b)
    x, y = a[live].astype(np.int64), b[live].astype(np.int64)
    for _ in range(0, most, 8):
        differ = words[x] ^ words[y]
        # the lowest bit that differs lies in the first byte that does
        low = differ & (~differ + U64(1))
        size = np.where(differ == 0, 8, np.log2(np.maximum(low, U64(1)).astype(np.float64)).astype(np.int64) // 8)
        size = np.minimum(size, n - np.maximum(x, y))
        out[live] += size
        on = np.flatnonzero((size == 8) & (np.maximum(x, y) + 8 < n))
        if not len(on):
            break
        live, x, y = live[on], x[on] + 8, y[on] + 8
    return out


class RunIndex:
    """The run-length Burrows-Wheeler transform of a text: ``run`` characters, ``length``s, and samples at run ends and at ``starts``."""

    def __init__(self, text: np.ndarray, most: int, starts: np.ndarray | None = None):
        rows = suffix_array(text)
        self.n = n = len(text)
        last = text[rows - 1]  # the row of suffix 0 gets the text's end
        head = C.heads(last)
        self.run, self.length = last[head], np.diff(np.append(head, n)).astype(np.int32)
        del last
        self.first = int(np.flatnonzero(rows == 0)[0]) if n else 0
        starts = np.zeros(0, np.int64) if starts is None else starts
        place = np.empty(n, np.int32)
        place[rows] = np.arange(n, dtype=np.int32)
        # a text's start has no character before it, and matches are followed to the ends of items only: their rows are sampled too
        own = place[np.append(starts, 0)].astype(np.int64) if n else np.zeros(0, np.int64)
        del place
        ends = np.cumsum(self.length, dtype=np.int64)
        begin, final = ends - self.length, ends - 1
        around = np.array([self.first + 1]) if n else begin[:0]
        up = np.concatenate([begin, own, around])  # with the row above
        down = np.concatenate([final, own, around - 2])  # with the row below
        up, down = up[(up > 0) & (up < n)], down[(down >= 0) & (down < n - 1)]
        self.suffix = np.concatenate([rows[up], rows[down]]).astype(np.int64)
        other = np.concatenate([rows[up - 1], rows[down + 1]]).astype(np.int64)
        del rows
        self.common = common_prefix(text, self.suffix, other, most)

    def matching_statistics(self) -> np.ndarray:
        """Longest match of each position with any other position of the text, streamed from the samples."""
        reach = np.zeros(self.n, np.int64)
        np.maximum.at(reach, self.suffix, self.common + self.suffix)
        return np.maximum(np.maximum.accumulate(reach) - np.arange(self.n), 0)

    def restored(self) -> np.ndarray:
        """The text, read back from the runs alone by last-to-first steps."""
        out = np.empty(self.n, np.uint8)
        if not self.n:
            return out
        # the text's end stands in the row of suffix 0, but precedes the empty suffix, which is before all others
        rows = np.repeat(self.run, self.length)
        last = np.concatenate([rows[self.first : self.first + 1], rows[: self.first], rows[self.first + 1 :]])
        step = np.empty(self.n, np.int64)
        step[np.argsort(last, kind="stable")] = np.arange(self.n)
        at = 0
        for i in range(self.n - 1, -1, -1):
            out[i] = last[at]
            row = int(step[at])
            at = row + 1 if row < self.first else row
        return out


class Bucket:
    """The items of a bucket and the marks of their windows."""

    def __init__(self, items: Items, data: bytes, width: int, part: int):
        self.items, self.data, self.width, self.part = items, data, width, part
        self.base = np.cumsum(items.count, dtype=np.int64) - items.count
        self.marks = np.zeros(int(items.count.sum()), np.uint8)
        self.waiting: list[tuple[int, int, int]] = []
        self.bytes = 0

    def text(self, i: int, a: int, b: int) -> bytes:
        """Of the windows a .. b - 1 of item i."""
        at = int(self.items.at[i])
        return self.data[at + a : at + b - 1 + self.width]

    def mark(self, i: int, a: int, b: int) -> None:
        self.marks[self.base[i] + a : self.base[i] + b] = 1

    def run(self) -> np.ndarray:
        order = np.argsort(self.items.key, kind="stable")
        edges = np.append(C.heads(self.items.key[order]), len(order))
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > 1:  # what is alone with its key shares no window
                self.group([(int(i), 0, int(self.items.count[i])) for i in order[a:b]])
        self.flush()
        return self.marks

    def group(self, members: list[tuple[int, int, int]]) -> None:
        """Windows of members that share their key: equal texts are marked, the different ones indexed, in halves if they are too long."""
        seen: dict[bytes, tuple[int, int, int]] = {}
        for m in members:
            if (other := seen.setdefault(self.text(*m), m)) is not m:
                self.mark(*m)
                self.mark(*other)
        if len(seen) < 2:
            return
        members = list(seen.values())
        size = sum(map(len, seen)) + len(seen)
        place = self.items.place
        low, high = min(int(place[i]) - b + 1 for i, _, b in members), max(int(place[i]) - a for i, a, _ in members)
        if size <= self.part or low == high:  # of one window each, and all different
            if low < high:
                if self.bytes + size > self.part:
                    self.flush()
                self.waiting += members
                self.bytes += size
            return
        middle = (low + high + 1) // 2
        for least, most in ((low, middle - 1), (middle, high)):
            shared: dict[bytes, list[tuple[int, int, int]]] = {}
            for i, a, b in members:
                p, at = int(place[i]), int(self.items.at[i])
                x, y = max(a, p - most), min(b, p - least + 1)
                if x < y:  # all its windows have the bytes from the first one's anchor place to the last one's end
                    shared.setdefault(self.data[at + p - least : at + p - most + self.width], []).append((i, x, y))
            for own in shared.values():
                if len(own) > 1:
                    self.group(own)

    def flush(self) -> None:
        """Index what waits."""
        if not self.waiting:
            return
        sep = bytes([SEPARATOR])
        texts = [self.text(*m) for m in self.waiting]
        sizes = np.array([len(t) + 1 for t in texts])
        first = np.cumsum(sizes) - sizes
        joined = np.frombuffer(sep.join(texts) + sep, np.uint8)
        found = RunIndex(joined, int(sizes.max()), first).matching_statistics() >= self.width
        for (i, a, b), at in zip(self.waiting, first.tolist()):
            self.marks[self.base[i] + a : self.base[i] + b] |= found[at : at + b - a]
        self.waiting, self.bytes = [], 0


def marks_of_blobs(blobs: Iterator[bytes], width: int, part: int = PART) -> list[bytes]:
    """For each blob the marks of the windows that it asks about."""
    blobs = list(blobs)
    columns, texts, ends = [], [], [0]
    for b in blobs:
        n = int(np.frombuffer(b, np.int64, 1)[0])
        columns.append([np.frombuffer(b, t, n, 8 + n * skip) for t, skip in ((U64, 0), (np.int32, 8), (np.int32, 12), (np.uint8, 16))])
        texts.append(memoryview(b)[8 + 17 * n :])
        ends.append(ends[-1] + n)
    key, place, count, asked = (np.concatenate(c) for c in zip(*columns))
    size = count.astype(np.int64) + width - 1
    data = b"".join(texts)
    del texts, blobs
    marks = Bucket(Items(key, place, count, asked, np.cumsum(size) - size), data, width, part).run()
    marks, n = marks[np.repeat(asked == 1, count)], np.append(0, np.cumsum(np.where(asked == 1, count, 0)))[ends]
    return [marks[a:b].tobytes() for a, b in zip(n[:-1], n[1:])]


def codes_of(answers: pa.Table, n: int) -> list[np.ndarray]:
    """The codes of rounds 1 .. n."""
    rounds = answers.column("round").to_numpy()
    return [C.codes_in_order(answers.filter(pa.array(rounds == r))) for r in range(1, n + 1)]


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400, carry: Sequence[str] = (), part: int = PART, uncut: int = UNCUT) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that starts anywhere else, the same document included.

    Texts are UTF-8 bytes; matches never cross documents; strings are judged on the input.  Returns ``id_col``, the columns
    ``carry``, ``kept`` (binary: the remaining bytes, which may split characters), ``n_bytes``, ``n_removed`` and ``spans``
    (maximal removed runs [start, end) in bytes), one row per input row.  ``part`` and ``uncut`` bound memory and change no result.

    Null text is empty.  The id plays no part, so null and repeated ids are allowed; repeated rows are copies of
    each other.  An empty table gives an empty result.  Other columns are ignored.
    """
    carry = list(carry)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("carry"))
    n_chunks, n_buckets = C.layout(rows, "text")
    grouped = C.in_chunks(rows, n_chunks, "id", "text").groupBy("chunk")

    def ask_paths(key, table):
        s = Stretches(table, width)
        path = s.path[s.lead]
        return C.ask(key[0].as_py(), path, [path, s.second_hash(), np.minimum(s.times, 2).astype(np.uint8)], n_buckets)

    def judge_paths(path, second, times, chunk):
        order, at = C.together(path, second)
        total = np.add.reduceat(times[order].astype(np.int64), at) if len(at) else at
        code = (total > 1).astype(np.uint8)[C.runs(at, len(order))]
        code[at[total > 1]] = 2  # one holder of what is repeated
        codes = np.empty(len(order), np.uint8)
        codes[order] = code
        return codes, []

    def ask_anchors(key, table, answers):
        anchors, n = Stretches(table, width).anchors(C.codes_in_order(answers))
        return C.ask(key[0].as_py(), anchors, [anchors, n], n_buckets)

    def judge_anchors(anchor, n, chunk):
        """0 for an anchor of one stretch, else 1 and how often its stretches are cut in two."""
        total = C.totals(anchor, n)
        cuts = np.clip(np.ceil(np.log2(total / uncut)), 0, MOST_CUTS).astype(np.uint8)
        return np.where(total > 1, 1 + cuts, 0), []

    def ask_texts(key, table, answers):
        s = Stretches(table, width)
        bucket, blobs = s.items(s.codes(*codes_of(answers, 2)), n_buckets).blobs(s.data, width, n_buckets)
        return pa.table([pa.array(np.full(len(blobs), key[0].as_py(), np.int32)), pa.array(bucket.astype(np.int32)), pa.array(blobs, pa.binary())], schema=C.BLOB_ARROW)

    def judge_texts(table):
        parts = marks_of_blobs((x.as_py() for x in table.column("blob")), width, part)
        C.release()
        return pa.table([table.column("chunk"), table.column("bucket"), pa.array(parts, pa.binary())], schema=C.BLOB_ARROW)

    out_type = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("carry", rows.schema["carry"].dataType)])

    def cut(key, table, answers):
        s = Stretches(table, width)
        paths, cuts, marks = codes_of(answers, 3)
        codes = s.codes(paths, cuts)
        hit = s.repeated(codes, s.items(codes, n_buckets), marks)
        change = hit[:-1].astype(np.int32)
        change[width:] -= hit[:-1][:-width] if len(change) > width else hit[:0]
        gone = np.cumsum(change) > 0
        sizes = np.append(0, np.cumsum(~gone))
        kept = pa.Array.from_buffers(pa.large_binary(), len(s.offsets) - 1, [None, pa.py_buffer(sizes[s.offsets].astype(np.int64)), pa.py_buffer(s.data[~gone])]).cast(pa.binary())
        # runs, cut at the ends of documents
        before = np.concatenate(([False], gone[:-1])) if len(gone) else gone
        before[s.offsets[:-1][s.offsets[:-1] < len(gone)]] = False
        after = np.concatenate((gone[1:], [False])) if len(gone) else gone
        after[s.offsets[1:][s.offsets[1:] > 0] - 1] = False
        a, b = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
        row = np.searchsorted(s.offsets, a, side="right") - 1
        lists = pa.array(np.searchsorted(row, np.arange(len(s.offsets))).astype(np.int32))
        spans = pa.ListArray.from_arrays(lists, pa.StructArray.from_arrays([pa.array(a - s.offsets[row]), pa.array(b - s.offsets[row])], ["start", "end"]))
        n_bytes = np.diff(s.offsets)
        C.release()
        return pa.table({id_col: table.column("id"), "kept": kept, "n_bytes": n_bytes, "n_removed": n_bytes - np.diff(sizes[s.offsets]), "spans": spans, "carry": table.column("carry")})

    paths = C.answer(grouped.applyInArrow(ask_paths, C.BLOB), [np.uint64, np.uint64, np.uint8], judge_paths).withColumn("round", F.lit(1))
    anchors = C.answer(grouped.cogroup(paths.groupBy("chunk")).applyInArrow(ask_anchors, C.BLOB), [np.uint64, np.int32], judge_anchors).withColumn("round", F.lit(2))
    both = paths.unionByName(anchors).drop("more")
    texts = grouped.cogroup(both.groupBy("chunk")).applyInArrow(ask_texts, C.BLOB)
    marks = texts.groupBy("bucket").applyInArrow(judge_texts, C.BLOB)
    both = both.unionByName(marks.withColumn("round", F.lit(3)))
    out = grouped.cogroup(both.groupBy("chunk")).applyInArrow(cut, out_type)
    return out.select(id_col, *[F.col(f"carry.c{i}").alias(c) for i, c in enumerate(carry)], "kept", "n_bytes", "n_removed", "spans")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: 400-byte strings over all documents."""
    out = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=400)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))
