"""Substring de-duplication on a compacted De Bruijn graph of token k-mers.

Windows of ``k`` words are the edges of a De Bruijn graph.  Each window is reached through its
*node*: the ``k // 2 + 1`` words of least hash inside it, which is the same for equal windows wherever they
occur.  The consecutive windows of a document that share a node form one *path*, kept as (node, hash of the path) instead of
edge by edge.  A node's degree is its number of different paths; with one path it doesn't branch.

1. Every chunk of documents sends its distinct (path, least doc_id, place) to the path's bucket, which answers whether an earlier
   document holds it (all its windows repeat), with the *source coordinates* of the first holder (chunk, document, word).
2. First holders send each node with the number of their paths; the node's bucket adds up the degree.
3. Only for branching nodes the first holders send single windows (edges), to be compared like paths.
4. *Compaction.*  Repeated windows that follow each other in the copy and in the source are one long nonbranching path.  Its
   coordinates and the digest of its words are aggregated by Spark (equal paths of many copies become one row)
   and joined with the documents by the source's chunk, where the words at the coordinates are digested too.
5. *Verification.*  What differs is not cut.  The rest is joined back to the documents and cut out.

Paths and windows are told apart by two independent hashes (64 and 32 bits), verified spans by BLAKE2b of their words.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kickmill.llm import chunks as C
from kickmill.llm.textscan import CHAIN_2_INVERSE, CHAIN_INVERSE, U64, Words, blocks, buffers, mix, powers, sliding_argmin

NO_ID = np.iinfo(np.int64).max
#: Source coordinates: chunk, id and word.
SOURCE = [np.int32, np.int64, np.int32]
INVERSES = (CHAIN_INVERSE, CHAIN_2_INVERSE)
REQUEST = "chunk int, id long, place int, words int, digest binary"


def firsts(order: np.ndarray, at: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each combination the least id, and the first place there."""
    least = C.least_of(owner[order], at)
    held = owner[order] == np.repeat(least, np.diff(np.append(at, len(order))))
    return least, C.least_of(np.where(held, place[order], np.iinfo(np.int32).max).astype(np.int32), at)


def first_holders(order: np.ndarray, at: np.ndarray, owner: np.ndarray, place: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Code 1 for the entries of which a smaller id holds the same, and the coordinates of each one's first holder."""
    least, first = firsts(order, at, owner, place)
    size = np.diff(np.append(at, len(order)))
    held = (owner[order] == np.repeat(least, size)) & (place[order] == np.repeat(first, size))
    where = C.least_of(np.where(held, chunk[order], np.iinfo(np.int32).max).astype(np.int32), at)
    codes, told = np.empty(len(order), np.uint8), [np.empty(len(order), t) for t in SOURCE]
    codes[order] = owner[order] > np.repeat(least, size)
    for own, value in zip(told, (where, least, first)):
        own[order] = np.repeat(value, size)
    return codes, told


def distinct(keys: list[np.ndarray], owner: np.ndarray, place: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Different combinations of keys, sorted by the first, with their least id and first place, and for each row its combination."""
    order, at = C.together(*keys)
    least, first = firsts(order, at, owner, place)
    lead = order[at]
    sort = np.argsort(keys[0][lead])
    number = np.empty(len(sort), np.int64)
    number[sort] = np.arange(len(sort))
    entry = np.empty(len(order), np.int64)
    entry[order] = np.repeat(number, np.diff(np.append(at, len(order))))
    return [c[lead][sort] for c in keys], least[sort], first[sort], entry


def rounds_of(answers: pa.Table, n: int) -> list[pa.Table]:
    """The answers of rounds 1 .. n."""
    rounds = answers.column("round").to_numpy()
    return [answers.filter(pa.array(rounds == r)) for r in range(1, n + 1)]


def half(hashes: np.ndarray) -> np.ndarray:
    """32 bits of the second hash: with the first one's 64 they tell apart what is then verified anyway."""
    return (hashes >> U64(32)).astype(np.uint32)


def digest(words: list[bytes]) -> bytes:
    return blake2b(b" ".join(words), digest_size=16).digest()


@dataclass
class Sources:
    """Where each window's words also start in an earlier document (``hit``): chunk, id and word there."""

    hit: np.ndarray
    chunk: np.ndarray
    doc: np.ndarray
    place: np.ndarray

    def put(self, at: np.ndarray, chunk, doc, place) -> None:
        self.hit[at], self.chunk[at], self.doc[at], self.place[at] = True, chunk, doc, place


class Paths:
    """The paths of one chunk's documents.  Rows without an id take no part.

    ``bits``: of the first hash that are used; fewer only to test what the second one does.
    """

    def __init__(self, table: pa.Table, k: int, bits: int = 64):
        self.k, self.m = k, k // 2 + 1
        keep = U64((1 << bits) - 1)
        ids = table.column("id").combine_chunks() if isinstance(table.column("id"), pa.ChunkedArray) else table.column("id")
        has_id = ~np.asarray(ids.is_null())
        self.ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        data, self.offsets = buffers(table.column("text"))
        self.data = data
        node, path, path_2, doc, first, count, place, self.words, self.sums = [], [], [], [], [], [], [], [], []
        n_windows = 0
        for lo, hi in blocks(self.offsets):
            start, stop = self.offsets[lo], self.offsets[hi]
            w = Words(data[start:stop], self.offsets[lo : hi + 1] - start, twice=True)
            grams = w.grams(self.m)
            at = sliding_argmin(grams, k - self.m + 1)
            windows = np.flatnonzero((w.room()[: len(at)] >= k) & has_id[lo + w.doc[: len(at)]])
            anchor, of = at[windows], w.doc[windows]
            begin = C.heads(anchor, of)
            end = np.append(begin[1:], len(windows))
            s, e = windows[begin], windows[end - 1] + k if len(begin) else windows[begin]
            node.append(mix(grams[anchor[begin]]))  # least hashes, spread again
            sums = w.chained(), w.chained(True)
            # the same words around another place of the node would be another path
            for total, found, inverse in zip(sums, (path, path_2), INVERSES):
                found.append(mix(mix((total[e] - total[s]) * powers(inverse, len(total))[s]) + (anchor[begin] - s).astype(U64)))
            doc.append(lo + of[begin])
            first.append(n_windows + begin)
            count.append(end - begin)
            self.sums.append((n_windows, windows, sums))
            place.append(windows - w.first[of])
            self.words.append((lo, hi, start, w.start, w.end, w.first, windows, n_windows))
            n_windows += len(windows)
        join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
        node, path, path_2, self.n, self.keep = join(node, U64), join(path, U64) & keep, half(join(path_2, U64)), n_windows, keep
        self.doc, self.first, self.count, self.place = join(doc, np.int64), join(first, np.int64), join(count, np.int64), join(place, np.int64).astype(np.int32)
        self.owner = self.ids[self.doc] if len(self.doc) else np.zeros(0, np.int64)
        at_path = self.place[self.first] if len(self.first) else self.place
        # equal paths have equal nodes
        (self.path, self.path_2), self.least, self.least_place, self.entry = distinct([path, path_2], self.owner, at_path)
        self.node = np.zeros(len(self.path), U64)
        self.node[self.entry] = node

    def edges(self, at: np.ndarray) -> list[np.ndarray]:
        """Both hashes of the windows ``at``, which ascend."""
        out: list[list[np.ndarray]] = [[np.zeros(0, U64)], [np.zeros(0, U64)]]
        for base, windows, sums in self.sums:
            s = windows[at[np.searchsorted(at, base) : np.searchsorted(at, base + len(windows))] - base]
            for found, total, inverse in zip(out, sums, INVERSES):
                found.append(mix((total[s + self.k] - total[s]) * powers(inverse, len(total))[s]))
        return [np.concatenate(out[0]) & self.keep, half(np.concatenate(out[1]))]

    def nodes(self, paths: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of the paths that are first held here, and their numbers of such paths."""
        return C.counted(self.node[C.codes_in_order(paths) == 0])

    def open_edges(self, paths: pa.Table, nodes: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        """[hashes, least id and place] of the distinct windows of the branching paths first held here, and for each window of the chunk its place among them or -1."""
        held = np.zeros(0, np.int64)
        if len(self.entry):
            first, known = C.codes_in_order(paths) == 0, self.nodes(paths)[0]
            branching = np.zeros(len(first), bool)
            branching[first] = (C.codes_in_order(nodes) == 1)[np.searchsorted(known, self.node[first])]
            # a document can hold its path more than once
            held = np.flatnonzero(branching[self.entry] & (self.owner == self.least[self.entry]))
        count = self.count[held]
        at = np.repeat(self.first[held] - np.append(0, np.cumsum(count))[:-1], count) + np.arange(count.sum())
        keys, least, place, own = distinct(self.edges(at), np.repeat(self.owner[held], count), self.place[at])
        entry = np.full(self.n, -1, np.int64)
        entry[at] = own
        return [*keys, least, place], entry

    def sources(self, chunk: int, paths: pa.Table, nodes: pa.Table, edges: pa.Table) -> Sources:
        """For each window whether an equal one starts in a document with a smaller id, and where."""
        n = self.n
        out = Sources(np.zeros(n, bool), np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int32))
        if not len(self.entry):
            return out
        codes = C.codes_in_order(paths)
        first = self.first_holders(chunk, codes, self.least, self.least_place, paths)
        gone = np.flatnonzero((codes[self.entry] == 1) | (self.owner > self.least[self.entry]))
        count, entry = self.count[gone], self.entry[gone]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(self.first[gone], count) + step
        out.put(at, *(np.repeat(x[entry], count) for x in first[:2]), np.repeat(first[2][entry], count) + step)
        (_, _, least, place), entry = self.open_edges(paths, nodes)
        at = np.flatnonzero(entry >= 0)
        if len(at):
            codes = C.codes_in_order(edges)
            first = self.first_holders(chunk, codes, least, place, edges)
            at = at[(codes[entry[at]] == 1) | (np.repeat(self.owner, self.count)[at] > least[entry[at]])]
            at = at[~out.hit[at]]
            out.put(at, *(x[entry[at]] for x in first))
        return out

    @staticmethod
    def first_holders(chunk: int, codes: np.ndarray, least: np.ndarray, place: np.ndarray, answers: pa.Table) -> list[np.ndarray]:
        """(chunk, id, word) of each entry's first holder: an earlier one elsewhere, or this chunk's."""
        out = [np.full(len(codes), chunk, np.int32), least.copy(), place.copy()]
        for own, told in zip(out, C.more_in_order(answers, SOURCE)):
            own[codes == 1] = told
        return out

    def chains(self, found: Sources) -> tuple[np.ndarray, np.ndarray]:
        """First and last window of the long paths: repeated windows that follow each other here and in the source."""
        at = np.flatnonzero(found.hit)
        if not len(at):
            return at, at
        on = np.zeros(len(at), bool)
        same = (np.diff(at) == 1) & (np.repeat(self.doc, self.count)[at][1:] == np.repeat(self.doc, self.count)[at][:-1])
        on[1:] = same & (found.chunk[at][1:] == found.chunk[at][:-1]) & (found.doc[at][1:] == found.doc[at][:-1]) & (found.place[at][1:] == found.place[at][:-1] + 1)
        begin = np.flatnonzero(~on)
        return at[begin], at[np.append(begin[1:], len(at)) - 1]

    def digests(self, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
        """Of the words from window ``begin`` to the end of window ``end``."""
        out: list[bytes] = []
        for _, _, start, ws, we, _, windows, base in self.words:
            own = slice(np.searchsorted(begin, base), np.searchsorted(begin, base + len(windows)))
            first, last = ws[windows[begin[own] - base]] + start, we[windows[end[own] - base] + self.k - 1] + start
            out += [digest(self.data[a:b].tobytes().split()) for a, b in zip(first.tolist(), last.tolist())]
        return out

    def cut(self, hit: np.ndarray, joined: bool = True):
        """Per block of documents: row range, words, removed words, runs of removed words, first words and the kept text."""
        for lo, hi, start, ws, we, first, windows, base in self.words:
            cover = np.zeros(len(ws) + 1, np.int32)
            at = windows[hit[base : base + len(windows)]]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + self.k, -1)
            gone = np.cumsum(cover[:-1]) > 0
            kept = np.flatnonzero(~gone)
            doc = np.searchsorted(first, kept, side="right") - 1
            data = np.array(self.data[start : self.offsets[hi]])
            offsets = self.offsets[lo : hi + 1] - start
            mark = np.zeros(len(data) + 1, np.int8)
            if joined:
                mark[ws[kept]] += 1
                np.subtract.at(mark, we[kept], 1)
                keep = np.cumsum(mark[:-1]) > 0
                gap = we[kept[:-1]][doc[1:] == doc[:-1]]  # a word of the same document follows
                keep[gap] = True
                data[gap] = 0x20
            else:  # a removed word goes with the separators up to the next word
                lost = np.flatnonzero(gone)
                ends = np.minimum(np.append(ws, len(data))[lost + 1], offsets[np.searchsorted(first, lost, side="right")])
                mark[ws[lost]] += 1
                np.subtract.at(mark, ends, 1)
                keep = np.cumsum(mark[:-1]) == 0
            sizes = np.append(0, np.cumsum(keep))
            text = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(sizes[offsets].astype(np.int64)), pa.py_buffer(data[keep])]).cast(pa.large_string())
            removed = np.append(0, np.cumsum(gone))
            run = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))) != 0)
            yield lo, hi, np.diff(first), removed[first[1:]] - removed[first[:-1]], run, first, text


def split_runs(run: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of removed words [a, b) cut at the ends of documents: row, start and end in the row's words."""
    a, b = run[0::2], run[1::2]
    if not len(a):
        return a, a, b
    left, right = np.searchsorted(first, a, side="right") - 1, np.searchsorted(first, b, side="left") - 1
    n = right - left + 1
    row = np.repeat(left - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
    s = np.maximum(np.repeat(a, n), first[row])
    e = np.minimum(np.repeat(b, n), first[row + 1])
    full = e > s
    return row[full], (s - first[row])[full], (e - first[row])[full]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, carry: Sequence[str] = (), joined: bool = True, bits: int = 64) -> DataFrame:
    """Remove from every text the words of ``k``-word windows that also start in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``.  Windows are judged on the input.  Returns ``id_col``, the columns
    ``carry``, ``kept_text``, ``n_words``, ``n_removed`` and ``spans`` (removed runs as word offsets
    [start, end)), one row per input row.  ``kept_text`` is the kept words joined by one space, or, unless
    ``joined``, the text without the removed words and the separators after them.

    Null or empty text: no words, ``kept_text`` is ''.  A row with a null id keeps its text and
    removes nothing elsewhere.  Rows with equal ids don't remove each other's words.  An empty
    table gives an empty result.  Other columns of ``docs``, whatever their names, are ignored.
    ``bits`` weakens the first hash, for tests; the result stays.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("carry"))
    n_chunks, n_buckets = C.layout(rows, "text")
    return _dedup(rows, id_col, k, list(carry), joined, n_chunks, n_buckets, bits)


def _dedup(rows: DataFrame, id_col: str, k: int, carry: list[str], joined: bool, n_chunks: int, n_buckets: int, bits: int) -> DataFrame:
    chunked = C.in_chunks(rows, n_chunks, "id", "text")
    grouped = chunked.groupBy("chunk")

    def ask_paths(key, table):
        p = Paths(table, k, bits)
        C.release()
        return C.ask(key[0].as_py(), p.path, [p.path, p.path_2, p.least, p.least_place], n_buckets)

    def judge_paths(path, path_2, least, place, chunk):
        return first_holders(*C.together(path, path_2), least, place, chunk)

    def ask_nodes(key, table, answers):
        nodes, n = Paths(table, k, bits).nodes(answers)
        C.release()
        return C.ask(key[0].as_py(), nodes, [nodes, n], n_buckets)

    def judge_nodes(node, n, chunk):
        return C.totals(node, n) > 1, []

    def ask_edges(key, table, answers):
        p = Paths(table, k, bits)
        asked, _ = p.open_edges(*rounds_of(answers, 2))
        return C.ask(key[0].as_py(), asked[0], asked, n_buckets)

    def judge_edges(edge, edge_2, least, place, chunk):
        return first_holders(*C.together(edge, edge_2), least, place, chunk)

    def sources_of(key, table, answers):
        p = Paths(table, k, bits)
        return p, p.sources(key[0].as_py(), *rounds_of(answers, 3))

    def long_paths(key, table, answers):
        p, found = sources_of(key, table, answers)
        C.release()
        begin, end = p.chains(found)
        size = (end - begin + k).astype(np.int32)
        return pa.table({"chunk": found.chunk[begin], "id": found.doc[begin], "place": found.place[begin], "words": size, "digest": pa.array(p.digests(begin, end), pa.binary())})

    def differing(key, table, requests):
        wanted: dict[int, list[tuple[int, int, bytes]]] = {}
        for i, place, words, told in zip(*(requests.column(c).to_pylist() for c in ("id", "place", "words", "digest"))):
            wanted.setdefault(i, []).append((place, words, told))
        held: dict[tuple[int, int, bytes, int], bool] = {}
        for i, text in zip(table.column("id").to_pylist(), table.column("text")):
            if i in wanted:  # rows may share an id
                own = (text.as_py() or "").encode().split()
                for place, words, told in wanted[i]:
                    if not held.get((i, place, told, words)):
                        held[i, place, told, words] = place + words <= len(own) and digest(own[place : place + words]) == told
        bad = [(i, place, told) for (i, place, told, _), good in held.items() if not good]
        return pa.table({"id": pa.array([b[0] for b in bad], pa.int64()), "place": pa.array([b[1] for b in bad], pa.int32()), "digest": pa.array([b[2] for b in bad], pa.binary())})

    out_type = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("carry", rows.schema["carry"].dataType)])

    def cut(key, table, answers):
        p, found = sources_of(key, table, answers)
        refused = answers.filter(pa.array(answers.column("round").to_numpy() == 4))
        if refused.num_rows:
            bad = set(zip(*(refused.column(c).to_pylist() for c in ("id", "place", "digest"))))
            begin, end = p.chains(found)
            for a, b, told in zip(begin, end, p.digests(begin, end)):
                if (int(found.doc[a]), int(found.place[a]), told) in bad:
                    found.hit[a : b + 1] = False
        text, n_words, n_removed, spans = [], [], [], []
        for lo, hi, words, removed, run, first, kept in p.cut(found.hit, joined):
            row, s, e = split_runs(run, first)
            text.append(kept.cast(pa.string()))
            n_words.append(words)
            n_removed.append(removed)
            spans.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(s.astype(np.int64)), pa.array(e.astype(np.int64))], ["start", "end"])))
        carried = table.column("carry")
        C.release()
        return pa.table({id_col: table.column("id"), "kept_text": pa.chunked_array(text, pa.string()), "n_words": np.concatenate(n_words).astype(np.int64), "n_removed": np.concatenate(n_removed).astype(np.int64), "spans": pa.chunked_array(spans), "carry": carried})

    paths = C.answer(grouped.applyInArrow(ask_paths, C.BLOB), [np.uint64, np.uint32, np.int64, np.int32], judge_paths).withColumn("round", F.lit(1))
    nodes = C.answer(grouped.cogroup(paths.groupBy("chunk")).applyInArrow(ask_nodes, C.BLOB), [np.uint64, np.int32], judge_nodes).withColumn("round", F.lit(2))
    both = paths.unionByName(nodes)
    edges = C.answer(grouped.cogroup(both.groupBy("chunk")).applyInArrow(ask_edges, C.BLOB), [np.uint64, np.uint32, np.int64, np.int32], judge_edges)
    both = both.unionByName(edges.withColumn("round", F.lit(3)))
    # one row for the equal long paths of however many copies
    compacted = grouped.cogroup(both.groupBy("chunk")).applyInArrow(long_paths, REQUEST).distinct()
    refused = grouped.cogroup(compacted.groupBy("chunk")).applyInArrow(differing, "id long, place int, digest binary")
    # hardly ever any: then every chunk is told
    told = refused.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))).withColumn("round", F.lit(4))
    out = grouped.cogroup(both.unionByName(told, allowMissingColumns=True).groupBy("chunk")).applyInArrow(cut, out_type)
    return out.select(id_col, *[F.col(f"carry.c{i}").alias(c) for i, c in enumerate(carry)], "kept_text", "n_words", "n_removed", "spans")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: 13-word windows over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup_substrings(docs, "doc_id", "text", k=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
