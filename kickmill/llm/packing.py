"""Cost-balanced packing of documents into training sequences.

A document of L tokens costs ``linear * L + quadratic * L * L`` (attention stays within a document).  Tokens are
gathered into *shards* of a fixed number of sequences.  In a shard, documents go in descending order of
cost to the lowest-cost sequence that still has room for them whole; what fits nowhere whole is cut into the
room that is left, again lowest cost first.  Only as many sequences are opened as the tokens fill, and what
exceeds them moves on to the next shard.  At the end of a partition the rest fills sequences whose
lengths are powers of two (which need no padding).  So nothing is padded at all.

A shard is packed by one task from the rows it reads anyway: no shuffle, and memory bounded by
the shard.  Sequences never span tasks, and a task that runs again packs its rows alike.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickmill.llm.chunks import release
from kickmill.llm.tables import small_batches

PIECE_TYPE = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Distinct pieces of text whose ids a worker remembers (about 200 bytes each), new ones that are tokenized together,
#: and characters that are tokenized together: a longer text is taken in sections that end before white space.
REMEMBERED, LEARNED, SECTION = 400_000, 10_000, 1 << 19

LETTER, NUMBER, SIGN, SPACE, ODD = 1, 2, 3, 4, 5


def plain_characters() -> str:
    """Characters that are lower-cased and cut here as the tokenizer would; texts with others go through the tokenizer whole."""
    near = "".join(map(chr, [*range(0x250), *range(0x2010, 0x2028)]))
    return "".join(c for c in near if len(c.lower()) == 1 and c.lower() in near)


PLAIN = plain_characters()


def kinds_of_plain() -> tuple[np.ndarray, np.ndarray]:
    """For every character its kind, and its lower-case form if it is plain."""
    kinds, lower = np.full(0x110000, ODD, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in PLAIN:
        kinds[ord(c)] = SPACE if c in "\t\n\v\f\r \x85\xa0" else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], SIGN)
        lower[ord(c)] = ord(c.lower())
    return kinds, lower


def word_starts(points: np.ndarray, kinds: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces and white space between them begin; ``firsts`` are the places at which (non-empty) texts begin.

    A run of letters, one number or a run of signs is a piece; an apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it.
    """
    before, behind = np.empty_like(kinds), np.empty_like(kinds)
    before[1:], behind[:-1] = kinds[:-1], kinds[1:]
    before[firsts] = 0
    behind[firsts[1:] - 1] = 0
    behind[-1:] = 0
    start = (kinds != before) | (kinds == NUMBER)
    at = np.flatnonzero((points == 0x27) & start & (behind == LETTER))
    take_endings(points, start, behind, at)
    return np.flatnonzero(start)


def take_endings(points: np.ndarray, start: np.ndarray, behind: np.ndarray, at: np.ndarray) -> None:
    """Join the apostrophes ``at``, each before a letter, with the ending that follows, and begin a piece after it."""
    if not len(at):
        return
    more = np.append(points, [0, 0])
    one = np.isin(more[at + 1], [ord(c) for c in "stmd"])
    two = (behind[at + 1] == LETTER) & np.isin(more[at + 1] * 256 + more[at + 2], [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
    start[at[one | two] + 1] = False
    last = np.append(at[one] + 1, at[two & ~one] + 2)
    start[last[behind[last] == LETTER] + 1] = True


class Ragged:
    """Lists of ids that are appended to and gathered from; keys have places."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 12, np.uint32), 0
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def append(self, keys: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, 2 * len(self.flat)) - len(self.flat), np.uint32)])
        self.flat[self.used : need] = ids
        self.place.update(zip(keys, range(len(self.first), len(self.first) + len(keys))))
        self.first = np.concatenate([self.first, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used = need

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[at]
        return self.flat[np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())], size


class PieceEncoder:
    """Ids of texts: each distinct piece (word, digit, run of signs) is tokenized once.

    Right for tokenizers that lower-case, drop white space, cut words by the pattern above and end a piece's last
    token with ``</w>``, as ``word_bpe_49k.json``.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kinds, self.lower = kinds_of_plain()
        self.pieces = Ragged()

    def places(self, pieces: list[str]) -> np.ndarray:
        """Where the pieces' ids are; new pieces are tokenized, many in one text."""
        if len(self.pieces.place) > self.remembered:
            self.pieces = Ragged()
        at = np.fromiter(map(self.pieces.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            unknown = [pieces[i] for i in missing.tolist()]
            new = list(dict.fromkeys(unknown))
            for lo in range(0, len(new), LEARNED):
                self.tokenize(new[lo : lo + LEARNED])
            at[missing] = np.fromiter(map(self.pieces.place.__getitem__, unknown), np.int64, len(unknown))
        return at

    def tokenize(self, new: list[str]) -> None:
        """All in one text; a token that ends a word ends a piece."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
        size = np.diff(np.append(-1, np.flatnonzero(self.ends[ids])))
        if len(size) != len(new):  # a piece that is not one to the tokenizer
            each = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            ids, size = np.array([x for y in each for x in y], np.uint32), np.array([len(x) for x in each])
        self.pieces.append(new, ids, size.astype(np.int64))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; sections of long ones are taken one after another."""
        if sum(len(t or "") for t in texts) <= SECTION:
            return self.encode_sections(texts)
        out = []
        for t in texts:
            parts = [self.encode_sections([x])[0] for x in sections(t or "")]
            out.append(np.concatenate(parts) if parts else np.zeros(0, np.uint32))
        return out

    def encode_sections(self, texts: list[str | None]) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = self.kinds[points]
        edges = np.append(0, np.cumsum([len(t) for t in texts]))
        strange = np.flatnonzero(kinds == ODD)
        odd = set(np.searchsorted(edges, strange, "right") - 1) if len(strange) else set()
        if "<|" in joined:
            odd |= {i for i, t in enumerate(texts) if "<|" in t}
        if odd:
            rest = iter(self.encode_sections([t for i, t in enumerate(texts) if i not in odd]))
            return [self.whole(t) if i in odd else next(rest) for i, t in enumerate(texts)]
        if not joined:
            return [np.zeros(0, np.uint32) for _ in texts]
        points = self.lower[points]
        starts = word_starts(points, kinds, np.unique(edges[:-1][np.diff(edges) > 0]))
        wide = (points > 0x7F).astype(np.int64) + (points > 0x7FF)
        data = joined.lower().encode()
        offsets = np.append((np.cumsum(wide) - wide)[starts] + starts, len(data)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        kept = kinds[starts] != SPACE
        codes = coded.indices.to_numpy()[kept]
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        used = np.unique(codes)
        place = np.zeros(len(distinct), np.int64)
        place[used] = self.places(distinct[used].tolist())
        ids, size = self.pieces.gather(place[codes])
        total = np.append(0, np.cumsum(size))[np.searchsorted(starts[kept], edges)]
        return [ids[a:b] for a, b in zip(total[:-1], total[1:])]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


#: No token reaches across these.
GAP = re.compile(r"[ \t\n\r]")


def sections(text: str) -> Iterator[str]:
    """Parts of at least SECTION characters, cut before white space."""
    at = 0
    while len(text) - at > SECTION and (gap := GAP.search(text, at + SECTION)):
        yield text[at : gap.start()]
        at = gap.start()
    if at < len(text):
        yield text[at:]


def batches_of(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most SECTION characters together, or one row."""
    lo = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and total + n > SECTION:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(texts):
        yield lo, len(texts)


_encoders: dict[str, PieceEncoder] = {}


def encoder_of(path: str, remembered: int = REMEMBERED) -> PieceEncoder:
    """A worker's encoder, kept for its next tasks."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    _encoders[path].remembered = remembered
    return _encoders[path]


def capacities(total: int, length: int, last: bool) -> np.ndarray:
    """Full sequences; at the end also powers of two that add up to the rest."""
    full = np.full(total // length, length, np.int64)
    rest = total % length if last else 0
    return np.append(full, [1 << b for b in range(length.bit_length() - 1, -1, -1) if rest >> b & 1]).astype(np.int64)


def assign(sizes: np.ndarray, room: np.ndarray, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Pieces (item, start, length, sequence), and what had no room (item, start)."""
    room, cost = room.copy(), np.zeros(len(room))
    pieces: list[tuple[int, int, int, int]] = []
    apart: list[int] = []
    weight = linear * sizes + quadratic * sizes.astype(float) ** 2
    for i in np.argsort(-weight, kind="stable"):
        n = sizes[i]
        fit = np.where(room >= n, cost, np.inf)
        s = int(np.argmin(fit)) if len(fit) else -1
        if s < 0 or fit[s] == np.inf:
            apart.append(int(i))
            continue
        room[s] -= n
        cost[s] += weight[i]
        pieces.append((int(i), 0, int(n), s))
    left = [s for s in np.argsort(cost, kind="stable") if room[s]]
    over: list[tuple[int, int]] = []
    for i in apart:
        at = 0
        while at < sizes[i] and left:
            s = left[0]
            n = int(min(room[s], sizes[i] - at))
            pieces.append((i, at, n, int(s)))
            at += n
            room[s] -= n
            if not room[s]:
                left.pop(0)
        if at < sizes[i]:
            over.append((i, at))
    return pieces, over


class Shard:
    """Items (document id, start, tokens of its document, ids) that wait for a sequence."""

    def __init__(self, length: int, linear: float, quadratic: float, base: int):
        self.length, self.linear, self.quadratic = length, linear, quadratic
        self.items: list[tuple[int | None, int, int, np.ndarray]] = []
        self.total, self.next, self.whole = 0, base, []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.length:  # a full sequence of its own
            self.whole.append((doc, at, n, ids[at : at + self.length], self.next, 0))
            self.next += 1
            at += self.length
        if at < n:
            self.items.append((doc, at, n, ids[at:].copy()))
            self.total += n - at

    def pack(self, last: bool) -> list[tuple]:
        out, self.whole = self.whole, []
        room = capacities(self.total, self.length, last)
        pieces, over = assign(np.array([len(x[3]) for x in self.items], np.int64), room, self.linear, self.quadratic)
        filled = np.zeros(len(room), np.int64)
        for i, at, n, s in sorted(pieces, key=lambda p: p[3]):
            doc, start, of, ids = self.items[i]
            out.append((doc, start + at, of, ids[at : at + n], self.next + s, int(filled[s])))
            filled[s] += n
        self.next += len(room)
        self.items = [(self.items[i][0], self.items[i][1] + at, self.items[i][2], self.items[i][3][at:]) for i, at in over]
        self.total = sum(len(x[3]) for x in self.items)
        return out


def as_batch(pieces: list[tuple]) -> pa.RecordBatch:
    doc, start, of, ids, seq, offset = zip(*pieces)
    size = np.array([len(x) for x in ids], np.int64)
    column = lambda x: pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([column(doc), column(start), column(size), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), column(of), column(seq), column(offset)], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1.0 / 2048, shard_sequences: int = 256, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces (id_col, start, length, ids, doc_tokens, sequence_id, offset) of every document.

    ``ids`` holds a piece's token ids as little-endian unsigned 32-bit integers; a document is its text's
    ids followed by ``end_id``, cut freely, each id in exactly one piece.  Pieces of a sequence are
    gapless from offset 0; a sequence has ``length`` tokens or a smaller power of two.

    Null text counts as empty (one piece with ``end_id``); a null id is kept as null.  Repeated rows
    are packed each.  An empty table gives an empty result.  Other columns are ignored.  ``remembered`` pieces of text
    cost a worker about 200 bytes each; fewer cost time.
    """

    def per_partition(batches):
        encoder = encoder_of(tokenizer_path, remembered)
        shard = Shard(length, linear, quadratic, TaskContext.get().partitionId() << 36)
        for batch in batches:
            release()
            docs_of = batch.column(0).to_pylist()
            for few in range(0, batch.num_rows, 200):
                texts = batch.column(1).slice(few, 200).to_pylist()
                for lo, hi in batches_of(texts):
                    for doc, ids in zip(docs_of[few + lo : few + hi], encoder.encode(texts[lo:hi])):
                        shard.add(doc, np.append(ids, np.uint32(end_id)))
                        if shard.total >= length * shard_sequences or len(shard.whole) >= shard_sequences:
                            if pieces := shard.pack(last=False):
                                yield as_batch(pieces)
        if pieces := shard.pack(last=True):
            yield as_batch(pieces)
        release()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(per_partition, PIECE_TYPE).withColumnRenamed("id", id_col)


def pieces_with_digests(docs: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    import public_tokenizers

    out = pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=remembered)
    return out.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents, 2048 tokens, ids of ``word_bpe_49k.json`` and a final 1."""
    return pieces_with_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
