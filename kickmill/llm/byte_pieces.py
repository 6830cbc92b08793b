"""Ids of a byte-level tokenizer, each distinct piece of text tokenized once.

Such a tokenizer cuts text into pieces (a word with the space before it, digits, signs, white space) and merges bytes inside a piece
only.  Here the cuts of many texts are found at once from the classes of their characters; Arrow numbers the distinct pieces, and
only pieces that the worker doesn't remember go through the tokenizer.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa

from kickmill.llm.packing import LETTER, NUMBER, ODD, SIGN, SPACE, Ragged, take_endings

#: Beyond a text's ends.
EDGE = 9
#: White space of the pieces' pattern.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Characters whose pieces are cut at once, and distinct pieces that a worker remembers (about 200 bytes each).
TOGETHER, REMEMBERED = 1 << 20, 600_000
#: Sections of long texts end before white space that follows something else: no piece reaches across.
GAP = re.compile(r"(?<=[^\s\x85\xa0])[ \n]")

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each character.  Those that Unicode 3.2 did not have, or had in another class, are odd: libraries differ about them."""
    global _classes
    if _classes is None:
        old = unicodedata.ucd_3_2_0.category
        kind = {"L": LETTER, "N": NUMBER}
        found = np.full(0x110000, ODD, np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            now = unicodedata.category(ch)
            if now not in ("Cn", "Cs") and old(ch) == now:
                found[c] = kind.get(now[0], SIGN)
        found[SPACES] = SPACE
        found[0x180E] = ODD
        _classes = found
    return _classes


def piece_starts(points: np.ndarray, kinds: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces begin; ``firsts`` are the places at which (non-empty) texts begin.

    A run of letters, of numbers or of signs is a piece, with the one space before it.  Of white space before something else the last
    character is cut off, and joins it if it is a space.  An apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it.
    """
    before, behind = np.empty_like(kinds), np.empty_like(kinds)
    before[1:], behind[:-1] = kinds[:-1], kinds[1:]
    before[firsts] = EDGE
    behind[firsts[1:] - 1] = EDGE
    behind[-1:] = EDGE
    space = kinds == SPACE
    start = kinds != before
    start |= space & (behind != SPACE) & (behind != EDGE)
    plain = np.zeros(len(points), bool)
    plain[1:] = points[:-1] == 0x20
    start &= ~(plain & ~space & (before == SPACE))
    at = np.flatnonzero((points == 0x27) & start & (behind == LETTER))
    take_endings(points, start, behind, at)
    return np.flatnonzero(start)


class ByteEncoder:
    """Ids of texts as ``tokenizer.encode(text, add_special_tokens=False)`` gives them, for byte-level tokenizers of the pattern above."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.kinds = classes()
        self.pieces = Ragged()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, new: list[str]) -> None:
        """Words go through the tokenizer many at a time, each behind a space or a line end, where it cuts them, too."""
        spaced, bare, others = [], [], []
        for p in new:
            (spaced if p[0] == " " and p[1:].isalpha() else bare if p.isalpha() else others).append(p)
        if not self.joined(spaced, "") or not self.joined(bare, "\n"):
            others = new
        if others:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
            self.pieces.append(others, np.array([x for y in each for x in y], np.uint32), np.array([len(x) for x in each], np.int64))

    def joined(self, words: list[str], between: str) -> bool:
        """Learn words from one text of them; False if tokens reach across their ends."""
        if not words:
            return True
        ids = np.array(self.tokenizer.encode_batch_fast([between.join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum([len(p.encode()) + len(between) for p in words]) - len(between)
        begins = np.append(0, ends[:-1] + len(between))
        have = np.append(0, np.cumsum(self.bytes_of[ids]))
        lo, hi = np.searchsorted(have, begins), np.searchsorted(have, ends)
        if hi[-1] >= len(have) or (have[lo] != begins).any() or (have[hi] != ends).any():
            return False
        size = hi - lo
        keep = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        self.pieces.append(words, ids[keep], size)
        return True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; many short ones at once, long ones in sections."""
        out: list[np.ndarray] = []
        few: list[str] = []
        size = 0
        for t in texts:
            if len(t) > TOGETHER:
                out += self.encode_few(few)
                few, size = [], 0
                out.append(np.concatenate([self.encode_few([part])[0] for part in self.sections(t)]))
                continue
            if size + len(t) > TOGETHER:
                out += self.encode_few(few)
                few, size = [], 0
            few.append(t)
            size += len(t)
        return out + self.encode_few(few)

    def sections(self, text: str):
        at = 0
        if any(s in text for s in self.special):
            yield text
            return
        while len(text) - at > TOGETHER and (gap := GAP.search(text, at + TOGETHER)):
            yield text[at : gap.start()]
            at = gap.start()
        yield text[at:]

    def encode_few(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = self.kinds[points]
        edges = np.append(0, np.cumsum([len(t) for t in texts]))
        odd: dict[int, np.ndarray] = {}
        strange = np.flatnonzero(kinds == ODD)
        if len(strange):
            odd = dict.fromkeys(np.unique(np.searchsorted(edges, strange, "right") - 1).tolist())
        for s in self.special:
            if s in joined:
                odd |= {i: None for i, t in enumerate(texts) if s in t}
        if odd:
            odd = {i: self.whole(texts[i]) for i in odd}
            rest = iter(self.encode_few([t for i, t in enumerate(texts) if i not in odd]))
            return [odd[i] if i in odd else next(rest) for i in range(len(texts))]
        if not len(points):
            return [np.zeros(0, np.uint32) for _ in texts]
        firsts = np.unique(edges[:-1][np.diff(edges) > 0])
        starts = piece_starts(points, kinds, firsts)
        at = starts if joined.isascii() else (np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)) - 1 - (points > 0x7F) - (points > 0x7FF) - (points > 0xFFFF))[starts]
        data = joined.encode()
        offsets = np.append(at, len(data)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.pieces.place) > self.remembered:
            self.pieces = Ragged()
        known = self.pieces.place
        place = np.fromiter(map(known.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(place < 0).tolist()
        if missing:
            new = [distinct[i] for i in missing]
            self.learn(new)
            place[missing] = np.fromiter(map(known.__getitem__, new), np.int64, len(new))
        ids, size = self.pieces.gather(place[coded.indices.to_numpy()])
        total = np.append(0, np.cumsum(size))[np.searchsorted(starts, edges)]
        return [ids[a:b] for a, b in zip(total[:-1], total[1:])]


_encoders: dict[str, ByteEncoder] = {}


def encoder_of(path: str, remembered: int = REMEMBERED) -> ByteEncoder:
    """A worker's encoder, kept for its next tasks."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    _encoders[path].remembered = remembered
    return _encoders[path]
