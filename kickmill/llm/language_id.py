"""Hierarchical language identification with linear support vector machines.

A text's features are counts of its lower-cased byte 2-, 3- and 4-grams inside words (with one edge blank),
hashed and divided by their number.  First one-versus-one machines choose the language family; then
one-versus-one machines among that family's languages choose the language.  The machines have squared hinge loss and are
solved exactly by Newton steps on the kernel matrix of a bounded training sample.  Weights are rounded to
integers, so a text's score does not depend on its batch.

Prediction is one vectorised pass over the bytes of each Arrow batch; texts are never cut.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickmill.llm.chunks import release
from kickmill.llm.tables import unused
from kickmill.llm.textscan import blocks, buffers

#: Families of languages by ISO 639-1 code; a language not named here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
BITS = 14
#: Training documents of each language at most (the sample is chosen by a hash of the id).
PER_LANGUAGE = 250
#: Training documents of all languages at about most.
MOST = 4000
#: Languages that are learned, the most frequent ones (the machines number at most the pairs of them), and bytes of a text to learn from.
MOST_LABELS, TEXT_BYTES = 64, 1 << 18
SCALE = 1 << 20
#: Bytes of text that are judged at once, or one text.
BATCH_BYTES = 4 << 20
UNKNOWN = "und"

_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = True
_letter[128:] = True


def grams(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and feature numbers of the n-grams that have at most one blank, at an edge."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = data == 32
    bad = blank[:size] & blank[n - 1 :]
    for i in range(1, n - 1):
        bad |= blank[i : i + size]
    h = np.full(size, n * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        h = (h ^ data[i : i + size]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    at = np.flatnonzero(~bad)
    return at, (h[at] >> np.uint32(32 - BITS)).astype(np.int64)


def texts_as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with every ASCII non-letter as a blank, offsets, and whether a text has a letter.

    Each text gets a blank before and after it.
    """
    column = pc.fill_null(column, "")
    has_letter = np.asarray(pc.match_substring_regex(column, r"\p{L}"))
    padded = pc.binary_join_element_wise(pa.scalar(""), pc.utf8_lower(column), pa.scalar(""), " ")
    data, offsets = buffers(padded)
    return np.where(_letter[data], data, np.uint8(32)), offsets, has_letter


@dataclass
class Machine:
    """One side is +1, the other -1; margin = weights . features + bias; p(+1) = 1 / (1 + exp(-slope * margin))."""

    plus: str
    minus: str
    weights: np.ndarray
    bias: float
    slope: float


@dataclass
class Model:
    families: list[str]
    languages: dict[str, list[str]]
    between: list[Machine]
    within: dict[str, list[Machine]]

    def machines(self) -> list[Machine]:
        return [*self.between, *(m for f in self.families for m in self.within[f])]

    def table(self) -> np.ndarray:
        """Integer weights: features x machines."""
        own = self.machines()
        return np.stack([np.round(m.weights * SCALE).astype(np.int64) for m in own], 1) if own else np.zeros((1 << BITS, 0), np.int64)


def solve(kernel: np.ndarray, y: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    """Dual weights and bias of the squared hinge machine: Newton steps on the set of support vectors."""
    n = len(y)
    support = np.ones(n, bool)
    for _ in range(30):
        at = np.flatnonzero(support)
        m = len(at)
        system = np.empty((m + 1, m + 1))
        system[:m, :m] = kernel[np.ix_(at, at)]
        system[np.arange(m), np.arange(m)] += 1.0 / cost
        system[m, :m] = system[:m, m] = 1.0
        system[m, m] = 0.0
        beta = np.zeros(n)
        answer = np.linalg.solve(system, np.append(y[at], 0.0))
        beta[at], bias = answer[:m], answer[m]
        now = y * (kernel @ beta + bias) < 1
        if (now == support).all() or len(set(y[now])) < 2:
            break
        support = now
    return beta, float(bias)


def train_machine(plus: str, minus: str, x: np.ndarray, at: np.ndarray, kernel: np.ndarray, y: np.ndarray, cost: float) -> Machine:
    """Fit on the rows ``at``; the slope is set on rows left out of a first fit."""
    out = np.arange(len(y)) % 5 == 4
    slope = 4.0
    if len(set(y[~out])) == 2 and out.any():
        beta, bias = solve(kernel[np.ix_(~out, ~out)], y[~out], cost)
        margin = y[out] * (kernel[np.ix_(out, ~out)] @ beta + bias)
        slopes = np.geomspace(0.5, 16, 21)
        slope = float(slopes[np.argmin([np.mean(np.log1p(np.exp(-s * margin))) for s in slopes])])
    beta, bias = solve(kernel, y, cost)
    # by columns, so that x is never copied whole
    weights = np.concatenate([beta @ x[at, lo : lo + 1024] for lo in range(0, x.shape[1], 1024)])
    return Machine(plus, minus, weights, bias, slope)


def train(texts: list[str], langs: list[str], cost: float = 10.0) -> Model:
    """Families and languages are learned from the rows given; rows without a letter teach nothing."""
    data, offsets, letters = texts_as_bytes(pa.array(texts, pa.string()))
    x = np.zeros((len(texts), 1 << BITS), np.float32)
    for i in range(len(texts)):
        own = data[offsets[i] : offsets[i + 1]]
        counts = sum(np.bincount(grams(own, n)[1], minlength=1 << BITS) for n in (2, 3, 4))
        x[i] = counts / max(1, counts.sum())
    lang = np.array(langs, dtype=object)
    use = np.flatnonzero(letters)
    if len(use) < len(x):
        x, lang = x[use], lang[use]
    # features are small fractions; one common factor puts the kernel near 1
    factor = 1.0 / max(1e-9, float(np.sqrt(np.mean(np.einsum("ij,ij->i", x, x))))) if len(x) else 1.0
    x *= np.float32(factor)
    kernel = (x @ x.T).astype(float)
    family = np.array([FAMILY_OF.get(a, a) for a in lang], dtype=object)
    families = sorted(set(family))
    languages = {f: sorted(set(lang[family == f])) for f in families}

    def duels(names: list[str], label: np.ndarray) -> list[Machine]:
        found = []
        for a, b in combinations(names, 2):
            at = np.flatnonzero((label == a) | (label == b))
            m = train_machine(a, b, x, at, kernel[np.ix_(at, at)], np.where(label[at] == a, 1.0, -1.0), cost)
            m.weights = m.weights * factor
            found.append(m)
        return found

    return Model(families, languages, duels(families, family), {f: duels(languages[f], np.where(family == f, lang, None)) for f in families})


def vote(names: list[str], machines: list[Machine], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winner (number) and its least probability in a duel, for each row of margins (rows x machines)."""
    rows = len(margins)
    total, worst = np.zeros((rows, len(names))), np.ones((rows, len(names)))
    for i, m in enumerate(machines):
        p = 1 / (1 + np.exp(-np.clip(m.slope * margins[:, i], -50, 50)))
        for name, q in ((m.plus, p), (m.minus, 1 - p)):
            k = names.index(name)
            total[:, k] += q
            worst[:, k] = np.minimum(worst[:, k], q)
    best = total.argmax(1) if len(names) else np.zeros(rows, np.int64)
    return best, worst[np.arange(rows), best] if len(names) else np.zeros(rows)


def predict(model: Model, table: np.ndarray, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    data, offsets, letters = texts_as_bytes(column)
    rows = len(offsets) - 1
    sums, counts = np.zeros((rows, table.shape[1]), np.int64), np.zeros(rows, np.int64)
    for lo, hi in blocks(offsets, 1 << 20):
        own, first = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        for n in (2, 3, 4):
            at, feature = grams(own, n)
            # n-grams across two texts have two blanks and are not among them
            edge = np.searchsorted(at, first)
            counts[lo:hi] += np.diff(edge)
            for m in range(table.shape[1]):
                total = np.zeros(len(at) + 1, np.int64)
                np.cumsum(table[:, m][feature], out=total[1:])
                sums[lo:hi, m] += np.diff(total[edge])
    bias = np.array([m.bias for m in model.machines()])
    margins = sums / SCALE / np.maximum(counts, 1)[:, None] + bias
    family, score = vote(model.families, model.between, margins[:, : len(model.between)])
    names = np.full(rows, UNKNOWN, dtype=object)
    at = len(model.between)
    for k, f in enumerate(model.families):
        duels = model.within[f]
        mine = np.flatnonzero((family == k) & letters)
        best, inner = vote(model.languages[f], duels, margins[mine, at : at + len(duels)])
        names[mine] = np.array(model.languages[f], dtype=object)[best]
        score[mine] *= inner
        at += len(duels)
    score = np.where(letters & (names != UNKNOWN), score, 0.0)
    return list(names), np.round(np.clip(score, 0.0, 1.0), 6)


def held_out(id_col: str):
    """Never learned from: the remainder of the id's CRC-32 by 4 is 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> list[tuple[str, str]]:
    """At most ``per_language`` labelled documents of each language, those of least hash of (id, language).

    About twice as many are collected, so the driver's share is bounded whatever the table's size.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    labelled = labelled.filter(F.octet_length(F.col(text_col).cast("string")) <= TEXT_BYTES)
    order = F.pmod(F.xxhash64(F.col(id_col), F.col(lang_col)), F.lit(1 << 30)) / (1 << 30)
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(MOST_LABELS).collect()}
    if not sizes:
        return []
    per_language = max(10, min(per_language, MOST // len(sizes)))
    share = {lang: min(1.0, 2.0 * per_language / n) for lang, n in sizes.items()}
    limit = F.lit(0.0)
    for lang, part in share.items():
        limit = F.when(F.col(lang_col) == lang, part).otherwise(limit)
    rows = labelled.filter(order < limit).select(order.alias("_o"), F.col(id_col).cast("string").alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    # rows of one id and language share their order: the least text of them stands for all
    rows = rows.groupBy("_o", "i", "l").agg(F.min("t").alias("t")).collect()
    kept: dict[str, int] = {}
    out = []
    for r in sorted(rows, key=lambda r: (r._o, r.i, r.t)):
        if kept.setdefault(r.l, 0) < per_language:
            kept[r.l] += 1
            out.append((r.t, r.l))
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (0 to 1), learned from labelled rows that are not held out.

    The training sample has at most ``per_language`` documents of each of the MOST_LABELS most frequent languages (of equals the
    first in the alphabet), of at most TEXT_BYTES bytes each; other labels teach nothing and are never predicted.  Null text and text
    without a letter (Unicode L) are ``und`` with score 0, as is everything when no row is labelled.  Rows with a
    null id or language are predicted but teach nothing.  Repeated rows are predicted alike, and teach once; where votes are equal
    the first language counts.  Very long texts are judged whole, in sections of bounded memory.  An empty table gives an empty
    result.  All columns of ``docs`` are kept; those two names are replaced.
    """
    sample = training_sample(docs, id_col, text_col, lang_col, per_language)
    model = train([t for t, _ in sample], [lang for _, lang in sample])
    table = model.table()
    release()  # the driver's memory, too

    @F.arrow_udf("lang_pred string, lang_score double")
    def judge(texts: pa.Array) -> pa.Array:
        names, scores = [], [np.zeros(0)]
        for lo, hi in blocks(buffers(texts)[1], BATCH_BYTES):
            name, score = predict(model, table, texts.slice(lo, hi - lo))
            names += name
            scores.append(score)
        release()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["lang_pred", "lang_score"])

    own = unused([*docs.columns, "lang_pred", "lang_score"], "judged")
    # so marked, filters on its fields don't evaluate it a second time
    out = docs.withColumn(own, judge.asNondeterministic()(F.col(text_col).cast("string")))
    return out.withColumns({"lang_pred": F.col(f"{own}.lang_pred"), "lang_score": F.col(f"{own}.lang_score")}).drop(own)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
