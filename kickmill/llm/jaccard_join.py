"""Exact n-gram Jaccard self-join with set-relation skipping; returns link components.

Documents become sets of hashed ``k``-word shingles.

1. *Position skipping.*  A set of n tokens needs ``t = ceil(threshold * n)`` common tokens with any partner, so
   the ``l`` first common tokens (by hash) lie within its first ``n - t + l`` ones.  Chunks look these
   up in buckets; a set with fewer repeated ones than any partner would need stops here.
2. Equal sets are answered once, by their smallest id.
3. The rest look up how frequent each token is.  In the order (frequency, hash) the prefix of ``n - t + 1`` tokens
   becomes the index; unique tokens are never stored, and frequent ones only where nothing rarer is left.
4. *Answer skipping.*  Links only matter between sets that are not yet connected.  In rounds,
   each set is compared with one already answered set (a leader) that shares most of its index lists; once linked, it takes
   over the leader's component with all answers in it, and lists whose members are all of
   one component are skipped as a block.
   After the first, rounds end when little enough is left, or when they get on too slowly.
5. What is left - pairs in different components that share a list, pass the size and the position
   bound and were not compared - is compared in full.  No list, bucket or number of partners is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kickmill.llm import chunks as C
from kickmill.llm.tables import discard, stored
from kickmill.llm.textscan import CHAIN, CHAIN_INVERSE, U64, Words, blocks, buffers, mix, powers

SET_FIELDS = [T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("tokens", T.BinaryType())]
#: Rounds end once comparing all that is left takes at most so many pairs per entry of the index.
EASY = 16
SLOW = 0.8
#: Links between components, about 100 bytes each, that one task joins; more are joined by rounds over all of them.
FEW = 100_000
INDEX_TYPE = "key long, id long, n long, pos long, own long"


def least_common(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set of n tokens shares with any partner at least."""
    return -(-percent * n // 100)


class Sets:
    """Sorted distinct shingle hashes of each document: ``tokens``, ``doc`` and ``rank`` in its document; sizes ``n``."""

    def __init__(self, table: pa.Table, k: int):
        data, offsets = buffers(table.column("text"))
        tokens, docs = [], []
        for lo, hi in blocks(offsets):
            w = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True)
            grams = w.grams(k)
            at = np.flatnonzero(w.room()[: len(grams)] >= k)
            token, doc = grams[at], w.doc[at]
            size = np.diff(w.first)
            short = np.flatnonzero((size > 0) & (size < k))
            if len(short):
                total = np.zeros(len(w.hash) + 1, U64)
                np.cumsum(w.hash * powers(CHAIN, len(w.hash)), out=total[1:])
                a, b = w.first[short], w.first[short + 1]
                whole = mix(mix((total[b] - total[a]) * powers(CHAIN_INVERSE, len(total))[a]) + size[short].astype(U64))
                token, doc = np.concatenate([token, whole]), np.concatenate([doc, short])
            order = np.lexsort((token, doc))
            new = C.heads(doc[order], token[order])
            tokens.append(token[order][new])
            docs.append(lo + doc[order][new])
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, U64)
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))
        self.n = np.diff(self.first)
        self.rank = np.arange(len(self.doc)) - self.first[self.doc]


def packed_sets(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of many sets, the set of each token, and the offsets."""
    sizes = np.array([len(b) // 8 for b in blobs], np.int64)
    return np.frombuffer(b"".join(blobs), U64), np.repeat(np.arange(len(blobs)), sizes), np.append(0, np.cumsum(sizes))


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in the order of asking, how often each occurs, and the place of every given key among them."""
    order = np.argsort(keys)
    at = C.heads(keys[order])
    place = np.empty(len(keys), np.int64)
    place[order] = C.runs(at, len(keys))
    return keys[order][at], np.diff(np.append(at, len(keys))), place


def survivors(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, n, sig, tokens, carry) of every document (id, text, carry); sig and tokens are null for sets that can't have a partner."""
    n_chunks, n_buckets = C.layout(docs, "text")
    grouped = C.in_chunks(docs, n_chunks, "id", "text").groupBy("chunk")

    def asked(s: Sets) -> np.ndarray:
        return np.flatnonzero(s.rank < (s.n - least_common(s.n, percent) + 1 + s.n // 10)[s.doc]) if len(s.doc) else np.zeros(0, np.int64)

    def ask(key, table):
        s = Sets(table, k)
        keys, n, _ = distinct_keys(mix(s.tokens[asked(s)]))  # a set's least hashes, spread again
        return C.ask(key[0].as_py(), keys, [keys, np.minimum(n, 2).astype(np.uint8)], n_buckets)

    def judge(keys, n, chunk):
        order, at = C.together(keys)
        total = np.add.reduceat(n[order].astype(np.int64), at) if len(at) else at
        codes = np.empty(len(keys), np.uint8)
        codes[order] = (total > 1)[C.runs(at, len(keys))]
        return codes, []

    def select(key, table, answers):
        s = Sets(table, k)
        at = asked(s)
        _, _, place = distinct_keys(mix(s.tokens[at]))
        codes = C.codes_in_order(answers)
        repeated = np.bincount(s.doc[at], weights=codes[place] if len(at) else None, minlength=len(s.n))
        alive = (s.n > 0) & (repeated >= least_common(s.n, percent) // 10 + 1) & ~np.asarray(table.column("id").combine_chunks().is_null())
        tokens = [s.tokens[s.first[i] : s.first[i + 1]].tobytes() if alive[i] else None for i in range(len(s.n))]
        sigs = [None if t is None else hashlib.md5(t).digest() for t in tokens]
        C.release()
        return pa.table({"id": table.column("id"), "n": pa.array(s.n.astype(np.int64)), "sig": pa.array(sigs, pa.binary()), "tokens": pa.array(tokens, pa.binary()), "carry": table.column("carry")})

    answers = C.answer(grouped.applyInArrow(ask, C.BLOB), [np.uint64, np.uint8], judge)
    return grouped.cogroup(answers.groupBy("chunk")).applyInArrow(select, T.StructType([*SET_FIELDS, docs.schema["carry"]]))


def index(sets: DataFrame, percent: int) -> DataFrame:
    """Index entries (key, id, n, pos, own): each set's prefix in the order (frequency, hash) without its ``own`` unique tokens."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    n_chunks, n_buckets = max(1, round(total / 300_000)), max(8, round(total / 2_000_000))
    grouped = C.in_chunks(sets, n_chunks, "id").groupBy("chunk")

    def ask(key, table):
        tokens, _, _ = packed_sets(table.column("tokens").to_pylist())
        keys, n, _ = distinct_keys(tokens)
        return C.ask(key[0].as_py(), keys, [keys, n.astype(np.uint32)], n_buckets)

    def judge(keys, n, chunk):
        order, at = C.together(keys)
        total = np.add.reduceat(n[order].astype(np.int64), at) if len(at) else at
        grade = np.where(total < 64, total, np.minimum(255, 64 + 8 * np.log2(np.maximum(total, 64) / 64)).astype(np.int64))
        codes = np.empty(len(keys), np.uint8)
        codes[order] = grade[C.runs(at, len(keys))]
        return codes, []

    def entries(key, table, answers):
        tokens, of, first = packed_sets(table.column("tokens").to_pylist())
        _, _, place = distinct_keys(tokens)
        grade = C.codes_in_order(answers)[place] if len(place) else np.zeros(0, np.uint8)
        order = np.lexsort((tokens, grade, of))
        n = np.diff(first)
        pos = np.arange(len(order)) - first[of]
        keep = (grade[order] > 1) & (pos < (n - least_common(n, percent) + 1)[of])
        ids = table.column("id").to_numpy()
        own = np.bincount(of[grade == 1], minlength=len(ids))
        C.release()
        return pa.table({"key": tokens[order][keep].view(np.int64), "id": ids[of[keep]], "n": n[of[keep]].astype(np.int64), "pos": pos[keep].astype(np.int64), "own": own[of[keep]].astype(np.int64)})

    answers = C.answer(grouped.applyInArrow(ask, C.BLOB), [np.uint64, np.uint32], judge)
    return grouped.cogroup(answers.groupBy("chunk")).applyInArrow(entries, INDEX_TYPE)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) whose sets reach the threshold."""

    @F.pandas_udf("long")
    def common(x, y):
        import pandas as pd

        out = np.empty(len(x), np.int64)
        for i, (p, q) in enumerate(zip(x, y)):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            out[i] = np.count_nonzero(q[np.minimum(at, len(q) - 1)] == p)
        return pd.Series(out)

    a, b = (sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"t_{c}")) for c in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("common", common("t_a", "t_b")).drop("t_a", "t_b")
    return both.filter(F.col("common") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).drop("common", "n_a", "n_b")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of the edges (a, b): comp is the least node that can be reached.

    Each step takes the least label of the neighbours and then the label of that label.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    last = stored(labels, "labels")
    labels = last
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        step = stored(step.join(jump, "comp", "left").select("node", "old", F.least("comp", "further").alias("comp")), "labels")
        discard(last)
        labels, last = step.select("node", "comp"), step
        if not step.filter("comp <> old").limit(1).count():
            discard(both)
            return labels


def fits(percent: int):
    """Size and position bound of a pair that shares an index list."""
    need = percent * (F.col("n") + F.col("n_b"))
    bound = 1 + F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b")) - 1
    return (F.col("n") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n") * percent) & (bound * (100 + percent) >= need)


def few_components(edges: DataFrame) -> DataFrame:
    """components() of at most ``FEW`` edges, by union-find in one task."""

    def union(batches):
        least: dict[int, int] = {}

        def root(x):
            while (up := least.setdefault(x, x)) != x:
                least[x] = x = least[up]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                least[max(a, b)] = min(a, b)
        nodes = list(least)
        for lo in range(0, len(nodes), 10_000):
            some = nodes[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], ["node", "comp"])

    return stored(edges.select("a", "b").coalesce(1).mapInArrow(union, "node long, comp long"), "labels")


def link_components(spark: SparkSession, sets: DataFrame, percent: int) -> DataFrame:
    """(id, comp) of the distinct sets (id, n, tokens) that are linked with another one.

    Rounds of leaders go on as long as each leaves at most ``SLOW`` of the pairs that the one before left.
    """
    lists = stored(index(sets, percent).withColumn("comp", F.col("id")), "index")
    comp = lists.select("id", "comp").distinct()
    own, used = sets, [lists]
    done: DataFrame | None = None  # pairs compared so far
    n_sets = None
    found, n_before, turn = True, float("inf"), -1
    while True:
        turn += 1
        # a list whose members are of one component is never read again, nor are sets in such lists only
        mixed = stored(lists.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most").select("key", "least"), "mixed")
        lists = stored(lists.join(mixed, "key"), "open")
        used += [mixed, lists]
        # entries of a list that lie in different components, were all compared with all
        shares = lists.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("cc"))
        n_open, n_pairs = shares.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("cc")) / 2), F.lit(0.0))).first()
        if not n_open:
            break
        ids = lists.select("id").distinct()
        n_ids = ids.count()
        if n_sets is None or 2 * n_ids < n_sets:
            own, n_sets = stored(own.join(ids, "id", "left_semi"), "rest"), n_ids
            used.append(own)
        last = turn > 0 and (not found or n_pairs <= EASY * n_open or (turn > 3 and n_pairs > SLOW * n_before))
        n_before = n_pairs
        pairs = every_pair(lists, percent) if last else leader_pairs(lists, percent, turn)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        if not last:
            pairs = pairs.groupBy("a").agg(F.max(F.struct("shared", "b", "comp", "comp_b")).alias("m")).select("a", "m.b", "m.comp", "m.comp_b")
        pairs = stored(pairs, "pairs")
        links = stored(linked(pairs, own, percent).select(F.col("comp").alias("a"), F.col("comp_b").alias("b")).distinct(), "links")
        used += [pairs, links]
        n_links = links.count()
        found, lists = n_links > 0, lists.drop("least")
        if found:
            to = few_components(links) if n_links <= FEW else components(links)
            used.append(to)
            named = to.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
            comp, lists = (df.join(named, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to") for df in (comp, lists))
            comp = stored(comp.select("id", "comp"), "comp")
            used.append(comp)
        if last:
            break
        done = pairs.select("a", "b") if done is None else done.unionByName(pairs.select("a", "b"))
    if not any(comp is t for t in used):
        comp = stored(comp, "comp")
    discard(*[t for t in used if t is not comp])
    return comp


def leader_pairs(lists: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each set outside a list's least component with the list's leader, a member of that component.

    In even turns that is one with the fewest tokens of its own, as the original of many edited copies has; else any.
    """
    order = F.struct(F.col("own") if turn % 2 == 0 else F.lit(0).cast("long"), F.xxhash64("id", F.lit(turn)))
    leader = lists.filter("comp = least").groupBy("key").agg(F.min(F.struct(order.alias("o"), "id", "n", "pos", "comp")).alias("l")).select("key", F.col("l.id").alias("b"), F.col("l.n").alias("n_b"), F.col("l.pos").alias("pos_b"), F.col("l.comp").alias("comp_b"))
    pairs = lists.filter("comp > least").join(stored(leader, "leader"), "key").filter(fits(percent))
    return pairs.groupBy(F.col("id").alias("a"), "b", "comp", "comp_b").agg(F.count("*").alias("shared"))


def every_pair(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list in different components that pass the bounds."""
    other = lists.select("key", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("comp").alias("comp_b"))
    return lists.join(other, "key").filter((F.col("comp") > F.col("comp_b")) & fits(percent)).select(F.col("id").alias("a"), "b", "comp", "comp_b").distinct()


def distinct_sets(every: DataFrame) -> tuple[DataFrame, bool]:
    """(sig, id, node, n, tokens) of each different set: its least id, and a number of its own; and whether some number isn't the id.

    That is the id, unless different texts share it: their numbers are hashes below all others.
    """
    first = every.filter(F.col("sig").isNotNull()).groupBy("sig").agg(F.min(F.struct("id", "n", "tokens")).alias("s"))
    classes = stored(first.select("sig", "s.id", F.col("s.id").alias("node"), "s.n", "s.tokens"), "classes")
    again = classes.groupBy("id").agg(F.count("*").alias("times")).filter("times > 1").select("id", "times")
    if not again.limit(1).count():
        return classes, False
    own = F.lit(-(1 << 62)) - F.shiftrightunsigned(F.xxhash64("sig"), 2)
    out = stored(classes.join(again, "id", "left").withColumn("node", F.when(F.col("times").isNull(), F.col("id")).otherwise(own)).drop("times"), "classes")
    discard(classes)
    return out, True


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, carry: Sequence[str] = ()) -> DataFrame:
    """(id_col, *carry, n_shingles, class_id, component_id, group_id), one row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set holds the hashes of its distinct
    k-word shingles (fewer words: the whole sequence).  ``class_id`` is the least id with an equal set,
    ``component_id`` the least id reachable by links of Jaccard similarity >= percent / 100.  ``group_id`` is equal for rows that reach
    each other, and differs from all others' also where ids repeat; it is null where nothing is linked.

    Null or empty text has an empty set (n_shingles 0), linked with nothing.  A null id is linked
    with nothing and has null class and component.  Repeated rows link like copies; different texts of one id are different
    documents, so several components can have the same ``component_id``.  An empty table gives an empty result.
    Columns not named in ``carry`` are ignored.  Shingles are identified by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("carry"))
    every = stored(survivors(rows, k, percent), "sets")
    classes, renamed = distinct_sets(every)
    comp = link_components(spark, classes.select(F.col("node").alias("id"), "n", "tokens"), percent)
    named = classes.select("sig", F.col("id").alias("class_id"), "node").join(comp.select(F.col("id").alias("node"), "comp"), "node", "left")
    named = named.select("sig", "class_id", F.coalesce("comp", "node").alias("group_id"))
    if renamed:
        least = named.groupBy("group_id").agg(F.min("class_id").alias("component_id"))
        named = named.join(least, "group_id")
    else:
        named = named.withColumn("component_id", F.col("group_id"))
    named = stored(named, "named")
    discard(classes, comp)
    extra = [F.col(f"carry.c{i}").alias(c) for i, c in enumerate(carry)]
    key, size = F.col("id").alias(id_col), F.col("n").alias("n_shingles")
    alone = every.filter(F.col("sig").isNull()).select(key, *extra, size, F.col("id").alias("class_id"), F.col("id").alias("component_id"), F.lit(None).cast("long").alias("group_id"))
    found = every.filter(F.col("sig").isNotNull()).select("id", "n", "sig", "carry").join(named, "sig")
    return alone.unionByName(found.select(key, *extra, size, "class_id", "component_id", "group_id"))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(class_a, class_b): every pair of different sets of Jaccard similarity >= percent / 100, class_a > class_b.

    Classes and arguments are those of ``jaccard_components``.  All pairs that share an index list and pass the bounds
    are compared, also inside a component, so the work grows with the number of links; nothing is capped.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0).alias("_")).alias("carry"))
    classes, _ = distinct_sets(stored(survivors(rows, k, percent), "sets"))
    sets = classes.select(F.col("node").alias("id"), "n", "tokens")
    lists = stored(index(sets, percent).withColumn("comp", F.col("id")), "index")
    pairs = stored(every_pair(lists, percent).select("a", "b"), "pairs")
    a, b = (classes.select(F.col("node").alias(x), F.col("id").alias(f"class_{x}")) for x in "ab")
    links = linked(pairs, sets, percent).select("a", "b").join(a, "a").join(b, "b")
    return links.select(F.greatest("class_a", "class_b").alias("class_a"), F.least("class_a", "class_b").alias("class_b"))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Contract query: 5-word shingles, similarity 0.8, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, "doc_id", "text", 5, 80).select("doc_id", "n_shingles", "component_id")
