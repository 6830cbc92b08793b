"""Exact inner-product top-k on an impact-ordered, score-at-a-time index.

Vectors are dealt into blocks.  In a block the components (postings) are sorted into *segments* by quantised impact:
segment c of a dimension holds the vectors whose component has level c there, levels being multiples of a step.
Segments that few vectors are in are posting lists (vectors and impacts by dimension); where a level holds more than
``DENSE`` of all components its segments are kept as planes of the whole block, as dense lists are.
Queries process all segments of one level, from the highest impact down.  After a level,

* S = sum of query component x quantised impact over processed postings, off by less than one step each;
* unprocessed postings have less impact than the level's lower edge.

That bounds every score from both sides.  A query stops only when the bounds prove that few vectors can still be
among its k best; those are scored exactly from their integer components.  Blocks' winners are merged by window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors and queries in a block, and queries scored together in it.
BLOCK, QUERIES, TOGETHER = 8192, 4096, 256
LEVELS = 24
#: Levels that are processed between two tests of the bounds.
STRIDE = 4
#: Share of a block's components above which a level's postings are a plane.
DENSE = 1 / 50


class Plane:
    """Postings of a level as matrices: vectors x dimensions."""

    def __init__(self, impact: np.ndarray, mask: np.ndarray):
        self.impact, self.mask = impact.astype(np.float64), mask.astype(np.float64)

    def add(self, q: np.ndarray, weight: np.ndarray, twice: np.ndarray, done: np.ndarray) -> None:
        twice += q @ self.impact.T
        done += weight @ self.mask.T


class Lists:
    """Postings of a level as lists by dimension: vectors (each at most once) and their impacts."""

    def __init__(self, impact: np.ndarray, mask: np.ndarray):
        dims, vectors = np.nonzero(mask.T)
        at = np.flatnonzero(np.diff(dims, prepend=-1))
        self.lists = [(int(dims[a]), vectors[a:b], impact[vectors[a:b], dims[a]].astype(np.float64)) for a, b in zip(at, np.append(at[1:], len(dims)))]

    def add(self, q: np.ndarray, weight: np.ndarray, twice: np.ndarray, done: np.ndarray) -> None:
        for d, vectors, impacts in self.lists:
            twice[:, vectors] += q[:, d : d + 1] * impacts
            done[:, vectors] += weight[:, d : d + 1]


class Segments:
    """A block's vectors by impact level: ``level`` 0 .. LEVELS - 1 of each component, highest first in time."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        most = int(np.abs(vectors).max()) if vectors.size else 0
        self.step = most // LEVELS + 1
        self.level = np.abs(vectors) // self.step

    def waves(self):
        """(lower edge of what is processed so far, postings) of the segments of STRIDE levels at a time."""
        for top in range(LEVELS, 0, -STRIDE):
            bottom = max(0, top - STRIDE)
            mask = (self.level >= bottom) & (self.level < top)
            # the middle of a level is off by half a step at most
            impact = np.where(mask, np.sign(self.vectors) * (2 * self.level * self.step + self.step), 0)
            yield bottom * self.step, (Lists if mask.sum() <= DENSE * mask.size else Plane)(impact, mask)


def best_of_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec row, score) of each query's k best in the block, ties to the smaller id."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    index = Segments(vectors)
    waves = list(index.waves())
    for lo in range(0, len(queries), TOGETHER):
        open_ = np.arange(lo, min(len(queries), lo + TOGETHER))
        q = queries[open_].astype(np.float64)
        weight = np.abs(q)
        total = weight.sum(1)[:, None]
        twice, done = np.zeros((len(open_), len(ids))), np.zeros((len(open_), len(ids)))
        for i, (edge, postings) in enumerate(waves):
            postings.add(q, weight, twice, done)
            slack = done * index.step + 2 * edge * (total - done)  # all doubled, as the middles of levels are halves
            own = ids[None, :] == query_ids[open_][:, None]
            upper = np.where(own, -np.inf, twice + slack)
            lower = np.where(own, -np.inf, twice - slack)
            at = min(k, len(ids)) - 1
            proven = np.partition(lower, len(ids) - 1 - at, axis=1)[:, len(ids) - 1 - at][:, None]
            possible = upper >= proven
            possible &= ~own
            left = possible.sum(1)
            ready = (left <= 8 * k) | (i == len(waves) - 1)
            for row in np.flatnonzero(ready):
                near = np.flatnonzero(possible[row])
                score = vectors[near] @ queries[open_[row]]
                order = np.lexsort((ids[near], -score))[:k]
                out.append((np.full(len(order), open_[row]), near[order], score[order]))
            if ready.all():
                break
            stay = ~ready
            open_, q, weight, total, twice, done = open_[stay], q[stay], weight[stay], total[stay], twice[stay], done[stay]
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def fits_doubles(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether twice any inner product, its bounds included, is exact in 53 bits."""
    most = lambda m: max(abs(int(m.max())), abs(int(m.min()))) + 1 if m.size else 0
    return 8 * most(x) * most(y) * max(1, x.shape[1]) < 1 << 53


def best_of_large(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best_of_block in integers of any size, for components that doubles can't sum up."""
    out: list[tuple[list[int], list[int], list[int]]] = [([], [], [])]
    wide = vectors.astype(object)
    for i, q in enumerate(queries):
        score = wide @ q.astype(object) if wide.shape[1] else np.zeros(len(ids), object)
        order = sorted(np.flatnonzero(ids != query_ids[i]).tolist(), key=lambda j: (-score[j], ids[j]))[:k]  # noqa: B023
        if any(not -(1 << 63) <= score[j] < 1 << 63 for j in order):
            raise OverflowError("a score does not fit into a long")
        out.append(([i] * len(order), order, [int(score[j]) for j in order]))
    return tuple(np.array(sum(x, []), np.int64) for x in zip(*out))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of integers as rows, shorter ones padded by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths())
    width = int(size.max()) if len(size) else 0
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = np.asarray(column.flatten())
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of highest integer inner product.

    Components become floor(scale * x).  A row is no candidate of the query with its own id.  Ties go to the
    smaller id; a query with fewer candidates gets all.  Rows whose vector or id is null, or whose vector holds null,
    NaN or infinite components, take no part.  Shorter vectors count as padded by zeros; empty vectors score
    0.  Repeated ids are separate candidates.  Empty tables give an empty result.  Other columns are ignored.
    Scores of any size are exact; a component or one of the k best scores that a long can't hold is an error.
    """
    vector = F.col(vector_col)
    whole = lambda n, x: F.when(F.abs(x) < 2.0**63, n.cast("long")).otherwise(F.raise_error(F.lit("a component does not fit into a long")).cast("long"))
    usable = F.col(id_col).isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    clean = lambda df: df.filter(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: whole(F.floor(x.cast("double") * scale), x.cast("double") * scale)).alias("v"))
    n_vectors, n_queries = vectors.select(id_col).count(), queries.select(id_col).count()
    n_blocks, n_groups = max(1, -(-n_vectors // BLOCK)), max(1, -(-n_queries // QUERIES))
    blocks = clean(vectors).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    groups = clean(queries).withColumn("g", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n_groups)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def search(left, right):
        ids, query_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        x, y = matrix(left.column("v")), matrix(right.column("v"))
        width = max(x.shape[1], y.shape[1])
        x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y))
        if not len(ids) or not len(query_ids):
            q, v, s = (np.zeros(0, np.int64),) * 3
        else:
            best = best_of_block if fits_doubles(x, y) else best_of_large
            q, v, s = best(ids, x, query_ids, y, k)
        return pa.table({"query_id": query_ids[q], "vec_id": ids[v], "score": s.astype(np.int64)})

    found = blocks.groupBy("b", "g").cogroup(groups.groupBy("b", "g")).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    """Contract query: vectors whose vec_id is divisible by 100 against all."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
