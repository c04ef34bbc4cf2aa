"""Exact inner-product top-k by vector-approximation files.

Every component becomes floor(256 * x).  Queries are taken in blocks of a bounded size, each of
which is broadcast and meets the stored vectors where they lie: no vector is shuffled, and only
the best k of each query and part are, to be merged per query.

A batch of vectors is first scanned by its approximations, of 256 uniform cells a dimension.  A
query's best possible product with a cell bounds its score from above, and as cells are uniform
one product with the cells' numbers gives all bounds.  Exact vectors are then read in the order of
these bounds until the kth score is certain, that is, until no bound that is left reaches the
best k that this batch and those before it gave.  The work is queries x vectors, as the question
asks; memory is one batch of vectors and one block of queries, and nothing depends on how ids or
values are spread.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, as
query or candidate; a null id takes no part; vectors meet only vectors of their own length; a
row that repeats an id is a row of its own, and a candidate for its twin; ties go to the smaller
id, then to the earlier row; scores beyond a long are held at its limits; vectors with components
of EXACT and more, beyond which float64 products are not exact, are compared by whole numbers
without bounds; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, ship

CELLS = 256
#: Bytes of a block of queries, at 8 a component: what the driver holds and a worker gets.
BLOCK_BYTES = 32 << 20
#: Queries whose bounds are held at once.
QUERIES_AT_ONCE = 256
#: Up to this size of a component float64 products of whole numbers are exact.
EXACT = 1 << 20


def approximate(vectors: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, low, step): vectors[i, j] lies between low[j] + step[j] * codes[i, j] and one step above."""
    low = vectors.min(axis=0).astype(np.float64)
    step = np.maximum((vectors.max(axis=0) - low) / cells, 1e-9) * (1 + 1e-12)
    codes = np.minimum((vectors - low) / step, cells - 1).astype(np.uint8)
    return codes, low, step


class Best:
    """The k best (score, id, row) of each query so far."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int):
        self.queries, self.own, self.k = queries, own, k
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3] * len(queries)
        self.large = bool(queries.size and np.abs(queries).max() >= EXACT) or queries.shape[1] > EXACT

    def add(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Let the queries meet a batch of vectors."""
        n, dim = vectors.shape
        if not n or not len(self.queries):
            return
        if dim == 0 or self.large or np.abs(vectors).max() >= EXACT:
            for i, q in enumerate(self.queries):
                self._keep(i, _whole_products(vectors, q), ids, rows, np.arange(n))
            return
        codes, low, step = approximate(vectors)
        codes = codes.astype(np.float32)
        for start in range(0, len(self.queries), QUERIES_AT_ONCE):
            q = self.queries[start : start + QUERIES_AT_ONCE].astype(np.float64)
            scaled = q * step
            upper = scaled.astype(np.float32) @ codes.T
            # what a cell's width and the rounding of float32 sums can add
            free = q @ low + np.maximum(scaled, 0).sum(axis=1) + np.abs(scaled).sum(axis=1) * CELLS * (dim + 2) * 1.2e-7 + 1e-6 * (1 + np.abs(q @ low))
            first = min(n, 8 * self.k + 1)
            head = np.argpartition(upper, n - first, axis=1)[:, n - first :] if first < n else np.tile(np.arange(n), (len(q), 1))
            for i in range(len(q)):
                self._search(start + i, q[i], upper[i], free[i], head[i], vectors, ids, rows)

    def _search(self, i: int, q: np.ndarray, upper: np.ndarray, free: float, head: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Exact products of the highest bounds, then of the others in their order until the kth score is certain."""
        self._keep(i, (vectors[head] @ q).astype(np.int64), ids, rows, head)
        if len(head) == len(upper):
            return
        rest = upper >= self._worst(i) - free
        rest[head] = False
        more = np.flatnonzero(rest)
        more = more[np.argsort(-upper[more], kind="stable")]
        for cut in range(0, len(more), 256):
            at = more[cut : cut + 256]
            if upper[at[0]] + free < self._worst(i):
                break
            self._keep(i, (vectors[at] @ q).astype(np.int64), ids, rows, at)

    def _worst(self, i: int) -> float:
        score = self.found[i][0]
        return float(score[-1]) if len(score) == self.k else -np.inf

    def _keep(self, i: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
        other = rows[at] != self.own[i]
        score, at = score[other], at[other]
        if len(self.found[i][0]) == self.k and len(score) and score.max() < self.found[i][0][-1]:
            return
        score, id_, row = (np.concatenate(x) for x in zip(self.found[i], (score, ids[at], rows[at]), strict=True))
        best = np.lexsort((row, id_, ~score))[: self.k]  # ~x falls as x rises, over all of a long
        self.found[i] = (score[best], id_[best], row[best])


def _whole_products(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products by whole numbers of any size, held at a long's limits."""
    if not vectors.shape[1]:
        return np.zeros(len(vectors), np.int64)
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(max(int(x), low), high) for x in vectors.astype(object) @ q.astype(object)], np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(uid, id, dim, v): the vectors that take part, as whole numbers."""
    v = F.col(vec_col)
    usable = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(usable).select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.size(v).alias("dim"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v")
    )


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest products for every row where is_query holds (over the column named id)."""
    spark = vectors.sparkSession
    ship(spark)
    base = materialize(whole_vectors(vectors, id_col, vec_col), "topk-vectors")
    asked = base.where(is_query)
    size = asked.agg(F.sum(F.lit(16) + 8 * F.col("dim"))).first()[0] or 0
    blocks = -(-size * 5 // (4 * BLOCK_BYTES)) or 1  # by a hash of the row, with room for uneven ones
    met = []
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b).toArrow()
        held = {dim: (_matrix(rows.column("v")), rows.column("uid").to_numpy(), rows.column("id").to_numpy()) for x in part.combine_chunks().to_batches() for dim, rows in _by_length(x)}
        one = base.mapInArrow(_meet(spark.sparkContext.broadcast(held), k), "own long, query_id long, uid long, vec_id long, score long")
        met.append(one if blocks == 1 else materialize(one, "topk-block"))
    order = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id", "uid")
    return reduce(DataFrame.unionByName, met).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _meet(held, k: int):
    """The best k of a part's vectors for each query that is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: Best(q, own, k) for dim, (q, own, _) in held.value.items()}
        for batch in batches:
            for dim, rows in _by_length(batch):
                if dim in best:
                    col = lambda name, r=rows: r.column(r.schema.get_field_index(name))
                    best[dim].add(_matrix(col("v")), col("id").to_numpy(), col("uid").to_numpy())
        for dim, x in best.items():
            _, own, name = held.value[dim]
            times = [len(score) for score, _, _ in x.found]
            if sum(times):
                score, id_, row = (np.concatenate(y) for y in zip(*x.found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, times)), pa.array(np.repeat(name, times)), pa.array(row), pa.array(id_), pa.array(score)], names=["own", "query_id", "uid", "vec_id", "score"])

    return run
