"""Exact top-k by inner product with a pivot table.

Distances from every vector to many pivots are tabulated.  By the triangle inequality the distance between
a query and a vector is at least max_p |d(query, p) - d(vector, p)|, and as
2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2 that is an upper bound of the score.  Candidates are evaluated in the order
of their bounds until the next bound is below the k-th score found so far.

That is exact in doubles for integer components below EXACT.  Pairs with a larger vector are scored by Python's integers,
of those candidates that a bound on the rounding of doubles leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries are sent to the executors in blocks of so many, so a broadcast never exceeds QUERIES vectors.
QUERIES = 4096
#: Integer components beyond this take no part: there is no such limit.
LIMIT = math.inf
#: With integer components below this, sums over up to 512 components are exact in doubles.
EXACT = 2**22
_FOUND = "query_id long, vec_id long, score decimal(38,0), place binary"


def finite_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and floor(1024 x) / 1024 of each component, which doubles hold exactly; rows with a null id, vector or component or a non-finite component are left out."""
    x = F.col(vector_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(math.inf), F.lit(False)))
    cut = F.transform(x, lambda v: F.when(F.abs(v) < F.lit(2.0**43), F.floor(v * F.lit(1024.0)).cast("double") / F.lit(1024.0)).otherwise(v))
    return table.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), cut.alias("x"))


def _near(x: Column) -> Column:
    """Whether all components are below EXACT, in vectors short enough for exact sums."""
    return F.forall(x, lambda v: F.abs(v) < F.lit(EXACT / 1024)) & (F.size(x) <= 512)


def integers(x: list[float]) -> list[int]:
    """1024 x, exactly."""
    return [int(v * 1024) if abs(v) < 2.0**900 else int(v) * 1024 for v in x]


def place(score: int) -> bytes:
    """Bytes that sort as the integers do."""
    n = (abs(score).bit_length() + 7) // 8
    return (0x8000 + n).to_bytes(2, "big") + score.to_bytes(n, "big") if score >= 0 else (0x8000 - n).to_bytes(2, "big") + (256**n - 1 + score).to_bytes(n, "big")


def choose_pivots(sample: np.ndarray, m: int) -> np.ndarray:
    """Farthest-first: each pivot is the vector farthest from those before it."""
    if not len(sample):
        return sample
    far = np.full(len(sample), np.inf)
    at, out = int(np.argmax((sample * sample).sum(1))), []
    for _ in range(min(m, len(sample))):
        out.append(at)
        far = np.minimum(far, ((sample - sample[at]) ** 2).sum(1))
        at = int(np.argmax(far))
        if far[at] == 0:
            break
    return sample[out]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances; the sums are exact in doubles, as components are below LIMIT."""
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


class Search:
    """The best k of all vectors seen so far, for a block of queries of one length."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int):
        self.ids, self.q, self.pivots, self.k = ids, queries, pivots, k
        self.table, self.square = distances(queries, pivots), (queries * queries).sum(1)
        self.best_score = [np.zeros(0, np.int64) for _ in ids]
        self.best_id = [np.zeros(0, np.int64) for _ in ids]
        self.evaluated = 0

    def add(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray) -> None:
        """table: the vectors' distances to the pivots."""
        square = (x * x).sum(1)
        for i, own in enumerate(self.ids.tolist()):
            kth = self.best_score[i][-1] if len(self.best_score[i]) == self.k else None
            live, low, bound = np.flatnonzero(ids != own), np.zeros(len(x)), np.full(len(x), np.inf)
            # some pivots at a time, so that most vectors are dropped after the first few
            for p in range(0, table.shape[1], 8):
                gap = np.abs(table[live, p : p + 8] - self.table[i, p : p + 8]).max(1)
                low[live] = np.maximum(low[live], gap)
                # roots and differences are rounded; the slack keeps the bound a bound
                sure = np.maximum(low[live] * (1 - 1e-9) - 1e-6, 0)
                bound[live] = np.floor((self.square[i] + square[live] - sure * sure) / 2 * (1 + 1e-12) + 1e-3)
                if kth is not None:
                    live = live[bound[live] >= kth]
            live = live[np.argsort(-bound[live], kind="stable")]
            at, step = 0, max(32, 4 * self.k)
            while at < len(live):
                if len(self.best_score[i]) == self.k and bound[live[at]] < self.best_score[i][-1]:
                    break
                part = live[at : at + step]
                self.evaluated += len(part)
                score = np.concatenate([self.best_score[i], np.rint(x[part] @ self.q[i]).astype(np.int64)])
                who = np.concatenate([self.best_id[i], ids[part]])
                order = np.lexsort((who, -score))[: self.k]
                self.best_score[i], self.best_id[i] = score[order], who[order]
                at, step = at + step, step * 2


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(len(column), -1)


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The index: vec_id, v and the distances to the pivots (null where the length is another)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(np.array(batch.column(1).offsets))
            same = sizes == pivots.shape[1]
            out: list = [None] * batch.num_rows
            if same.any():
                rows = np.flatnonzero(same)
                d = distances(_matrix(batch.column(1).take(pa.array(rows))), pivots)
                for k, r in zip(rows.tolist(), d, strict=True):
                    out[k] = r
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], ["vec_id", "v", "d"])

    return vectors.mapInArrow(run, "vec_id long, v array<int>, d array<double>")


def top_k(table: DataFrame, queries: DataFrame, k: int = 10, pivots: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of `table` for every row of `queries`, ties to the smaller vec_id.

    A query's own vec_id is no candidate.  Vectors are compared with vectors of the same length.  Rows that
    finite_vectors() leaves out take no part, neither as query nor as candidate; of rows with one query id
    one counts (the smallest vector); repeated candidates stay.  Empty tables give no rows.  A score of more
    than 38 digits is null; ranks are exact all the same.
    """
    vectors = finite_vectors(table, id_col, vector_col)
    near = vectors.where(_near(F.col("x"))).select("vec_id", F.transform("x", lambda v: (v * F.lit(1024.0)).cast("int")).alias("v"))
    wide = vectors.where(~_near(F.col("x")))
    asked = finite_vectors(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("x").alias("x"))
    sizes = [r[0] for r in asked.select(F.size("x")).distinct().collect()]
    wide_sizes = {r[0] for r in wide.select(F.size("x")).distinct().collect()} if sizes else set()
    found = []
    for size in sorted(sizes):
        own = asked.where(F.size("x") == size).select("vec_id", "x", _near(F.col("x")).alias("near"))
        blocks = -(-own.count() // QUERIES)
        split = F.pmod(F.xxhash64("vec_id"), F.lit(2 * blocks if blocks > 1 else 1))
        for b in range(2 * blocks if blocks > 1 else 1):
            rows = own.where(split == b).orderBy("vec_id").collect() if blocks > 1 else own.orderBy("vec_id").collect()
            some = [r for r in rows if r.near]
            far = [r for r in rows if not r.near]
            if some:
                ids, q = np.array([r.vec_id for r in some], np.int64), np.array([r.x for r in some], np.float64)
                chosen = choose_pivots(q * 1024, pivots)
                found.append(pivot_table(near.where(F.size("v") == size), chosen).mapInArrow(_searcher(ids, q * 1024, chosen, k), _FOUND))
                if size in wide_sizes:
                    found.append(wide.where(F.size("x") == size).mapInArrow(_far(ids, q, k), _FOUND))
            if far:
                ids, q = np.array([r.vec_id for r in far], np.int64), np.array([r.x for r in far], np.float64)
                found.append(vectors.where(F.size("x") == size).mapInArrow(_far(ids, q, k), _FOUND))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score decimal(38,0)")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    w = Window.partitionBy("query_id").orderBy(F.desc("place"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _found(query: np.ndarray, who: np.ndarray, scores: list[int]) -> pa.RecordBatch:
    fit = [Decimal(s) if abs(s) < 10**38 else None for s in scores]
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(who, pa.int64()), pa.array(fit, pa.decimal128(38, 0)), pa.array([place(s) for s in scores], pa.binary())], ["query_id", "vec_id", "score", "place"])


def _far(ids: np.ndarray, q: np.ndarray, k: int):
    """The best k of any vectors by exact integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in ids]
        exact = [integers(x) for x in q.tolist()]
        for batch in batches:
            if not batch.num_rows:
                continue
            own, x = np.array(batch.column(0), np.int64), _matrix(batch.column(1))
            # beyond this, products overflow in doubles
            huge, seen = np.abs(x).max(1) > 2.0**490, {}
            tame = np.where(huge[:, None], 0.0, x)
            for i, mine in enumerate(ids.tolist()):
                live = own != mine
                if np.abs(q[i]).max() <= 2.0**490:
                    about, slack = tame @ q[i], (x.shape[1] + 4) * 2.0**-52 * (np.abs(tame) @ np.abs(q[i]))
                    # the k-th of what is surely reached; what can't reach it is out
                    sure = (about - slack)[live & ~huge]
                    if len(sure) > k:
                        live &= huge | (about + slack >= np.partition(sure, -k)[-k])
                for r in np.flatnonzero(live).tolist():
                    if r not in seen:
                        seen[r] = integers(x[r].tolist())
                    best[i].append((-sum(a * b for a, b in zip(exact[i], seen[r], strict=True)), int(own[r])))
                best[i] = sorted(best[i])[:k]
        some = [(int(ids[i]), who, -s) for i, part in enumerate(best) for s, who in part]
        if some:
            yield _found(np.array([r[0] for r in some]), np.array([r[1] for r in some]), [r[2] for r in some])

    return run


def _searcher(ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(ids, q, pivots, k)
        first = True
        for batch in batches:
            if batch.num_rows:
                own, x, table = np.array(batch.column(0), np.int64), _matrix(batch.column(1)), _matrix(batch.column(2))
                # a few vectors first: their k-th score lets the bounds drop most of the others
                cut = [0, min(256, len(own)), len(own)] if first else [0, len(own)]
                for i, j in zip(cut, cut[1:], strict=False):
                    if i < j:
                        search.add(own[i:j], x[i:j], table[i:j])
                first = False
        counts = [len(x) for x in search.best_id]
        if sum(counts):
            yield _found(np.repeat(ids, counts), np.concatenate(search.best_id), np.concatenate(search.best_score).tolist())

    return run
