"""Operator 9: exact top-k search by integer inner product, with multi-resolution segment statistics.

A segment of a vector has a mean and a deviation (the norm of what the mean leaves over). By Cauchy-Schwarz
    <q, x> <= sum over segments of (length * mean_q * mean_x + deviation_q * deviation_x),
which bounds the score from above and so the distance from below. Candidates lie in blocks of neighbours; a block whose
greatest means and deviations give a bound under the k-th score falls whole. In the others bounds run from few segments to
many over the pairs still alive, and what survives all levels is scored exactly. A level that drops fewer pairs than it costs is left
out for some blocks. The k-th scores begin with those among the queries themselves, which are rows of the table too.
Queries are a stated set, broadcast in blocks; every task keeps k rows for each query.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS, QUERIES, ROWS, HELD = (1, 4, 16), 2048, 256, 1 << 20
_LONG = 2**63


def integers(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: (rows, floor(1024 * x)) of the vectors without nulls and non-finite components."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = np.array([-1 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
    out = {}
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        x = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), d)
        ok = np.isfinite(x).all(axis=1)
        with np.errstate(over="ignore"):
            out[d] = rows[ok], np.nan_to_num(np.floor(x[ok] * 1024))
    return out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products are the upper bounds: sqrt(length) * mean of each segment, then its deviation."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    mean = np.column_stack([p.mean(axis=1) * np.sqrt(p.shape[1]) for p in parts])
    rest = np.column_stack([np.sqrt(np.maximum((p**2).sum(axis=1) - p.shape[1] * p.mean(axis=1) ** 2, 0)) for p in parts])
    return np.hstack([mean, rest])


def exact(q: np.ndarray, x: np.ndarray, pairs: bool = False) -> np.ndarray:
    """Exact inner products of all rows, or of *pairs* of rows: in doubles where no sum leaves 53 bits, in 64-bit integers, or in unbounded ones.

    Those that leave the range of long stand at its ends.
    """
    top = max(np.abs(q).max(initial=0), 1.0) * max(np.abs(x).max(initial=0), 1.0) * q.shape[1]
    many = (lambda a, b: np.einsum("ij,ij->i", a, b)) if pairs else (lambda a, b: a @ b.T)
    if top < 2.0**53:
        return many(q, x).astype(np.int64)
    if top < 2.0**62:
        return many(q.astype(np.int64), x.astype(np.int64))
    a, b = (np.array([[int(c) for c in r] for r in m], object).reshape(m.shape) for m in (q, x))
    whole = (a * b).sum(axis=1) if pairs else a.dot(b.T)
    return np.clip(whole, -_LONG, _LONG - 1).astype(np.int64)


class Best:
    """The k best rows of each query so far; of equal scores the smaller vec_id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.top = np.abs(q).max(initial=0)
        self.stats = [statistics(q, s) for s in LEVELS] if self.top < 2.0**400 else None
        self.least = np.full(len(ids), -np.inf)
        self.held, self.n_held = [(np.zeros(0, np.int64),) * 3], 0
        self.seen = self.scored = self.blocks = 0
        self.gain = [1.0] * len(LEVELS)
        for a in range(0, len(ids), ROWS) if len(ids) > k else ():  # lower bounds of the k-th scores
            s = exact(q[a : a + ROWS], q).astype(float)
            s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
            self.least[a : a + ROWS] = np.partition(s, -k, axis=1)[:, -k]

    def add(self, vec: np.ndarray, x: np.ndarray) -> None:
        top = np.abs(x).max(initial=0)
        if self.stats is None or top >= 2.0**400:  # squares would leave the doubles
            for a in range(0, len(vec), ROWS):
                self._block(vec[a : a + ROWS], x[a : a + ROWS], [], 0)
            return
        stats = [statistics(x, s) for s in LEVELS]
        # neighbours: rows of like means, from the greatest step down
        step = np.maximum(np.abs(stats[1][:, : LEVELS[1]]).max(axis=0, initial=0), 1) / 4
        order = np.lexsort(np.vstack([stats[1][:, 0], np.floor(stats[1][:, : LEVELS[1]] / step).T]))
        slack = 1 + 1e-9 * self.top * top * x.shape[1]
        for a in range(0, len(vec), ROWS):
            own = order[a : a + ROWS]
            self._block(vec[own], x[own], [s[own] for s in stats], slack)

    def _block(self, vec: np.ndarray, x: np.ndarray, stats: list[np.ndarray], slack: float) -> None:
        self.seen += len(self.ids) * len(vec)
        rows = np.arange(len(self.ids))
        for q, s in zip(self.stats if stats else [], stats, strict=True):
            half = s.shape[1] // 2
            lo, hi = s[:, :half].min(axis=0), s.max(axis=0)
            m = q[rows, :half]
            rows = rows[np.maximum(m, 0) @ hi[:half] + np.minimum(m, 0) @ lo + q[rows, half:] @ hi[half:] + slack >= self.least[rows]]
        if not len(rows):
            return
        least = self.least[rows, None]
        alive = self.ids[rows, None] != vec[None, :]
        n, tried = alive.sum(), self.blocks % 16 == 0
        self.blocks += 1
        for level, s in enumerate(stats):
            if not (tried or self.gain[level] * x.shape[1] > s.shape[1]):
                continue
            q = self.stats[level][rows]
            if n * 8 > alive.size:
                alive &= q @ s.T + slack >= least
            else:
                i, j = np.nonzero(alive)
                alive[i, j] = np.einsum("ij,ij->i", q[i], s[j]) + slack >= least[i, 0]
            before, n = n, alive.sum()
            self.gain[level] = 1 - n / max(before, 1)
            if not n:
                return
        if n * 8 > alive.size:
            self.scored += alive.size
            score = exact(self.q[rows], x)
            i, j = np.nonzero(alive & (score >= least))
            score = score[i, j]
        else:
            self.scored += int(n)
            i, j = np.nonzero(alive)
            score = exact(self.q[rows[i]], x[j], pairs=True)
            use = score >= least[i, 0]
            i, j, score = i[use], j[use], score[use]
        self.held.append((rows[i], vec[j], score))
        self.n_held += len(i)
        if self.n_held > HELD or self.blocks % 64 == 1:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, vec_id, score) of the k best so far; all that is worse is let go."""
        row, vec, score = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((vec, -1 - score, row))  # -1 - s turns the order round and never overflows
        row, vec, score = row[order], vec[order], score[order]
        first = np.searchsorted(row, np.arange(len(self.ids) + 1))
        place = np.arange(len(row)) - first[row]
        last = place == self.k - 1
        self.least[row[last]] = np.maximum(self.least[row[last]], score[last])
        use = place < self.k
        out = row[use], vec[use], score[use]
        self.held, self.n_held = [out], len(out[0])
        return out


def top_k(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose vec_id is divisible by *every* the k best of all other rows.

    Components are floor(1024 * x); ties go to the smaller vec_id. Vectors that are null or empty or hold null or
    non-finite components take no part, nor do rows without vec_id; vectors of another dimension are not compared; rows that share
    the query's vec_id are its own; of repeated queries the first in order of components counts; other repeated rows are
    candidates each; scores outside the range of long count as its ends, components over 2^1014 as the largest double; other
    columns are ignored; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    rows = embeddings.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    queries = rows.where((F.col("vec_id") % every == 0) & whole).groupBy("vec_id", F.size("embedding").alias("d")).agg(F.min("embedding").alias("embedding"))
    blocks = queries.count() // QUERIES + 1

    def of_block(i: int) -> DataFrame:
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id", "d").select("vec_id", "embedding").toArrow()  # about QUERIES rows
        ids = own.column("vec_id").to_numpy()
        sets = {d: (ids[at], q) for d, (at, q) in (integers(own.column("embedding")) if own.num_rows else {}).items()}
        shared = spark.sparkContext.broadcast(pickle.dumps(sets, 5))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {d: Best(*s, k) for d, s in pickle.loads(shared.value).items()}
            for batch in batches:
                vec = batch.column(0).to_numpy(zero_copy_only=False)
                for d, (at, x) in integers(batch.column(1)).items():
                    if d in best:
                        best[d].add(vec[at], x)
            for b in best.values():
                row, vec, score = b.best()
                yield pa.RecordBatch.from_arrays([pa.array(b.ids[row]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

        return rows.mapInArrow(run, "query_id long, vec_id long, score long")

    found = reduce(DataFrame.union, [of_block(i) for i in range(blocks)])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
