"""Exact top-k inner product search with an impact-ordered index, processed score at a time.

Vectors are dealt to index blocks. In a block each dimension has two posting lists (for query components above and below
zero) of non-negative impacts, cut into segments of equal quantised impact, highest first. A query processes the segments of all its
dimensions by descending |q_d| times the segment's impact, in a few rounds. After a round each vector has an upper bound (segments not
yet processed bound what is missing), and the vectors that have collected most are scored exactly. A vector is given up only if its
upper bound is below the k-th best of those scores; processing stops once few vectors are left, which are scored exactly in integers.
The result is exact whenever it stops.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without a vec_id.
Only vectors of a query's length are its candidates. Ties go to the smaller vec_id. Repeated vec_ids are candidates each for itself. Other
columns are ignored. A score among the best that does not fit 64 bits raises OverflowError; all others are exact, whatever the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stage
from .vectors import usable

#: Vectors in an index block, about, and quantised impacts of a list.
BLOCK, LEVELS = 4096, 64
#: Tasks of a search at most; more blocks share them. Lengths of vectors whose sizes are broadcast.
MOST, KINDS = 20_000, 100_000
#: Shares of a block's postings after which bounds are compared; a share of 1 / RESCORED of its vectors is cheaper scored than bounded.
STOPS, RESCORED = (0.5, 0.85, 0.96, 1.0), 16


class ImpactIndex:
    """Posting segments of one block of integer vectors.

    A list's segments lie one behind the other, highest impact first, so those that a query processes between two impacts are one slice.
    """

    def __init__(self, v: np.ndarray):
        self.v = v
        self.low, self.high = v.min(axis=0), v.max(axis=0)
        self.most = float(np.abs(v.astype(float)).max())
        if self.most >= 2.0**31:  # impacts are not worth their memory: see search()
            self.lists = {}
            return
        self.step = np.maximum(1, -(-(self.high - self.low + 1) // LEVELS))
        self.lists = {}
        for sign, level in {1: (v - self.low) // self.step, -1: (self.high - v) // self.step}.items():
            order = np.argsort(-level, axis=0, kind="stable").T.copy()
            ranked = np.take_along_axis(level.T, order, axis=1)
            # cut[d, l]: how many postings have level l or more
            cut = np.array([np.searchsorted(-x, -np.arange(LEVELS + 1), "right") for x in ranked])
            self.lists[sign] = order, ranked.astype(float), cut

    def search(self, q: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
        """Rows that may be among the k best, with the k best surely among them; own: rows that are no candidates."""
        n = len(self.v)
        left = np.ones(n, bool)
        left[own] = False
        dims = np.flatnonzero(q)
        few = max(4 * k, n // RESCORED)
        # bounds are held in doubles, which are exact below 2^53
        if left.sum() <= few or not len(dims) or not self.lists or self.most * float(np.abs(q.astype(float)).max()) * len(q) >= 2.0**53:
            return np.flatnonzero(left)
        weight, side = np.abs(q[dims]), q[dims] > 0
        unit = weight * self.step[dims]
        # impacts count from the least that a component can give
        base = int((q[dims] * np.where(side, self.low[dims], self.high[dims])).sum())
        parts = [tuple(x[d] for x in self.lists[1 if up else -1]) for d, up in zip(dims.tolist(), side)]
        cuts = np.array([c for _, _, c in parts])
        # impacts of all segments, from which those are read that part the postings into the wanted shares
        floor = unit[:, None] * np.arange(1, LEVELS + 1)
        order = np.argsort(-floor, axis=None)
        share = np.cumsum((cuts[:, :-1] - cuts[:, 1:]).ravel()[order])
        got, seen = np.zeros(n), np.zeros(n)
        done = np.zeros(len(dims), np.int64)
        for stop in STOPS:
            tau = 0 if stop == 1.0 else int(floor.ravel()[order[min(np.searchsorted(share, stop * share[-1]), share.size - 1)]])
            level = np.minimum(tau // unit, LEVELS)  # what is not processed has a lower level, and an impact below tau
            upto = cuts[np.arange(len(dims)), level]
            slices = [(o[a:b], u * x[a:b]) for (o, x, _), u, a, b in zip(parts, unit.tolist(), done.tolist(), upto.tolist()) if b > a]
            done = np.maximum(done, upto)
            if not slices:
                continue
            rows = np.concatenate([o for o, _ in slices])
            got += np.bincount(rows, np.concatenate([x for _, x in slices]), n)
            # met dimensions are known to within one level; of the others, those with no segment met give their most, the rest below tau
            missing = 0.0
            if tau:
                seen += np.bincount(rows, minlength=n)
                met = done > 0
                most = weight * (self.high - self.low)[dims]
                missing = most[~met].sum() + (met.sum() - seen) * tau
            some = np.flatnonzero(left)
            best = some[np.argpartition(-got[some], min(2 * k, len(some) - 1))[: 2 * k]]
            exact = self.v[best] @ q - base
            if len(best) >= k:
                least = np.partition(exact, len(best) - k)[len(best) - k]  # k vectors surely have as much
                left &= got + missing + (unit - weight).sum() >= least
            if left.sum() <= few:
                break
        return np.flatnonzero(left)


def _scores(index: ImpactIndex, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products; Python's integers where 64 bits may not hold a sum on its way."""
    if index.most * float(np.abs(q.astype(float)).max()) * len(q) < 2.0**63:
        return index.v[rows] @ q
    return np.array([sum(a * b for a, b in zip(x, q.tolist())) for x in index.v[rows].tolist()], object)


def _search(k: int):
    """Searches of a stream in which the vectors of a block go before the queries asked of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index, ids = None, [], None, None
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                own = part.column(3).to_numpy()
                v = part.column(4).flatten().to_numpy().reshape(b - a, -1)
                if tuple(place[:2, a]) != at:
                    at, held, index, ids = tuple(place[:2, a]), [], None, None
                if not place[2, a]:
                    held.append((own, v))
                    continue
                if index is None:
                    if not held:
                        continue
                    ids, rows = (np.concatenate(x) for x in zip(*held))
                    order = np.argsort(ids, kind="stable")
                    ids, index, held = ids[order], ImpactIndex(rows[order]), []
                for qid, q in zip(own.tolist(), v):
                    some = index.search(q, k, np.arange(*np.searchsorted(ids, [qid, qid + 1])))
                    score = _scores(index, some, q)
                    best = np.lexsort((ids[some], -score))[:k] if score.dtype != object else np.array(sorted(range(len(some)), key=lambda i: (-score[i], ids[some[i]]))[:k], int)
                    if score.dtype == object and any(abs(x) >= 1 << 63 for x in score[best]):
                        raise OverflowError(f"a score of vec_id {qid} does not fit 64 bits")
                    out.append((np.full(len(best), qid), ids[some[best]], score[best].astype(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors with the largest integer inner product with each query, among all others."""
    spark = vectors.sparkSession
    stage.ship(spark)
    rows = vectors.where("vec_id is not null").where(usable("embedding", zero=True))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = stage.written(spark, rows.withColumn("d", F.size("v")).withColumn("key", F.monotonically_increasing_id()), "index")
    # one row a length of vectors
    sizes = stage.written(spark, rows.groupBy("d").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")), "sizes")
    blocks, kinds = sizes.agg(F.sum(F.col("nb").cast("long")), F.count("*")).first()
    placed = rows.join(F.broadcast(sizes) if kinds < KINDS else sizes, "d")
    index = placed.withColumn("b", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int")).withColumn("query", F.lit(False))
    asked = placed.where("query").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cols = ["d", "b", "query", "vec_id", "v"]
    # a block is moved and indexed once, and all queries stream past it; bytes say nothing of the work, so partitions are counted by blocks
    both = index.select(cols).unionByName(asked.select(cols)).repartition(min(MOST, 2 * (blocks or 1)), "d", "b").sortWithinPartitions("d", "b", "query")
    found = both.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
