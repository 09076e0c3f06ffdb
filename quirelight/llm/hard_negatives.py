"""Hard negatives by a vector-approximation file.

Vectors are dealt to blocks, each one row of a written table: the approximations (every dimension quantised into CELLS cells of about
equally many of the block's values, two cells a byte, column by column), the cells' least and greatest values, and beside them the vectors
themselves, sorted by label. For an anchor, each byte's 256 possible sums of products with a cell's ends are tabulated; reading them along the
approximations gives a lower and an upper bound of every score. Only vectors whose bounds may enter what is asked (the best k of the
anchor's label; the best k between two scores of other labels) are scored exactly.

Anchors visit blocks, not the other way round: a block is moved once, and groups of anchors stream past it in sorted order, so a task holds one block and
one group. Each block returns k rows at most for each question; the best of them are chosen by a rank that Spark limits before the shuffle.

Scores are whole numbers. Bounds and products are held in doubles while those are exact (below 2^53), else in 64-bit integers,
else in Python's integers, and only a score that itself does not fit 64 bits raises OverflowError.

Defined results: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Vectors of different
length are no candidates of each other. Ties go to the smaller vec_id. Rows that repeat a vec_id are candidates and anchors each for itself, but no
row is a candidate of an anchor of its own vec_id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stage

#: Vectors in a block, about; anchors that travel in one row; cells of a dimension (two fit a byte).
BLOCK, GROUP, CELLS = 2048, 64, 16
#: Tasks that blocks are dealt to at most.
MOST = 20_000


def whole(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * component) of doubles: 64-bit integers, or Python's where those do not hold them."""
    x = np.floor(scale * v)
    if x.size == 0 or np.abs(x).max() < 2.0**62:
        return x.astype(np.int64)
    if not np.isfinite(x).all():
        raise OverflowError("a scaled component does not fit a double")
    return np.array([[int(c) for c in row] for row in x], object)


class Block:
    """Approximations of one block of integer vectors, and the vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.v = ids[order], labels[order], v[order]
        n, d = v.shape
        self.most = max((abs(int(x)) for x in (v.min(), v.max())), default=0) if v.size else 0
        cells = np.zeros((d + d % 2, n), np.uint8)
        self.low, self.high = np.zeros((2, d + d % 2, CELLS))
        if self.most < 1 << 53:
            # the first places of equally full cells; equal values share a cell, so a cell is an interval of values
            cut = np.arange(1, CELLS) * n // CELLS
            for k, x in enumerate(self.v.T):
                ranked = np.sort(x)
                marks = ranked[cut]
                cells[k] = np.searchsorted(marks, x, "right")
                first = np.searchsorted(ranked, marks, "left")
                ends = np.concatenate([[0], first, [n]])
                full = ends[1:] > ends[:-1]
                self.low[k, full], self.high[k, full] = ranked[ends[:-1][full]], ranked[ends[1:][full] - 1]
        self.codes = cells[0::2] | cells[1::2] << 4

    def packed(self) -> dict[str, bytes | int]:
        v = self.v.astype(np.int64) if self.most < 1 << 62 else self.v
        return {"n": len(self.ids), "ids": self.ids.tobytes(), "labels": self.labels.tobytes(), "low": self.low.tobytes(), "high": self.high.tobytes(), "codes": self.codes.tobytes(), "v": v.tobytes() if v.dtype != object else repr(v.tolist()).encode(), "most": str(self.most)}

    @classmethod
    def unpacked(cls, row: dict) -> Block:
        out = cls.__new__(cls)
        n = row["n"]
        out.ids, out.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        out.most = int(row["most"])
        out.low, out.high = (np.frombuffer(row[c]).reshape(-1, CELLS) for c in ("low", "high"))
        out.codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, n)
        if out.most < 1 << 62:
            out.v = np.frombuffer(row["v"], np.int64).reshape(n, -1)
        else:
            import ast

            out.v = np.array(ast.literal_eval(row["v"].decode()), object).reshape(n, -1)
        out.exact = out.v.astype(np.float64) if out.most < 1 << 53 else out.v
        return out

    def small(self, q: np.ndarray, bound: int) -> bool:
        """Whether no sum of products with q can reach the bound."""
        return self.most * max((abs(int(x)) for x in q), default=0) * max(1, len(q)) < bound

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact integer inner products of some rows."""
        if self.small(q, 1 << 53):
            return np.rint(self.exact[rows] @ q.astype(np.float64)).astype(np.int64)
        if self.small(q, 1 << 63):
            return self.v[rows] @ q.astype(np.int64)
        return np.array([sum(int(a) * int(b) for a, b in zip(x, q)) for x in self.v[rows]], object)

    def bounds(self, q: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray] | None:
        """Lower and upper bounds of a slice of rows by table lookup; None where doubles are not exact."""
        if not self.small(q, 1 << 52):
            return None
        w = np.zeros(len(self.low))
        w[: len(q)] = q
        ends = w[:, None] * self.low, w[:, None] * self.high
        both = np.minimum(*ends) + 1j * np.maximum(*ends)
        # byte: the odd dimension's cell in the high half; a lower bound and an upper one in a complex number
        table = (both[1::2, :, None] + both[0::2, None, :]).reshape(len(both) // 2, CELLS * CELLS)
        total = np.zeros(rows.stop - rows.start, np.complex128)
        for t, c in zip(table, self.codes[:, rows]):
            total += t[c]
        return total.real, total.imag

    def slices(self, label: int) -> tuple[slice, slice, slice]:
        """Rows of the label, and those before and after them."""
        a, b = np.searchsorted(self.labels, [label, label + 1])
        return slice(int(a), int(b)), slice(0, int(a)), slice(int(b), len(self.ids))

    def best(self, score: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[rows], -score))[:k] if score.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (-score[i], self.ids[rows[i]]))[:k], int)
        return self.ids[rows[order]], score[order]

    def positives(self, own: int, label: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k rows of the label, own ids excluded."""
        here = self.slices(label)[0]
        rows = np.arange(here.start, here.stop)
        rows = rows[self.ids[rows] != own]
        found = self.bounds(q, here) if len(rows) > k else None
        if found is not None:
            low, high = (x[rows - here.start] for x in found)
            rows = rows[high >= np.partition(low, len(low) - k)[len(low) - k]]
        return self.best(self.scores(q, rows), rows, k)

    def negatives(self, label: int, q: np.ndarray, windows: list[tuple[int, int]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each window (least, most) of scores, by its place: ids and scores of the best k rows of other labels in it."""
        _, before, after = self.slices(label)
        rows = np.concatenate([np.arange(before.start, before.stop), np.arange(after.start, after.stop)])
        found = [self.bounds(q, s) for s in (before, after)] if len(rows) else [None]
        if found[0] is not None:
            low, high = (np.concatenate(x) for x in zip(*found))
        for place, (least, most) in enumerate(windows):
            if least > most or not len(rows):
                continue
            some = rows
            if found[0] is not None:
                may = (high >= least) & (low <= most)
                sure = low[(low >= least) & (high <= most)]
                if len(sure) > k:  # k vectors surely lie in the window with as much
                    may &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
                some = rows[may]
            score = self.scores(q, some)
            inside = np.array([least <= s <= most for s in score], bool) if score.dtype == object else (score >= least) & (score <= most)
            if inside.any():
                yield place, *self.best(score[inside], some[inside], k)


def _int64(values: list) -> pa.Array:
    return pa.array([int(x) for x in values], pa.int64())  # pyarrow raises OverflowError where one does not fit


def _streamed(asked: DataFrame, answer: Callable[[Block, dict], Iterator[tuple]], schema: list[str]) -> DataFrame:
    """Rows of answer(block, question) for a stream in which a block goes before the questions asked of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, None
        for b in batches:
            out: list[tuple] = []
            for row in (r for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
                if row["block"] is not None:
                    block, at = Block.unpacked(row["block"]), (row["d"], row["b"])
                elif (row["d"], row["b"]) == at:
                    out += answer(block, row["ask"])
            if out:
                yield pa.RecordBatch.from_arrays([_int64(x) for x in zip(*out)], names=schema)

    return asked.mapInArrow(run, ", ".join(f"{c} long" for c in schema))


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, k: int = 5, take: int = 5, least: int = 80, most: int = 100, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, embedding, label).

    An anchor's positives are the k rows of its label with the largest integer inner product; for each, the first `take` rows of other labels
    with least % to most % of its score.
    """
    spark = vectors.sparkSession
    stage.ship(spark)
    fine = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    rows = vectors.where("vec_id is not null").where(label.isNotNull() & F.col("embedding").isNotNull() & fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = stage.written(spark, rows.withColumn("d", F.size("v")).withColumn("key", F.monotonically_increasing_id()), "vectors")
    # one row a length of vectors
    sizes = rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if("anchor").alias("na")).select("d", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("na") / GROUP).cast("int").alias("ng"))
    sizes = stage.written(spark, sizes, "sizes")
    total, kinds = sizes.agg(F.sum("nb"), F.count("*")).first()
    n = max(1, min(MOST, 2 * (total or 0)))
    sized = lambda x: x.join(F.broadcast(sizes) if kinds < 100_000 else sizes, "d")
    spread = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")  # noqa: E731  keys are distinct: no group is hot

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), -1)
        block = Block(pdf["vec_id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64), whole(v, scale))
        return pd.DataFrame([{"d": int(pdf["d"].iloc[0]), "b": int(pdf["b"].iloc[0])} | block.packed()])

    held = "n int, ids binary, labels binary, low binary, high binary, codes binary, v binary, most string"
    file = sized(rows).withColumn("b", spread("nb")).select("d", "b", "vec_id", "label", "v").repartition(n, "d", "b").groupBy("d", "b").applyInPandas(built, f"d int, b int, {held}")
    file = stage.written(spark, file, "approximations")
    blocks = file.select("d", "b", F.struct(*(c.split()[0] for c in held.split(", "))).alias("block"))

    def visits(anchors: DataFrame) -> DataFrame:
        """Blocks, each before all groups of anchors (d, key, anchor_id, label, v, windows) of its length."""
        grouped = sized(anchors).withColumn("g", spread("ng")).groupBy("d", "nb", "g").agg(F.collect_list(F.struct("key", "anchor_id", "label", "v", "windows")).alias("ask"))
        asked = grouped.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("d", "b", "ask")
        both = blocks.withColumn("ask", F.lit(None).cast(asked.schema["ask"].dataType)).unionByName(asked.withColumn("block", F.lit(None).cast(blocks.schema["block"].dataType)))
        return both.repartition(n, "d", "b").sortWithinPartitions("d", "b", F.col("block").isNull())

    def like(block: Block, ask: list[dict]) -> Iterator[tuple]:
        for a in ask:
            q = whole(np.array([a["v"]], np.float64), scale)[0]
            for i, s in zip(*block.positives(a["anchor_id"], a["label"], q, k)):
                yield a["key"], i, s

    def unlike(block: Block, ask: list[dict]) -> Iterator[tuple]:
        for a in ask:
            q = whole(np.array([a["v"]], np.float64), scale)[0]
            windows = [(-(-least * p // 100), most * p // 100) for p in a["windows"]]
            for place, ids, scores in block.negatives(a["label"], q, windows, take):
                for i, s in zip(ids, scores):
                    yield a["key"], place, i, s

    anchors = rows.where("anchor").select("d", "key", F.col("vec_id").alias("anchor_id"), "label", "v")
    near = _streamed(visits(anchors.withColumn("windows", F.array().cast("array<bigint>"))), like, ["key", "positive_id", "positive_score"])
    order = Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < k)
    near = stage.written(spark, near, "positives")
    asking = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))  # k at most
    asking = anchors.join(asking, "key").withColumn("windows", F.col("p.positive_score"))
    far = _streamed(visits(asking.drop("p")), unlike, ["key", "place", "negative_id", "negative_score"])
    order = Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take)
    known = asking.select("key", "anchor_id", F.explode("p").alias("p")).select("key", "anchor_id", F.col("p.place").cast("long").alias("place"), "p.positive_id", "p.positive_score")
    return far.join(known, ["key", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
