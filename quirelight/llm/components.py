"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014), all on executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of some rows as stars: (node, smallest node it is linked with here)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
    roots = np.array([root(i) for i in range(len(nodes))], np.int64)
    off = roots != np.arange(len(nodes))
    return nodes[off], nodes[roots[off]]


def _local(links: DataFrame) -> DataFrame:
    """Links of a task thinned to stars, a batch at a time."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                u, v = forest(x.column(0).to_numpy(), x.column(1).to_numpy())
                yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return links.mapInArrow(thin, "u long, v long")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links (a long, b long) to (id long, component_id long) of every node that has a link; component_id is the smallest id reachable.

    No node's neighbours are gathered in one place: minima are aggregated before the shuffle and joined back, and a
    join with a very frequent key can be split. The number of rounds grows with the logarithm of the longest path.
    """
    stage.ship(spark)
    edges = stage.written(spark, _local(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")).distinct(), "links")
    state = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = state(edges)
    while True:
        # large star: every neighbour above u is hung on the least one of u
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every neighbour below u, and u, on the least one
        down = large.where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = stage.written(spark, small.distinct(), "links")
        now = state(edges)
        if now == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
        seen = now
