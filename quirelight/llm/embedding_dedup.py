"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Within a label, equal vectors are collapsed (with their number). The others are dealt to tiles of about TILE vectors, and
each pair of tiles is one group. A unit vector x is coded as s q, q int8, s = max|x| / 127, and e = |x - s q| is kept.
Then x y differs from s_x s_y (q_x q_y) by at most |s_x q_x| e_y + e_x |s_y q_y| + e_x e_y (Cauchy-Schwarz). The integer
product is exact in floating point. Only pairs whose upper bound reaches the threshold are computed in full precision.
A group returns sums of links and a spanning forest of its links, so a dense group of near copies returns few rows. A tile carries the vectors
beside the codes: fetching them for surviving pairs only would mean all pairs of a dense group as rows.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or whose label is null, links with
nothing and is its own component. Vectors of different length do not link. Rows without a vec_id take no part. Rows that repeat
a vec_id count as separate vectors. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stage
from .components import components, forest
from .skew import spread_join
from .vectors import usable

TILE = 1024
#: Labels and lengths whose numbers of tiles are broadcast.
LABELS = 100_000
#: Pairs computed in full precision at once.
PAIRS = 1 << 16
#: More than the rounding of the bounds' own arithmetic.
SLACK = 1e-9


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors to int8 codes, scales, error norms and norms of what the codes stand for."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(x - coded, axis=1), np.linalg.norm(coded, axis=1)


def possible(a: tuple, b: tuple, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose product may reach least."""
    kind = np.float32 if a[0].shape[1] * 127 * 127 < 2**24 else np.float64  # integers stay exact
    product = (a[0].astype(kind) @ b[0].astype(kind).T).astype(np.float64)
    product *= a[1][:, None] * b[1][None]
    product += a[3][:, None] * b[2][None] + a[2][:, None] * (b[3] + b[2])[None]
    return np.nonzero(product >= least - SLACK)


def _tiles(threshold: float):
    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        x = np.array(pdf["v"].tolist(), np.float64)
        x /= np.abs(x).max(axis=1)[:, None]  # no overflow or underflow in the norm
        x /= np.linalg.norm(x, axis=1)[:, None]
        codes = quantised(x)
        rep, mult, tile = pdf["key"].to_numpy(), pdf["mult"].to_numpy(), pdf["tile"].to_numpy()
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        a, b = possible(tuple(c[left] for c in codes), tuple(c[right] for c in codes), threshold)
        a, b = left[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        links = np.zeros(len(rep), np.int64)
        us, vs = [], []
        for k in range(0, len(a), PAIRS):
            p, q = a[k : k + PAIRS], b[k : k + PAIRS]
            near = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
            p, q = p[near], q[near]
            np.add.at(links, p, mult[q])
            np.add.at(links, q, mult[p])
            u, v = forest(rep[p], rep[q])
            us.append(u)
            vs.append(v)
        some = np.flatnonzero(links)
        u, v = forest(np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.int64),) * 2
        return pd.DataFrame({
            "id": np.concatenate([rep[some], u]).astype(np.int64),
            "links": np.concatenate([links[some], np.zeros(len(u), np.int64)]),
            "other": np.concatenate([rep[some], v]).astype(np.int64),
        })

    return pairs


def embedding_near_dedup(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of vectors (vec_id, embedding, label), linked at cosine >= threshold within a label."""
    spark = vectors.sparkSession
    stage.ship(spark)
    # floats travel as floats: they are doubles only where they are multiplied
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))
    fine = rows.where(F.col("label").isNotNull() & usable("v", zero=False))
    distinct = fine.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    # a vector's key is its own, whatever ids repeat; it is written with it
    distinct = distinct.withColumn("key", F.monotonically_increasing_id())
    distinct = stage.written(spark, distinct, "vectors")
    count = distinct.groupBy("label", F.size("v").alias("d")).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    count = stage.written(spark, count, "tiles")  # one row a label and length
    count = F.broadcast(count) if count.count() < LABELS else count
    placed = distinct.withColumn("d", F.size("v")).join(count, ["label", "d"]).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    dealt = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("i", F.least("tile", "with")).withColumn("j", F.greatest("tile", "with"))
    found = dealt.groupBy("label", "d", "i", "j").applyInPandas(_tiles(threshold), "id long, links long, other long")
    found = stage.written(spark, found, "tile-links")
    total = found.where("links > 0").groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(spark, found.where("links = 0").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = comps.join(distinct.select(F.col("key").alias("id"), "rep"), "id").groupBy("component_id").agg(F.min("rep").alias("least"))
    comps = comps.join(named, "component_id").select("id", "least")
    classes = distinct.join(total, F.col("key") == total["id"], "left").drop("id").join(comps, F.col("key") == comps["id"], "left")
    same = F.struct("label", "v").alias("same")
    classes = classes.select(same, "mult", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    # rows of a vector that very many repeat stay where they are
    out = spread_join(fine.select("vec_id", same), stage.written(spark, classes, "classes"), "same", "mult").select("vec_id", "n_links", "component_id")
    alone = rows.where(~(F.col("label").isNotNull() & usable("v", zero=False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
