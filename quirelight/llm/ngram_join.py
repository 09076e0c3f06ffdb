"""Jaccard self-join of documents on their word shingles with a prefix tree.

1. Equal texts (after folding A-Z) are collapsed. Each block of texts asks how often each of its shingles occurs among
   the distinct texts (see blocks.py). The answer gives the global order: rarer shingles first, then by hash.
   Shingles of one text only cannot be shared and are kept as a count.
2. By the prefix filter, two linked sets share a shingle among the first ``n - ceil(t n) + 1`` of each. Texts that share
   such a shingle are candidates. As only components and not all links are asked for, links are looked for in rounds:
   first each text against the smallest id among those that share a prefix shingle, which takes as many pairs as there are
   rows; then the texts that share one with another component than their own against all of that component and each other.
   No link that joins two components is lost.
3. Ordered sets are stored in prefix trees (see prefix_tree.py), one for each dealt group of texts, built once and walked
   for every text that is held against the group: the overlap is carried along shared beginnings, and a branch is left as
   soon as the overlap so far and what remains on either side cannot reach the threshold. Texts of a component of any size
   are dealt to several trees, and joins on a component are spread (see skew.py).

Defined results: null text and text without words: empty set, no links. Rows without a doc_id take no part. Rows that
repeat a doc_id with different texts count as separate texts of one document id. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import stage
from .components import components, forest
from .prefix_tree import PrefixTree
from .skew import spread_join
from .words import Words, mix, windows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sets in one tree, and sets held against it in one task, about.
TREE, PROBES = 256, 1024


def folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


class _Block:
    """The shingles of a block: of each text the distinct ones, and the distinct ones of all."""

    def __init__(self, data: bytes, width: int):
        self.ids, self.texts = B.unpack(data)
        w = Words(self.texts)
        h = w.hashes(0)
        at = np.flatnonzero(w.whole(width))
        keys, doc = windows(h, width)[at], w.doc[at]
        short = np.flatnonzero((w.count > 0) & (w.count < width))
        if len(short):  # the whole sequence is the only one
            own = []
            for d in short.tolist():
                part = h[w.first[d] : w.first[d] + w.count[d]]
                own.append(windows(part, len(part))[0] ^ np.uint64(len(part)))
            keys, doc = np.concatenate([keys, mix(np.array(own, np.uint64))]), np.concatenate([doc, short])
        order = np.lexsort((keys, doc))
        k, d = keys[order], doc[order]
        first = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])]) if len(k) else np.empty(0, bool)
        self.keys, self.doc = k[first], d[first]
        self.sizes = np.bincount(self.doc, minlength=len(self.ids))
        self.distinct, self.at, self.df = np.unique(self.keys, return_inverse=True, return_counts=True)


def _keys(block: int, n: int) -> np.ndarray:
    """Numbers of a block's texts that no other text has: rows that repeat a doc_id stay apart. Blocks are written once, so a repeated task gives the same."""
    task, made = block >> 32, block & 0xFFFFFFFF
    assert task < 1 << 20 and made < 1 << 22 and n <= B.BLOCK_TEXTS
    return (task << 43) + (made << 21) + np.arange(n)


def _frequencies(lists: list[bytes]) -> list[bytes]:
    """One byte for each shingle: 0 for those of one text, else growing with the logarithm of the number of texts."""
    keys = [B.from40(x[: len(x) // 6 * 5]) for x in lists]
    own = np.concatenate([np.frombuffer(x, np.uint8, offset=len(x) // 6 * 5) for x in lists])
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, own, len(every))
    code = np.where(total < 2, 0, np.minimum(255, 1 + np.floor(6 * np.log2(np.maximum(total, 1))))).astype(np.uint8)[at]
    return [x.tobytes() for x in np.split(code, np.cumsum([len(k) for k in keys])[:-1])]


def in_tree(x: np.ndarray, nx: int, sets: list[np.ndarray], sizes: list[int], percent: int) -> list[bool]:
    """Which sets have 100 |x & y| >= percent |x | y|; nx and sizes count shingles of one text only too."""
    found = set(PrefixTree(sets, sizes, percent).similar(x, nx))
    return [i in found for i in range(len(sets))]


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (c, k) of candidate texts to those that are linked, as (a, b)."""
    # candidates of one text go to as many trees as their number asks for
    many = stage.written(pairs.sparkSession, pairs.groupBy("c").agg(F.count("*").alias("m")), "centres")
    dealt = spread_join(pairs, many, "c", "m").select("c", "k", F.pmod(F.xxhash64("k"), F.ceil(F.col("m") / TREE).cast("long")).alias("tree"))
    members = dealt.join(sets.select(F.col("key").alias("k"), "n", "shared"), "k")
    centres = dealt.select("c", "tree").distinct().join(sets.select(F.col("key").alias("c"), "n", "shared"), "c")
    rows = members.select("c", "tree", "k", "n", "shared").unionByName(centres.select("c", "tree", F.col("c").alias("k"), "n", "shared"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        k, c = pdf["k"].to_numpy(), pdf["c"].iloc[0]
        own = int(np.flatnonzero(k == c)[0])
        load = [np.frombuffer(x, "<u8") for x in pdf["shared"]]
        n = pdf["n"].tolist()
        rest = [i for i in range(len(k)) if i != own]
        linked = in_tree(load[own], n[own], [load[i] for i in rest], [n[i] for i in rest], percent)
        b = [int(k[i]) for i, x in zip(rest, linked) if x]
        return pd.DataFrame({"a": np.full(len(b), c, np.int64), "b": np.array(b, np.int64)})

    return rows.groupBy("c", "tree").applyInPandas(walk, "a long, b long")


def _homes(outside: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the texts outside a component with it and with each other.

    outside (home, key): key shares a prefix shingle with a text of component home. Two texts of different components that share one are
    both outside the same home, or one is in it. A home's texts and those outside are dealt to trees, once each, and those outside
    go to each tree: rows grow with their number times the number of trees, not with pairs.
    """
    own = comps.select(F.col("component_id").alias("home"), F.col("id").alias("key"))
    size = outside.groupBy("home").agg(F.count("*").alias("x")).join(own.groupBy("home").agg(F.count("*").alias("c")), "home", "left")
    rows = F.col("x") + F.coalesce("c", F.lit(1))
    size = size.select("home", F.col("c").isNull().alias("alone"), rows.alias("rows"), F.ceil(rows / TREE).cast("int").alias("trees"), F.ceil(F.col("x") / PROBES).cast("int").alias("parts"))
    size = stage.written(sets.sparkSession, size, "home-sizes")
    own = own.unionByName(size.where("alone").select("home", F.col("home").alias("key")))  # a text without links is a component too
    size = size.drop("alone")
    deal = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    leaves = spread_join(own.unionByName(outside), size, "home", "rows").withColumn("tree", deal("trees")).withColumn("part", every("parts")).withColumn("probe", F.lit(False))
    probes = spread_join(outside, size, "home", "rows").withColumn("part", deal("parts")).withColumn("tree", every("trees")).withColumn("probe", F.lit(True))
    dealt = leaves.unionByName(probes).select("home", "tree", "part", "key", "probe").join(sets, "key")  # the sets travel last

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        stage.drop()
        probe = pdf["probe"].to_numpy()
        key, n = pdf["key"].to_numpy(), pdf["n"].to_numpy()
        load = [np.frombuffer(x, "<u8") for x in pdf["shared"]]
        prefix = [x[: max(0, m - -(-percent * m // 100) + 1 - (m - len(x)))] for x, m in zip(load, n.tolist())]
        leaves = np.flatnonzero(~probe).tolist()
        holds: dict[int, list[int]] = {}
        for i, leaf in enumerate(leaves):
            for t in prefix[leaf].tolist():
                holds.setdefault(t, []).append(i)
        tree = PrefixTree([load[k] for k in leaves], [int(n[k]) for k in leaves], percent)
        a, b = [], []
        for p in np.flatnonzero(probe).tolist():
            some = {i for t in prefix[p].tolist() for i in holds.get(t, ())}
            some = [i for i in some if key[leaves[i]] != key[p] and 100 * min(n[p], n[leaves[i]]) >= percent * max(n[p], n[leaves[i]])]
            got = tree.similar(load[p], int(n[p]), some) if some else []
            a += [key[p]] * len(got)
            b += [key[leaves[i]] for i in got]
        u, v = forest(np.array(a, np.int64), np.array(b, np.int64))
        return pd.DataFrame({"a": u, "b": v})

    return dealt.groupBy("home", "tree", "part").applyInPandas(walk, "a long, b long")


def ngram_jaccard_join(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, text_class: components of documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    text_class is the MD5 of the folded text; it tells apart rows that repeat a doc_id.
    """
    spark, parts = docs.sparkSession, stage.buckets(docs.sparkSession)
    docs = docs.where("doc_id is not null")
    members, least = B.text_classes(docs, folded(F.col("text")))
    held = B.stage_blocks(spark, least, "shingles")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stage.drop()
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = _Block(data, width)
                cut = B.split(x.distinct, parts)
                made = [(k, B.to40(x.distinct[a:b], k, parts) + np.minimum(x.df[a:b], 255).astype(np.uint8).tobytes()) for k, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
                yield pa.record_batch({"block": pa.array([block] * len(made), pa.int64()), "bucket": pa.array([k for k, _ in made], pa.int32()), "data": pa.array([d for _, d in made], pa.binary())})

    answered = B.exchange(held.mapInArrow(ask, "block long, bucket int, data binary"), _frequencies)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stage.drop()
        for batch in batches:
            for row in batch.to_pylist():
                x = _Block(row["data"], width)
                code = np.frombuffer(b"".join(B.in_order(row["answers"])), np.uint8)[x.at] if len(x.keys) else np.empty(0, np.uint8)
                shared = code > 0
                ranked = (code.astype(np.uint64) << np.uint64(56)) | (x.keys >> np.uint64(8))
                doc = x.doc[shared]
                order = np.lexsort((ranked[shared], doc))
                ranked, doc = ranked[shared][order], doc[order]
                per = np.bincount(doc, minlength=len(x.ids))
                stop = np.cumsum(per)
                n = x.sizes
                prefix = np.clip(n - -(-percent * n // 100) + 1 - (n - per), 0, per)
                values = ranked.view(np.int64)
                yield pa.record_batch({
                    "cls": pa.array([hashlib.md5(t).hexdigest() for t in x.texts], pa.string()),
                    "rep": pa.array(x.ids, pa.int64()),
                    "key": pa.array(_keys(row["block"], len(x.ids)), pa.int64()),
                    "n": pa.array(n, pa.int64()),
                    "prefix": pa.array([values[b - k : b - k + p] for b, k, p in zip(stop.tolist(), per.tolist(), prefix.tolist())], pa.list_(pa.int64())),
                    "shared": pa.array([ranked[b - k : b].tobytes() if p else None for b, k, p in zip(stop.tolist(), per.tolist(), prefix.tolist())], pa.binary()),
                })

    sets = stage.written(spark, B.with_answers(held, answered).mapInArrow(sets_of, "cls string, rep long, key long, n long, prefix array<long>, shared binary"), "sets")
    held_sets = sets.where("shared is not null").select("key", "n", "shared")
    prefixes = stage.written(spark, sets.where("shared is not null").select("key", "rep", "n", F.explode("prefix").alias("tok")), "prefixes")
    fits = lambda a, b: F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")

    # round 1: against the first text of each shingle
    first = prefixes.groupBy("tok").agg(F.count("*").alias("m"), F.min(F.struct("rep", "key", "n")).alias("f")).where("m > 1")
    stars = spread_join(prefixes, stage.written(spark, first, "firsts"), "tok", "m").where("key <> f.key").where(fits("n", "f.n")).select(F.col("f.key").alias("c"), F.col("key").alias("k")).distinct()
    stars = stage.written(spark, stars, "stars")
    linked = stage.written(spark, _verified(stars, held_sets, percent), "linked")
    comps = components(spark, linked)
    # round 2: of each shingle's texts, those outside the first one's component against all of other components
    where = prefixes.join(comps.withColumnRenamed("id", "key"), "key", "left").select("tok", "key", "n", "rep", F.coalesce("component_id", "key").alias("comp"))
    where = stage.written(spark, where, "placed")
    mixed = where.groupBy("tok").agg(F.min(F.struct("rep", "key", "comp")).alias("f"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("tok", F.col("f.comp").alias("fc"), "m")
    outside = stage.written(spark, spread_join(where, stage.written(spark, mixed, "mixed"), "tok", "m").where("comp <> fc").select(F.col("fc").alias("home"), "key").distinct(), "outside")
    again = stage.written(spark, _homes(outside, comps, held_sets, percent), "linked")
    if not again.isEmpty():
        comps = components(spark, comps.select(F.col("id").alias("a"), F.col("component_id").alias("b")).union(again))
    # a component is named by its smallest document id
    found = comps.join(sets.select(F.col("key").alias("id"), "rep"), "id")
    named = found.groupBy("component_id").agg(F.min("rep").alias("least"))
    done = comps.join(named, "component_id").select(F.col("id").alias("key"), F.col("least").alias("component_id"))
    classes = sets.select("cls", "rep", "key", F.col("n").alias("n_shingles")).join(done, "key", "left").select("cls", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    return B.of_members(spark, members, classes).select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("cls").alias("text_class"))
