"""Prefix trie of conversations by smallest-member ownership, without a trie in memory.

Every turn of a conversation stands for the prefix that ends there, named by its depth and the running XOR of two hashes of
(depth, turn). A prefix is a node; the conversations that start with it are its members, and the smallest of them owns it. Deeper nodes have fewer
members, so what a conversation owns of its path is a suffix. Windows along the path therefore say all of it in one number, the first
depth owned, and one group-by of prefixes gives everything about subtrees: a node's subtree is on its members' paths, each node of it owned
once, so saved tokens are the members' tokens from here on less those they own, and leaves and children are flags of the members that own them.

Nothing about a node is gathered in one place: members are counted and compared by aggregates that begin before the shuffle, and joined back by
spread_join(), as a first turn may be that of a third of all conversations. A conversation of any length is cut into pieces of a range
partitioning; running values inside a piece get what the pieces before it add up to, for which the few conversations
that lie on a border are broadcast (two a partition at most). Texts are read once, for their digest and their length.

Defined results: rows without a conv_id take no part. Null roles and texts are empty. A null turn goes first; turns of equal number go in the
order of their digests, so repeated rows are repeated turns. No conversation at all gives no node. Conversations without turns are members of the
root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stage
from .skew import spread_join

#: Conversations whose ids share all but so many bits are joined to one text, before texts are hashed in order.
CHUNK_BITS = 10
NODE = ["depth", "k1", "k2"]


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest, tokens, piece of (conv_id, turn, role, text); written."""
    spark = conversations.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("tokens"))
    # equal rows are told apart, so that any number of them can be cut
    order = ["conv_id", F.asc_nulls_first("turn"), "digest"]
    cut = turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(stage.buckets(spark), *order, "row").drop("row")
    cut = stage.written(spark, cut.withColumn("piece", F.spark_partition_id()), "turns")
    inside = cut.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id", "piece").orderBy(*order[1:])).cast("long"))
    placed = _carried(inside, cut.groupBy("conv_id", "piece").agg(F.count("*").alias("pos")), {"pos": "sum"})
    return stage.written(spark, placed.select("conv_id", "pos", "digest", "tokens", "piece"), "positions")


def _carried(rows: DataFrame, totals: DataFrame, how: dict[str, str]) -> DataFrame:
    """rows whose running values count from the start of a piece, made to count from the start of the conversation.

    totals has the values of each whole (conv_id, piece); how: sum or xor. Only conversations of several pieces are carried over:
    those that a border between partitions cuts.
    """
    across = totals.join(totals.groupBy("conv_id").agg(F.count("*").alias("pieces")).where("pieces > 1").select("conv_id"), "conv_id")
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum, "xor": F.bit_xor}
    carry = across.select("conv_id", "piece", *(F.coalesce(fold[kind](c).over(before), F.lit(0)).alias(f"carry_{c}") for c, kind in how.items()))
    out = rows.join(F.broadcast(carry), ["conv_id", "piece"], "left")
    for c, kind in how.items():
        more = F.coalesce(f"carry_{c}", F.lit(0))
        out = out.withColumn(c, F.col(c) + more if kind == "sum" else F.col(c).bitwiseXOR(more))
    return out.drop(*(f"carry_{c}" for c in how))


def rebuilt(positions: DataFrame, shared: Column, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Of ordered(): turns (conv_id, depth, digest, tokens, piece, turns) and conversations (conv_id, turns, piece), both written.

    A conversation c starts with the first `shared` (a column of conv_id, at most `most`) turns of conversation c - c % family; its own turns
    after as many follow. Families are small, so their joins have no hot key.
    """
    spark = positions.sparkSession
    own = positions.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("piece").alias("first"))
    own = stage.written(spark, own.withColumn("h", shared.cast("long")).withColumn("base", F.col("conv_id") - F.col("conv_id") % family), "lengths")
    heads = own.where("conv_id = base").select("base", F.col("n").alias("base_n"))
    sized = own.join(heads, "base", "left").withColumn("from_base", F.least("h", F.coalesce("base_n", F.lit(0))))
    sized = sized.withColumn("turns", F.col("from_base") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    sized = stage.written(spark, sized.select("conv_id", "n", "first", "h", "base", "from_base", "turns"), "rebuilt-lengths")
    rest = spread_join(positions, sized.select("conv_id", "n", "h", "from_base", "turns"), "conv_id", "n").where("pos > h")
    rest = rest.select("conv_id", (F.col("from_base") + F.col("pos") - F.col("h")).alias("depth"), "digest", "tokens", "piece", "turns")
    opening = positions.where((F.col("conv_id") % family == 0) & (F.col("pos") <= most)).select(F.col("conv_id").alias("base"), "pos", "digest", "tokens")
    begin = sized.select("conv_id", "base", "h", "first", "turns").join(opening, "base").where("pos <= h")
    begin = begin.select("conv_id", F.col("pos").alias("depth"), "digest", "tokens", F.col("first").alias("piece"), "turns")
    return stage.written(spark, rest.unionByName(begin), "rebuilt"), sized.select("conv_id", "turns")


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, conv_id) to (depth, k1, k2, ends_sha256): ids joined in chunks, chunks hashed one after another as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done: list[tuple] = []
        for b in batches:
            for depth, k1, k2, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids"))):
                if (depth, k1, k2) != now:
                    if state is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (depth, k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.int64(),) * 3 + (pa.string(),))], names=[*NODE, "ends_sha256"])
                done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, state.hexdigest()), (pa.int64(),) * 3 + (pa.string(),))], names=[*NODE, "ends_sha256"])

    chunks = ends.groupBy(*NODE, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv_id, depth from 1 without gaps, digest, tokens, piece, turns), as rebuilt() makes them; piece grows with depth and says
    which rows of a conversation are looked at together; turns is the conversation's length. members: (conv_id, turns) of every conversation.
    """
    spark = turns.sparkSession
    tag = {"k1": F.xxhash64("depth", "digest"), "k2": F.xxhash64("digest", "depth", F.lit("second"))}
    tagged = turns.withColumns(tag)
    along = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = tagged.select("conv_id", "piece", "depth", "tokens", "turns", *(F.bit_xor(k).over(along).alias(k) for k in tag), F.sum("tokens").over(along).alias("upto"))
    totals = tagged.groupBy("conv_id", "piece").agg(*(F.bit_xor(k).alias(k) for k in tag), F.sum("tokens").alias("upto"))
    paths = _carried(inside, totals, {"k1": "xor", "k2": "xor", "upto": "sum"})
    paths = stage.written(spark, paths.select("conv_id", "turns", "tokens", (F.col("upto") - F.col("tokens")).alias("before"), F.struct(*NODE).alias("node")), "paths")
    end = F.col("node.depth") == F.col("turns")
    # the smallest member of each node, and whether all members end there
    least = paths.groupBy("node").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.count_if(end).alias("n_ends"))
    least = stage.written(spark, least, "nodes")
    marked = spread_join(paths, least, "node", "n_convs")
    others = F.col("owner") < F.col("conv_id")
    lent = marked.groupBy("conv_id").agg(
        F.max(F.when(others, F.struct("node.depth", "owner"))).alias("last"),
        F.coalesce(F.sum(F.when(others, F.col("tokens"))), F.lit(0)).alias("lent"),
        F.max(F.when(end & ~others & (F.col("n_ends") == F.col("n_convs")), 1)).alias("leaf"),
    )
    facts = members.join(lent, "conv_id", "left").select("conv_id", "turns", (F.coalesce("last.depth", F.lit(0)) + 1).alias("first_owned"), F.col("last.owner").alias("above"), F.coalesce("lent", F.lit(0)).alias("lent"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"))
    facts = stage.written(spark, facts, "owners")
    # the root is on every path: its members are the conversations
    opens = F.count_if((F.col("first_owned") == 1) & (F.col("turns") > 0))
    root = facts.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), opens.alias("n_children"), F.greatest(F.lit(1), F.sum("leaf")).alias("n_leaves"), F.sum("lent").alias("saved_tokens")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    top = facts.agg(F.min("conv_id")).first()[0]
    each = spread_join(paths.drop("turns", "tokens"), facts, "conv_id", "turns")
    depth = F.col("node.depth")
    parent = F.when(depth > F.col("first_owned"), F.col("conv_id")).otherwise(F.coalesce("above", F.lit(top).cast("long")))
    child = (depth + 1 >= F.col("first_owned")) & (depth < F.col("turns"))
    nodes = each.groupBy("node").agg(F.min(F.struct("conv_id", parent.alias("parent"))).alias("own"), F.count("*").alias("n_convs"), F.count_if(child).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.lit(0), F.col("lent") - F.col("before"))).alias("saved_tokens"))
    nodes = nodes.select("node.*", F.col("own.conv_id").alias("conv_id"), F.col("own.parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    ending = paths.where(end).select("node.*", "conv_id")
    turnless = members.where("turns = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")
    out = nodes.unionByName(root).join(_ends(ending.unionByName(turnless)), NODE, "left")
    sha = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))
